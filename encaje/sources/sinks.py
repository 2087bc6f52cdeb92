"""Writers for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREDICTION_COLUMNS = ["match_probability", "match_score", "cv_id", "job_id", "rank", "error"]


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one file per partition; columns the frame lacks are left out."""
    columns = [c for c in PREDICTION_COLUMNS if c in df.columns]
    df.select(*columns).write.mode(mode).option("header", True).option(
        "escape", '"').csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read such a folder back, numbers as numbers."""
    types = {"match_probability": "double", "match_score": "double", "rank": "int"}
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.select(*[df[c].cast(types.get(c, "string")).alias(c) for c in df.columns])
