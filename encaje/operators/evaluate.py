"""Metrics of scored, labelled pairs, and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encaje.session import written


def _ratio(part: Column, whole: Column) -> Column:
    """0 where the ratio is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(label: str = "label", predicted: str = "class") -> Column:
    return F.avg((F.col(label) == F.col(predicted)).cast("double"))


def _hits(label: str, predicted: str) -> Column:
    return F.count_if((F.col(label) == 1) & (F.col(predicted) == 1))


def precision(label: str = "label", predicted: str = "class") -> Column:
    return _ratio(_hits(label, predicted), F.count_if(F.col(predicted) == 1))


def recall(label: str = "label", predicted: str = "class") -> Column:
    return _ratio(_hits(label, predicted), F.count_if(F.col(label) == 1))


def f1(label: str = "label", predicted: str = "class") -> Column:
    return _ratio(_hits(label, predicted) * 2,
                  F.count_if(F.col(predicted) == 1) + F.count_if(F.col(label) == 1))


def auc(scored: DataFrame, probability: str = "match_probability", label: str = "label",
        by: list[str] | None = None) -> DataFrame:
    """``auc`` of each group of ``by`` (one row without), exact with ties; 0.5 if only one label occurs.

    Equal scores are counted first. The distinct scores are range-partitioned over group and score, so a huge
    group spreads over many tasks; a piece learns from the sums of earlier pieces how many rows of label 0
    score below its first. Nothing reaches the driver. The placed counts are written once, because range borders
    are sampled.
    """
    by = list(by or [])
    keys = [*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
            F.col(probability).cast("double").alias("_p")]
    names = [f"_k{i}" for i in range(len(by))]
    counted = scored.select(*keys, F.col(label).alias("_y")).groupBy(*names, "_p").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))
    placed = (counted.repartitionByRange(*names, "_p").sortWithinPartitions(*names, "_p")
              .withColumn("_piece", F.spark_partition_id()))
    placed = written(placed, "scores")
    pieces = placed.groupBy(*names, "_piece").agg(F.sum("_neg").alias("_sum"))
    earlier = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("_piece").alias("_at"),
                           F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_piece") == F.col("_at")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    inside = Window.partitionBy(*names, "_piece").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    summed = placed.join(starts, same).withColumn(
        "_area", F.col("_pos") * (below + F.col("_neg") / 2.0)).groupBy(*names).agg(
        F.sum("_area").alias("_area"), F.sum("_pos").alias("_n1"), F.sum("_neg").alias("_n0"))
    both = (F.col("_n1") > 0) & (F.col("_n0") > 0)
    area = F.col("_area") / (F.col("_n1").cast("double") * F.col("_n0"))
    return summed.select(*[F.col(n).alias(c) for n, c in zip(names, by)],
                         F.when(both, area).otherwise(0.5).alias("auc"))


def metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``accuracy, precision, recall, f1, auc`` of each group of ``by``, in one plan; one row without."""
    made = [accuracy().alias("accuracy"), precision().alias("precision"), recall().alias("recall"),
            f1().alias("f1")]
    if not by:
        return scored.agg(*made).withColumn("auc", auc(scored).scalar())
    areas = auc(scored, by=by).withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return scored.groupBy(*by).agg(*made).join(areas, same).drop(*[f"_{c}" for c in by])


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """``label, weight`` with weight n / (classes * rows of the class)."""
    counts = samples.groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg((F.sum("rows") / F.count("*")).alias("share"))
    return counts.withColumn("share", total.scalar()).select(
        label, (F.col("share") / F.col("rows")).alias("weight"))


def batch_summary(predictions: DataFrame) -> DataFrame:
    """Pairs and their mean score; failed pairs count as 0."""
    return predictions.agg(F.count("*").alias("pairs"),
                           F.avg("match_score").alias("mean_score"))
