"""Applications: ids, labels, validity, training samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.settings import DEFAULTS

_BUCKET_DIGITS = 3  # 16^3 hash buckets


def renamed(applications: DataFrame) -> DataFrame:
    return applications.withColumnsRenamed({"candidateId": "cv_id", "jobId": "job_id"})


def ids_in_use(applications: DataFrame, column: str) -> DataFrame:
    """Distinct non-null ids of one side."""
    return applications.select(column).where(F.col(column).isNotNull()).distinct()


def label_of(status: Column, positive: list[str] = lexicon.POSITIVE_STATUSES) -> Column:
    """1 for a positive outcome in any case, 0 for all else and for null."""
    return F.coalesce(F.upper(status).isin(positive), F.lit(False)).cast("int")


def add_label(applications: DataFrame, status: str = "applicationStatus") -> DataFrame:
    """Add ``label``; without a string status column nothing is added."""
    if status not in applications.columns:
        return applications
    if dict(applications.dtypes)[status] != "string":
        return applications.withColumn("label", F.lit(0))
    return applications.withColumn("label", label_of(F.col(status)))


def process_status(ids: DataFrame, corpus: DataFrame, id_column: str) -> DataFrame:
    """``id, success``: an id fails only if the corpus has no row for it."""
    known = corpus.select(id_column, F.lit(True).alias("_known"))
    return (ids.select(id_column).join(known, id_column, "left")
            .select(id_column, F.col("_known").isNotNull().alias("success")))


def missing_ids(ids: DataFrame, corpus: DataFrame, id_column: str) -> DataFrame:
    """Requested ids the corpus has no row for."""
    return ids.select(id_column).join(corpus.select(id_column), id_column, "left_anti")


def valid_applications(applications: DataFrame, cvs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications whose two sides were both processed, labelled."""
    return add_label(applications.join(cvs.select("cv_id"), "cv_id", "left_semi")
                     .join(jobs.select("job_id"), "job_id", "left_semi"))


def training_samples(applications: DataFrame, cv_recs: DataFrame,
                     job_recs: DataFrame) -> DataFrame:
    """Applications with both texts; duplicates stay, failed sides drop out."""
    labelled = add_label(applications)
    if "applicationId" not in labelled.columns:
        labelled = labelled.withColumn("applicationId", F.lit(""))
    keep = [F.col("applicationId").alias("application_id"), "cv_id", "job_id", "cv_text",
            "job_text"] + (["label"] if "label" in labelled.columns else [])
    keep += [c for c in ("split",) if c in labelled.columns]
    return (labelled
            .join(cv_recs.select("cv_id", F.col("text").alias("cv_text")), "cv_id")
            .join(job_recs.select("job_id", F.col("text").alias("job_text")), "job_id")
            .select(*keep))


def shuffle_key(seed: int, *columns: str) -> Column:
    """A key that orders rows as a seeded shuffle would, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def _in_order(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their seeded hash and its bucket, and per bucket the rows before it, its own, and all.

    A row without a key is placed by a hash of all its columns, so that many of them do not meet in a bucket.
    """
    whole = F.concat(F.lit("null|"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    order = F.when(F.col(key).isNotNull(), shuffle_key(seed, key)).otherwise(F.md5(whole))
    keyed = df.withColumn("_order", order).withColumn(
        "_bucket", F.conv(F.substring("_order", 1, _BUCKET_DIGITS), 16, 10).cast("int"))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # 4,096 rows at most, so one window over all of them is small.
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed, counts.select(
        "_bucket", "_rows", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_all"))


_HELPERS = ["_bucket", "_order", "_rows", "_before", "_all"]


def split(df: DataFrame, key: str, train: float = DEFAULTS.train_ratio,
          validation: float = DEFAULTS.validation_ratio,
          seed: int = DEFAULTS.seed) -> DataFrame:
    """Add ``split``: exact shares of train and validation, the rest is test.

    Rows are placed by a seeded hash. Whole hash buckets fall into one part by
    their counts alone; only the buckets that a border cuts, two of 4,096 at
    most, are ranked row by row. No row order is ever computed for the rest.
    """
    keyed, buckets = _in_order(df, key, seed)
    borders = buckets.withColumns({
        "_train": F.floor(F.col("_all") * F.lit(float(train))),
        "_validation": F.floor(F.col("_all") * F.lit(float(validation)))})

    def part(position: Column) -> Column:
        return (F.when(position < F.col("_train"), "train")
                .when(position < F.col("_train") + F.col("_validation"), "validation")
                .otherwise("test"))

    first, last = part(F.col("_before")), part(F.col("_before") + F.col("_rows") - 1)
    placed = keyed.join(F.broadcast(borders), "_bucket").withColumn(
        "_cut", first != last).withColumn("split", F.when(~F.col("_cut"), first))
    clear = placed.where(~F.col("_cut"))
    within = Window.partitionBy("_bucket").orderBy("_order", key)
    ranked = (placed.where("_cut").withColumn("_at", F.row_number().over(within) - 1)
              .withColumn("split", part(F.col("_before") + F.col("_at"))).drop("_at"))
    return clear.unionByName(ranked).drop(*_HELPERS, "_train", "_validation", "_cut")


def sample_rows(df: DataFrame, key: str, size: int | None,
                seed: int = DEFAULTS.seed) -> DataFrame:
    """A seeded sample of exactly ``size`` rows, all rows if there are no more.

    The first rows in seeded hash order. Whole hash buckets are in or out by their counts; only the one
    that the border cuts is ranked, so a sample of any size never meets in one task.
    """
    if size is None:
        return df
    keyed, buckets = _in_order(df, key, seed)
    placed = keyed.join(F.broadcast(buckets.where(F.col("_before") < size)), "_bucket")
    fits = F.col("_before") + F.col("_rows") <= size
    within = Window.partitionBy("_bucket").orderBy("_order", key)
    border = placed.where(~fits).withColumn("_at", F.row_number().over(within)).where(
        F.col("_before") + F.col("_at") <= size).drop("_at")
    return placed.where(fits).unionByName(border).drop(*_HELPERS)
