"""Readers for candidate documents, postings, applications and pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encaje.schemas import CVS, JOBS, PAIRS, require

_STEM = r"^(.*)\.[^.]+$"


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """Applications from parquet; ids become strings."""
    df = require(spark.read.parquet(path), "candidateId", "jobId", what="applications")
    return with_string_ids(df)


def with_string_ids(df: DataFrame) -> DataFrame:
    ids = [c for c in ("applicationId", "candidateId", "jobId", "cv_id", "job_id")
           if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def read_files(spark: SparkSession, folder: str, pattern: str, id_column: str,
               text_column: str) -> DataFrame:
    """One row per file; the id is the file name without its last suffix."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return df.select(
        F.regexp_extract(F.col("_metadata.file_name"), _STEM, 1).alias(id_column),
        F.col("value").alias(text_column))


def read_cvs(spark: SparkSession, path: str, ids: DataFrame | None = None,
             layout: str = "parquet") -> DataFrame:
    """``cv_id, raw_text`` from a table or from a folder of extracted text files.

    The table is the layout for large corpora: one file per document makes the
    driver list every one of them.
    """
    if layout == "files":
        df = read_files(spark, path, "*.txt", "cv_id", "raw_text")
    else:
        df = spark.read.parquet(path)
    return corpus(df, CVS.names, ids)


def read_jobs(spark: SparkSession, path: str, ids: DataFrame | None = None,
              layout: str = "parquet") -> DataFrame:
    """``job_id, html`` from a table or from a folder of HTML files."""
    if layout == "files":
        df = read_files(spark, path, "*.html", "job_id", "html")
    else:
        df = spark.read.parquet(path)
    return corpus(df, JOBS.names, ids)


def corpus(df: DataFrame, columns: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Two string columns, id first, limited to the wanted ids if given."""
    out = require(df, *columns, what="corpus").select(
        *[F.col(c).cast("string").alias(c) for c in columns])
    if ids is not None:
        out = out.join(ids.select(F.col(ids.columns[0]).alias(columns[0])), columns[0],
                       "left_semi")
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``cv_id, job_id`` from CSV with a header; other columns are ignored."""
    everything = spark.read.option("header", True).csv(path)
    return require(everything, *PAIRS.names, what="pairs file").select(
        *[F.col(c).cast("string").alias(c) for c in PAIRS.names])


def concat_pages(pages: DataFrame, id_column: str = "id", order: str = "page_no",
                 text: str = "text", out: str = "raw_text") -> DataFrame:
    """The pages of each document in page order, joined without a separator.

    A group is one document, and the output row holds all of it anyway.
    """
    page = F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("text"))
    in_order = F.array_sort(F.collect_list(page))
    return pages.groupBy(id_column).agg(
        F.array_join(F.transform(in_order, lambda p: p["text"]), "").alias(out))


def lookup_jobs(ids: DataFrame, priority: DataFrame, jobs: DataFrame) -> DataFrame:
    """Raw postings by id: from the priority source if it has one, else the main one."""
    wanted = ids.select("job_id").distinct()
    first = priority.select("job_id", F.col("html").alias("_first"))
    second = jobs.select("job_id", F.col("html").alias("_second"))
    return (wanted.join(first, "job_id", "left").join(second, "job_id", "left")
            .select("job_id", F.coalesce("_first", "_second").alias("html"))
            .withColumn("found", F.col("html").isNotNull()))
