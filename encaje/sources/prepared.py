"""A corpus with its records and word vectors made beforehand, for requests about a few documents.

Rows lie in hash buckets of their id. ``path/saves`` has one line per state: which version of each bucket is
in use. A refresh looks for ids whose raw content is new, changed or gone, makes records for those alone, and
writes the buckets they touch as a new version; all other buckets stay as they are. The line is added last, so
readers see the state before or the one after, and a refresh that breaks changes nothing.

Rows without id are left out: nothing can ask for them. Repeated ids stay rows of their own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encaje.operators import records
from encaje.operators.features import small
from encaje.operators.scoring import used_only, word_vectors
from encaje.session import written

BUCKETS = 64
_FRESH, _STORED, _TOUCHED = 0, 1, 2  # kinds of rows that meet in a refresh
_RAW = {"cv_id": ("raw_text", records.cv_records), "job_id": ("html", records.job_records)}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str) -> dict | None:
    """The last saved line, None if there is none yet."""
    try:
        lines = spark.read.text(f"{path}/saves")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # lines begin with their time, in digits of equal number
    return json.loads(lines.agg(F.max("value").alias("v")).first()["v"].split(" ", 1)[1])


def _read(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of all or of some buckets; no file of another bucket is opened."""
    chosen = [(v, b) for b, v in state["versions"].items() if buckets is None or int(b) in buckets]
    schema = f"{state['key']} string, {state['columns']}, version string, bucket int"
    if not chosen:
        return spark.createDataFrame([], schema).drop("version", "bucket")
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(
        *[f"{path}/data/version={v}/bucket={b}" for v, b in chosen]).drop("version", "bucket")


def _by_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket")


def _without_old(fresh: DataFrame, stored: DataFrame, touched: DataFrame, key: str, buckets: int) -> DataFrame:
    """The fresh rows and those stored ones whose id is not touched, by bucket.

    Rows hold texts, so each moves once: the touched ids come along as rows of their own, and one sort by bucket
    and id serves both for finding them and for writing the buckets.
    """
    marked = touched.select(key).withColumn("_kind", F.lit(_TOUCHED))
    together = fresh.withColumn("_kind", F.lit(_FRESH)).unionByName(
        stored.withColumn("_kind", F.lit(_STORED))).unionByName(marked, allowMissingColumns=True)
    dealt = _by_bucket(together, key, buckets).withColumn(
        "_most", F.max("_kind").over(Window.partitionBy("bucket", key)))
    return dealt.where((F.col("_kind") == _FRESH) | (F.col("_most") == _STORED)).drop("_kind", "_most")


def refresh(corpus: DataFrame, path: str, key: str, buckets: int = BUCKETS,
            make: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Bring the prepared corpus at ``path`` up to the given raw corpus; the number of ids that changed.

    ``key`` is cv_id or job_id. The number of buckets is set by the first call.
    """
    spark, (raw, own) = corpus.sparkSession, _RAW[key]
    state = _state(spark, path) or {"key": key, "buckets": buckets, "versions": {},
                                    "columns": "digest string, text string, terms array<struct<term: string, "
                                               "n: bigint>>, square bigint"}
    if state["key"] != key:
        raise ValueError(f"{path} holds a corpus by {state['key']}")
    corpus = corpus.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), raw)
    digest = F.md5(F.coalesce(F.concat(F.lit("="), raw), F.lit("")))
    incoming = written(corpus.select(key, digest.alias("digest")), "corpus-digests")
    stored = _read(spark, path, state)
    there = stored.select(key, "digest")
    touched = written(
        incoming.join(there, [key, "digest"], "left_anti").select(key).unionByName(
            there.join(incoming, [key, "digest"], "left_anti").select(key)).distinct().withColumn(
            "bucket", bucket_of(F.col(key), state["buckets"])), "corpus-touched")
    changed = touched.count()
    if not changed:
        return 0
    hit = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # one per bucket at most
    # with nothing stored every id is new, and no text has to meet the ids
    wanted = used_only(corpus, small(touched, changed), key) if state["versions"] else corpus
    # a row's own name carries its digest through the making of the record, also for a repeated id
    source = wanted.withColumn(key, F.concat(digest, F.lit("|"), key))
    recs = written((make or own)(source).select(key, "text"), "corpus-records")
    counted = word_vectors(recs.withColumn("both", F.struct(key, "text")), "both")
    fresh = counted.select(
        F.substring_index(F.col(f"both.{key}"), "|", 1).alias("digest"),
        F.expr(f"substring(both.{key}, 34)").alias(key), F.col("both.text").alias("text"), "terms", "square")
    columns = [key, "digest", "text", "terms", "square"]
    rows = fresh.select(*columns)
    if state["versions"]:
        rows = _without_old(rows, _read(spark, path, state, hit).select(*columns), touched, key, state["buckets"])
    else:
        rows = _by_bucket(rows, key, state["buckets"])
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    folder = f"{path}/data/version={version}"
    rows.write.partitionBy("bucket").parquet(folder)
    filled = {r["bucket"] for r in spark.read.schema(rows.schema).parquet(folder).select(
        "bucket").distinct().collect()}
    versions = {b: v for b, v in state["versions"].items() if int(b) not in hit}
    versions |= {str(b): version for b in sorted(filled)}
    line = f"{version} {json.dumps({**state, 'versions': versions})}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/saves")
    return changed


def load(spark: SparkSession, path: str) -> DataFrame:
    """``id, digest, text, terms, square`` of all documents."""
    state = _state(spark, path)
    if state is None:
        raise ValueError(f"nothing is prepared at {path}")
    return _read(spark, path, state)


def lookup(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The same of some documents, read from their buckets alone."""
    state = _state(spark, path)
    if state is None:
        raise ValueError(f"nothing is prepared at {path}")
    asked = spark.createDataFrame([(i,) for i in ids], "id string")
    hit = [r["b"] for r in asked.select(
        bucket_of(F.col("id"), state["buckets"]).alias("b")).distinct().collect()]
    return _read(spark, path, state, hit).where(F.col(state["key"]).isin([i for i in ids if i is not None]))
