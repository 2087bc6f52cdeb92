"""Helpers shared by the operators: reading, batch functions, gapless ranks, small samples."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RANK_ROWS = 4096
SLICE_ROWS = 1024
BATCH_BYTES = "16m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fields(spec: str) -> T.StructType:
    """A schema from a DDL string."""
    return T.StructType.fromDDL(spec)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def release() -> None:
    """Give memory that is free again back to the system: Spark keeps idle workers for a while,
    and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that little of a batch is ever held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        del batch
        release()


def small_batches(spark: SparkSession) -> None:
    """Let Spark send Python at most ``SLICE_ROWS`` rows and ``BATCH_BYTES`` at once.

    A setting of the session, lowered if it is higher: both sides of the pipe hold whole batches.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= SLICE_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def by_batch(df: DataFrame, inputs: Sequence[str], schema: T.StructType,
             fn: Callable[..., Sequence], keep: Sequence[str] = ()) -> DataFrame:
    """Map Arrow batches: ``fn`` gets the input columns as Arrow arrays and returns one list
    or array per field, a value per row. The ``keep`` columns pass through untouched, in front;
    all other columns are dropped before Python sees them. Batches are bounded in rows and bytes
    by Spark, so a task holds one batch whatever the size of its partition.
    """
    small_batches(df.sparkSession)
    names = list(dict.fromkeys([*keep, *inputs]))
    df = df.select(*[F.col(f"`{c}`") for c in names])
    out = T.StructType([df.schema[c] for c in keep] + schema.fields)
    arrow = to_arrow_schema(schema)
    at, kept = [names.index(c) for c in inputs], [names.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = fn(*[batch.column(i) for i in at])
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                    for x, f in zip(got, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=[f.name for f in out.fields])

    return df.mapInArrow(run, out)


def to_rows(df: DataFrame, inputs: Sequence[str], schema: T.StructType,
            fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Like :func:`by_batch`, but ``fn`` yields any number of output rows for a batch."""
    small_batches(df.sparkSession)
    df = df.select(*[F.col(f"`{c}`") for c in inputs])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(fn(*batch.columns))
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Each text; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def ranked(df: DataFrame, group: Sequence[str], columns: Sequence[str], total: int,
           name: str = "rank", order: Column | None = None) -> DataFrame:
    """``group`` (not null) and ``columns`` of every row with its gapless rank from 0 within the group.

    Ranks follow ``order``, a number from 0 up to below 1 that is a function of the columns (by
    default their hash), then the columns; the cluster and the number of buckets do not matter.
    No group meets in one task: rows are counted per bucket of ``order``, a prefix sum over the
    counts gives each bucket its first rank, and only a bucket is sorted. Equal rows are counted
    first and multiplied again in the end, so a row repeated very often is no hot bucket.
    """
    both = [*group, *columns]
    buckets = max(1, math.ceil(total / RANK_ROWS))
    if order is None:
        order = F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / float(1 << 52)
    counted = (df.groupBy(*both).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_order", order)
               .withColumn("_bucket", F.floor(F.col("_order") * buckets)))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_order", *columns).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = counted.withColumn("_start", F.sum("_n").over(inside) - F.col("_n"))
    sizes = counted.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        same = same & (F.col(c) == F.col(f"_g{i}"))
    placed = rows.join(offsets, same)
    return placed.select(*both, F.explode(F.sequence(
        F.col("_at") + F.col("_start"),
        F.col("_at") + F.col("_start") + F.col("_n") - 1)).alias(name))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest seeded hash of the key; for fitting only."""
    return df.orderBy(F.xxhash64(key, F.lit(17)), key).limit(rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SALTS = 64  # parts of the rows of one key in a join


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` left-joined to ``side``, whose keys are unique, though one key may hold any share of the rows.

    A key's rows are dealt into ``SALTS`` parts by ``by``. The side meets the distinct parts of its keys
    first, at most ``SALTS`` for each, so no task has more than a part of a key.
    """
    salt = fresh(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.select(*keys, salt).dropna(subset=keys).distinct().join(side, keys)
    return dealt.join(parts, [*keys, salt], "left").drop(salt)
