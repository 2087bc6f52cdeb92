"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions only.

Every shard draws a number from the hash of (key, shard): ``-weight / ln(u)``. The greatest draw owns the
key. A new shard can only win keys for itself, so nothing moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaje.llm.common import ranked

SHARDS = 16


def draw(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """The shard's draw for a key: positive, greater more often for greater weights."""
    return F.lit(-float(weight)) / F.log(uniform(F.concat_ws("|", *keys, F.lit(str(shard)))))


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def text_key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\u0000null"))


def owner(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard from 0 that wins the key; equal draws go to the smaller number.

    Null keys are keys like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    keys = [text_key(k) for k in keys]
    draws = [F.struct(draw(keys, i, w).alias("d"), F.lit(-i).alias("s"))
             for i, w in enumerate(weights)]
    return (-F.greatest(*draws)["s"] if len(draws) > 1 else F.lit(0)).cast("int")


def shard(df: DataFrame, keys: Sequence[str], weights: Sequence[float],
          name: str = "shard") -> DataFrame:
    """The rows with their shard; a column of that name is replaced."""
    return df.withColumn(name, owner([F.col(f"`{k}`") for k in keys], weights))


def placement(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS,
              grown_weight: float = 1.0, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per document: size, text_crc32, shard, gapless slot in the shard, and the
    shard after one more shard of ``grown_weight``.

    Null text has no bytes. Rows with equal keys share a shard; rows equal in key, size and
    checksum get slots of their own. Slots are numbered by bucket counts and prefix sums, so no
    shard meets in one task.
    """
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = rows.withColumn("shard", owner([F.col("doc_id")], list(weights)))
    out = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32"], docs.count(), "slot",
                 uniform(text_key(F.col("doc_id"))))
    return out.withColumn("grown_shard", owner([F.col("doc_id")], [*weights, grown_weight]))
