"""Connected components of links between ids, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaje.session import written


def _least(links: DataFrame) -> DataFrame:
    """Every (u, v) with the least neighbour of u or u itself."""
    least = links.groupBy("u").agg(F.min("v").alias("_m")).select(
        "u", F.least("u", "_m").alias("m"))
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    turned = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(turned)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id: the least id it can reach.

    Ends when every link leads straight to a component's least id. Nothing but a count and a
    checksum reaches the driver; each round is written, which also cuts the lineage.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, state = written(links, "links"), None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"),
                      F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == state or not row["n"]:
            break
        state = row["n"], row["x"]
        now = written(_small(_large(now)), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
