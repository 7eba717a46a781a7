"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(e: DataFrame) -> DataFrame:
    """e: distinct (u, v) with u > v. One large-star round, then one small-star round."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    up = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = up.groupBy("u").agg(F.min("v").alias("m"))
    small = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    edges: (u, v) of one orderable type, in any order, repeated or not; nulls and loops are ignored.
    Every round's links are a table in the shared folder, and the one before the last is deleted.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before, kept = scratch.keep(e, f"{label}-0"), None, f"{label}-0"
    for i in range(1, rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        e, before = scratch.keep(_stars(e), f"{label}-{i}", 2 * now[0]), now  # a round keeps the number of links, nearly
        scratch.drop(kept)
        kept = f"{label}-{i}"
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
