"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, stage


def _minima(pairs: DataFrame) -> DataFrame:
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (u, v) to one row per linked node: node, component (the smallest node that it reaches).

    Each step is one aggregation with map-side minima and one join that Spark may split where a node has many links; every
    round is staged, so nothing is kept on the driver or on one executor. Links to itself and nulls are ignored.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, mark = stage(ordered, "links"), None, None
    for _ in range(max_rounds):
        count = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == mark or not count[0]:
            break
        mark = tuple(count)
        # large star: the neighbours above u point to the least node around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both)
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        # small star: the neighbours below u, and u, point to the least of them
        low = _minima(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        before, now = now, stage(small.where("u <> v").distinct(), "links")
        for old in (before, least, large, low):
            remove(now.sparkSession, old)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
