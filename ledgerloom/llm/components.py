"""Connected components by alternating large and small stars; every step is a join and a partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node it is connected with) for each node that has a link to another.

    Links of one round are written below the shared folder and read in the next, so lineage doesn't grow. Rounds go on
    until the links no longer change; their number grows with the logarithm of the nodes. Nodes with very many links are
    only summed up and joined, never gathered; adaptive execution splits them in the joins.
    """
    stars = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high != low").distinct()
    stars = materialise(stars, "links")
    before = _mark(stars)
    while True:
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            stars.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both, least, ["u"], "inner").filter("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = lookup_join(large, lowest, ["high"], "inner").select(
            F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("m").alias("low")
        )
        stars = materialise(small.distinct(), "links")
        after = _mark(stars)
        if after == before:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = after


def _mark(links: DataFrame) -> tuple:
    hashed = F.xxhash64("high", "low")
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.bitwiseAND(F.lit((1 << 31) - 1))).alias("s")
    ).first()
    return tuple(row)
