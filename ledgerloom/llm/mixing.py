"""Mixing of sources to target weights by Poisson replication.

A source whose target is `rate` times its size gets every document Poisson(rate) times. The count comes from a number
in (0, 1) drawn from a digest of seed and document, by inversion of the distribution function, so it is the same in
every run and on every cluster. Documents are exploded by their counts and dealt out anew by a digest of document and
copy, which is also the order within each part: a global shuffle in one exchange, even for a hot source. The rates are
one row per source, written once and broadcast only below Spark's size threshold; otherwise the join splits hot keys.

Defined cases: a null source is a source of its own; a null text has size 0, and a source of size 0 keeps rate 1; a
source that is missing among given weights gets weight 0; equal rows draw equal counts; input columns named like a
result (`copy`, `shuffle_key`) are replaced; a text counts with its whole length, and copies of equal shuffle keys may come in either order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import packed, unpack, whole_text
from ledgerloom.session import materialise

HEX = 13  # digits of a digest that make a number: 52 bits


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) drawn by a digest of the parts."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX), 16, 10).cast("long")
    return (drawn + 0.5) / float(16**HEX)


def distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... up to where the rest is below 1e-16. Terms are summed as logarithms' powers."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")
    )

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    summed = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["all"])
    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(summed)


def source_rates(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, budget: float | None = None
) -> DataFrame:
    """source, size in characters, and its rate.

    `weights` (source, weight) are the target shares; without them a source weighs its size to the `power`. `budget` is
    the size of the mix in characters, by default that of the input.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.char_length(whole_text(F.col("text")))).cast("long").alias("size"))
    sizes = materialise(sizes, "source-sizes")
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given")
        weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighted.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size")).first()
    if weights is not None and total["size"] and not total["weight"]:
        raise ValueError("no source has a weight")
    scale = (budget if budget is not None else float(total["size"] or 0)) / float(total["weight"] or 1.0)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.lit(scale) * F.col("weight") / F.col("size"))
    return weighted.select("source", "size", rate.alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """Each document as often as its draw says, with `copy` from 0 and `shuffle_key`, in globally shuffled order."""
    columns = docs.columns
    base = packed(docs).withColumn("own_source", F.col("row.source"))
    table = rates.select(F.col("source").alias("rated"), distribution(F.col("rate")).alias("distribution"))
    table = materialise(table, "distributions")
    joined = base.join(table, F.col("own_source").eqNullSafe(F.col("rated")), "left")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = uniform(F.lit(str(seed)), identity)
    count = F.size(F.filter("distribution", lambda below: below < F.col("drawn")))
    copies = joined.withColumn("drawn", drawn).withColumn("count", count).filter("count > 0")
    exploded = copies.select("row", "doc_id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    keyed = exploded.withColumn(
        "shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), identity, F.col("copy").cast("string")))
    )
    dealt = keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return unpack(dealt, columns, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))
