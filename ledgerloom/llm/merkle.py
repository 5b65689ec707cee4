"""Merkle manifest of a dataset: one digest for all rows, and a short proof for each.

Rows are leaves of one binary tree per key (here the language), and the roots of these trees are the leaves of a tree of
their own. Only the leaves and every `every`-th level above them are written (checkpoints). A level between is made
when it is asked for: a proof takes the stored nodes of one aligned subtree (2 ** `every` at most), makes the
interior nodes again, hands out each node's siblings and drops them. So a manifest takes little more room than its leaves,
and no task holds more than one such subtree.

Leaves are numbered within their tree by ranges of sorted rows, so a tree with a third of all rows (or all of them)
is as many tasks as its rows ask for. Trees are made level by level, all trees in one job per stored level.

Defined cases: fields that are null count as `-`, which no value does; rows without a key form the tree that comes first;
rows without id come first in their tree; rows of equal id are ordered by their digest, and repeated rows are leaves of
their own, with equal digests; texts are digested whole, whatever their length, an empty one as `0:`; the columns of the
input that are no fields are not read, whatever their names; an empty table has no leaves, no root and an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import numbered
from ledgerloom.session import new_table_path

EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its value; `-` for null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _level_above(nodes: Column) -> Column:
    """One digest for every two nodes; the last one may have one only."""
    last = ((F.size(nodes) + 1) / 2).cast("int") - 1
    pair = lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), last), pair)


def _steps(of: Column, every: int) -> Column:
    """How many levels of a subtree there are to make below the next stored one, in a tree with `of` > 1 nodes here."""
    return F.least(F.length(F.bin(of - 1)), F.lit(every))


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes of a subtree and all levels above them, its own root last."""
    return F.aggregate(
        F.sequence(F.lit(1), steps), F.array(nodes), lambda done, _: F.concat(done, F.array(_level_above(F.element_at(done, -1))))
    )


def _siblings(place: Column, levels: Column, steps: Column) -> Column:
    """For a node of a subtree the sibling on the left or on the right, or neither, level by level."""

    def step(s: Column) -> Column:
        own = F.call_function("shiftright", place, s)
        odd = own % 2 == 1
        beside = F.coalesce(F.get(F.get(levels, s), F.when(odd, own - 1).otherwise(own + 1)), F.lit(""))
        return F.struct(F.when(odd, beside).otherwise("").alias("l"), F.when(odd, "").otherwise(beside).alias("r"))

    return F.transform(F.sequence(F.lit(0), steps - 1), step)


def _subtrees(level: DataFrame, every: int) -> DataFrame:
    """(tree, at, of, nodes): aligned subtrees of a stored level, for trees that go on above it."""
    item = F.struct("at", *[c for c in level.columns if c not in ("tree", "at", "of")])
    return (
        level.filter("of > 1")
        .groupBy("tree", F.call_function("shiftright", F.col("at"), F.lit(every)).alias("above"))
        .agg(F.first("of").alias("of"), F.array_sort(F.collect_list(item)).alias("nodes"))
    )


def stored_levels(leaves: DataFrame, path: str, every: int = EVERY) -> list[DataFrame]:
    """The leaves (tree, at, of, node, ...) and every `every`-th level above them, each written below `path`."""
    spark = leaves.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    levels = [kept(leaves, "level-0")]
    most = levels[0].agg(F.max("of")).first()[0] or 0
    while most > 1:
        made = _levels(F.col("nodes.node"), _steps(F.col("of"), every))
        above = _subtrees(levels[-1], every).select(
            "tree", F.col("above").alias("at"), F.ceil(F.col("of") / F.lit(float(1 << every))).cast("long").alias("of"),
            F.element_at(made, -1)[0].alias("node"),
        )
        levels.append(kept(above, f"level-{len(levels)}"))
        most = -(-most // (1 << every))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, node): what remains of each tree."""
    found = [level.filter("of = 1").select("tree", "node") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(levels: list[DataFrame], tops: DataFrame, every: int = EVERY) -> DataFrame:
    """The leaves with `path`, their siblings up to the root of the tree and on along the tree's own path.

    `tops`: (tree, path, ...) for every tree; its other columns are handed down to the leaves.
    """
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    found = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("tree", "at", "of")]
        alone = level.filter("of = 1").select("tree", "at", *own).join(tops, "tree").select("tree", "at", *own, "path", *extra)
        if found is not None:
            above = found.select("tree", F.col("at").alias("above"), F.col("path").alias("rest"), *extra)
            groups = _subtrees(level, every).join(above, ["tree", "above"])
            steps = _steps(F.col("of"), every)
            groups = groups.select("*", _levels(F.col("nodes.node"), steps).alias("levels"), steps.alias("steps"))
            each = groups.select("*", F.posexplode("nodes").alias("place", "one"))
            path = F.concat(_siblings(F.col("place"), F.col("levels"), F.col("steps")), F.col("rest"))
            below = each.select("tree", "one.at", *[f"one.{c}" for c in own], path.alias("path"), *extra)
            alone = alone.unionByName(below)
        found = alone
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: digest(s["l"], node, s["r"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the trees and of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]
    every: int

    def root(self) -> str | None:
        """The digest of the whole dataset; None for an empty one."""
        found = roots(self.top).first()
        return found["node"] if found else None

    def proofs(self) -> DataFrame:
        """(tree, at, node, id and further leaf columns, path, subroot, root), a row per leaf."""
        start = F.array().cast("array<struct<l:string,r:string>>")
        whole = roots(self.top).select("tree", start.alias("path"), F.col("node").alias("root"))
        tops = paths(self.top, whole, self.every)
        tops = tops.select(F.col("key").alias("tree"), "path", F.col("node").alias("subroot"), "root")
        return paths(self.levels, tops, self.every)


def build(
    docs: DataFrame,
    key: str = "lang",
    id: str = "doc_id",
    fields: tuple[str, ...] = FIELDS,
    path: str | None = None,
    every: int = EVERY,
    **more: Column,
) -> Manifest:
    """Number the leaves of `docs`, write the levels below `path` (a new table path by default) and return them.

    `more` columns are kept next to the leaves, for use with their proofs.
    """
    path = path or new_table_path(docs.sparkSession, "manifest")
    tree = F.coalesce(F.concat(F.lit("="), docs[key].cast("string")), F.lit(""))  # null is no value and comes first
    made = [v.alias(k) for k, v in more.items()]
    rows = docs.select(tree.alias("tree"), docs[id].alias("id"), leaf([docs[f] for f in fields]).alias("node"), *made)
    leaves = numbered(rows, ["tree"], ["id", "node"], "at", "of")
    levels = stored_levels(leaves, f"{path}/rows", every)
    trees = roots(levels).select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), "node")
    top = stored_levels(numbered(trees, ["tree"], ["key"], "at", "of"), f"{path}/trees", every)
    return Manifest(levels, top, every)


def opened(spark: SparkSession, path: str, every: int = EVERY) -> Manifest:
    """A manifest that was built below `path`."""

    def levels(name: str) -> list[DataFrame]:
        found = [spark.read.parquet(f"{path}/{name}/level-0")]
        most = found[0].agg(F.max("of")).first()[0] or 0
        while most > 1:
            found.append(spark.read.parquet(f"{path}/{name}/level-{len(found)}"))
            most = -(-most // (1 << every))
        return found

    return Manifest(levels("rows"), levels("trees"), every)


def verified(proofs: DataFrame, claimed: str = "node") -> DataFrame:
    """Proofs with `folded_root`, made from the digest in `claimed` and the siblings, and whether it is the root."""
    proven = proofs.withColumn("folded_root", folded(F.col(claimed), F.col("path")))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
