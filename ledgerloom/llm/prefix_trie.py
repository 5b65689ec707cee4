"""Trie of conversation prefixes, by digests of blocks of turns.

Conversations are cut into blocks of `BLOCK` turns. A block's digest, joined with those of the blocks before it, tells
where in the trie the block lies, so conversations are grouped block by block, by digests alone. Blocks that follow
the same blocks (siblings) are compared turn by turn only where there are two or more different ones: turn boundaries are
then refined within these blocks. A block without siblings has one node for each turn, with the block's own members.

Nodes are aggregates of partial sums, so a first turn that a third of all conversations share, or a conversation that
occurs as often, is counted before it is shuffled. Turns are numbered, and digests joined, over ranges of sorted rows, so a
conversation with a third of all turns is many tasks. Sums over subtrees add up within blocks first (each turn's at most
`BLOCK` ancestors there) and then from block to block by doubling the distance each round, which takes as many rounds as
the logarithm of the longest conversation's blocks. Ids of conversations that end at a node are joined in pieces of
`PIECE` ids and digested piece by piece.

Digests are two 64-bit hashes of two seeds; those of successive blocks are joined by exclusive or, each salted with its
place.

Defined cases: rows without conversation are left out; null role or text are empty; turns are ordered null first, and
those of equal number by role and then by the MD5 of the text; repeated rows are turns of their own; an empty role or
text is a turn like others, distinct from no turn; texts are read whole and leave the plan as digest and length;
columns other than the four are not read, whatever their names; an empty table has no conversation and so no node, not
even the root. Of equal conversations the smallest id stands for a node; there are no further ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import bind
from ledgerloom.operators.numbering import PART, POSITION, in_order, numbered
from ledgerloom.session import materialise

BLOCK, PIECE = 4, 4096
SHARED, FAMILY = 6, 100


def _salted(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts) for seed in ("first", "second")]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(SHARED)).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, of, t1, t2, chars): every conversation's turns, numbered from 0, as digests and lengths."""
    c = conversations
    role, text = F.coalesce(c["role"].cast("string"), F.lit("")), F.coalesce(c["text"].cast("string"), F.lit(""))
    rows = c.filter(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), role.alias("role"), F.md5(text).alias("same"),
        F.xxhash64(F.lit("first"), role, text).alias("t1"), F.xxhash64(F.lit("second"), role, text).alias("t2"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return numbered(rows, ["conv_id"], ["turn", "role", "same"], "at", "of").drop("turn", "role", "same")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations, where the first turns come from the first conversation of each family.

    Turns: (conv_id, at, total, t1, t2, chars); conversations, turnless ones too: (conv_id, total).
    """
    sizes = turns.filter("at = 0").select("conv_id", "of")
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = sizes.select("conv_id", "of", head.alias("head"), shared_turns(F.col("conv_id")).alias("h"))
    first = sizes.select(F.col("conv_id").alias("head"), F.col("of").alias("head_of"))
    taken = F.least("h", F.coalesce("head_of", F.lit(0)))
    plan = own.join(first, "head", "left").select("conv_id", "head", "h", taken.alias("taken"), "of")
    total = F.col("taken") + F.greatest(F.col("of") - F.col("h"), F.lit(0))
    plan = materialise(plan.select("*", total.alias("total")), "conversations")
    rest = turns.join(plan.select("conv_id", "h", "taken", "total"), "conv_id").filter("at >= h")
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "total", "t1", "t2", "chars")
    heads = turns.filter(F.col("at") < SHARED - 1).withColumnRenamed("conv_id", "head").drop("of")
    lent = plan.filter("taken > 0").drop("of").join(heads, "head").filter("at < taken")
    lent = lent.select("conv_id", "at", "total", "t1", "t2", "chars")
    return rest.unionByName(lent), plan.select("conv_id", "total")


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, b, total, turns, x1, x2, h1, h2): blocks, their digests (h) and those of all blocks before them (x)."""
    item = F.struct("at", "t1", "t2", "chars")
    cut = turns.groupBy("conv_id", F.floor(F.col("at") / block).cast("long").alias("b")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(item)).alias("turns")
    )
    h1, h2 = _salted("b", F.col("turns.t1"), F.col("turns.t2"))
    stored = in_order(cut.select("*", h1.alias("h1"), h2.alias("h2")), ["conv_id"], ["b"])
    ranges = stored.groupBy(PART, "conv_id").agg(F.bit_xor("h1").alias("r1"), F.bit_xor("h2").alias("r2"))
    earlier = Window.partitionBy("conv_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(PART, "conv_id", *[F.coalesce(F.bit_xor(r).over(earlier), F.lit(0)).alias(r) for r in ("r1", "r2")])
    before = Window.partitionBy(PART, "conv_id").orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
    within = [F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))]
    joined = stored.select("*", *within).join(carried, [PART, "conv_id"])
    return joined.select(
        "conv_id", "b", "total", "turns", "h1", "h2",
        F.col("x1").bitwiseXOR(F.col("r1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("r2")).alias("x2"),
    )


def _keys_within(block: Column) -> Column:
    """(k1, k2, chars) of each turn of a block: the digest of all turns up to it."""

    def one(turn: Column, i: Column) -> Column:
        part = F.slice(block["turns"], 1, i + 1)
        first, second = _salted(block["b"], F.transform(part, lambda t: t["t1"]), F.transform(part, lambda t: t["t2"]))
        k1, k2 = block["x1"].bitwiseXOR(first), block["x2"].bitwiseXOR(second)
        return F.struct(k1.alias("k1"), k2.alias("k2"), turn["chars"].alias("chars"))

    return F.transform(block["turns"], one)


def nodes_of(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, k1, k2, path, x1, x2, conv_id, n_convs, chars): a row per node but the root.

    `path` holds the keys of the node's ancestors within its block, itself last; x is the key of the block's start.
    """
    place = ["b", "x1", "x2"]
    edges = blocks.groupBy(*place, "h1", "h2").agg(
        F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    edges = materialise(edges, "edges")
    siblings = materialise(edges.groupBy(*place).agg(F.count(F.lit(1)).alias("siblings")), "siblings")
    keyed = edges.join(siblings, place).select(
        *place, "siblings", "n_convs", "conv_id", bind(F.struct("b", "x1", "x2", "turns"), _keys_within).alias("keys")
    )
    each = keyed.select("*", F.posexplode("keys").alias("i", "key")).select(
        (F.col("b") * block + F.col("i") + 1).alias("depth"), "key.k1", "key.k2",
        F.transform(F.slice("keys", F.lit(1), F.col("i") + 1), lambda k: F.struct(k["k1"].alias("k1"), k["k2"].alias("k2"))).alias("path"),
        "x1", "x2", "siblings", "conv_id", "n_convs", "key.chars",
    )
    lonely = each.filter("siblings = 1").drop("siblings")
    refined = each.filter("siblings > 1").groupBy("depth", "k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("path", "x1", "x2")],
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("chars").alias("chars"),
    )
    return lonely.unionByName(refined.select(*lonely.columns))


def _sums_below(bounds: DataFrame, deepest: int) -> DataFrame:
    """(k1, k2, depth, leaves, saved): sums over all blocks below each block boundary.

    `bounds`: boundaries with the sums of the one block below each (leaves, saved) and the boundary above each
    (u1, u2). After k rounds a sum covers boundaries less than 2 ** k blocks below, and u is that far above.
    """
    sums = materialise(bounds, "sums")
    reach = 1
    while reach <= deepest:
        above = sums.filter("u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.col("ub").alias("b"))
        more = above.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = sums.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("b").alias("ub"), *[F.col(u).alias(f"far_{u}") for u in ("u1", "u2", "ub")])
        sums = (
            sums.join(more, ["k1", "k2", "b"], "left")
            .select(
                "k1", "k2", "b", "u1", "u2", "ub",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
            .join(jump, ["u1", "u2", "ub"], "left")
            .select("k1", "k2", "b", "leaves", "saved", *[F.col(f"far_{u}").alias(u) for u in ("u1", "u2", "ub")])
        )
        sums = materialise(sums, "sums")
        reach *= 2
    return sums


def digest_of_ids(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of the ascending, comma-joined `conv_id` of each key."""
    placed = numbered(ends, keys, ["conv_id"], "at")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    pieces = placed.groupBy(*keys, F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a key come one after another, so that only the state of one digest is held."""
        open_key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 1)), strict=True):
                if key != open_key:
                    if open_key is not None:
                        done.append((*open_key, state.hexdigest()))
                    open_key, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield _batch(done)
        if open_key is not None:
            yield _batch([(*open_key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(keys) + 1)
        kinds = [pa.int64()] * len(keys) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*keys, "ends_sha256"])

    kind = ", ".join(f"{k} long" for k in keys)
    return ordered.select(*keys, "ids").mapInArrow(run, f"{kind}, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node, the root included, of numbered turns (conv_id, at, total, t1, t2, chars) and (conv_id, total).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = materialise(blocks_of(turns, block), "blocks")
    nodes = nodes_of(blocks, block)
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"))
    key = ["depth", "k1", "k2"]
    up = F.get("path", F.size("path") - 2)
    inner = F.size("path") > 1
    linked = nodes.select(
        *key, "conv_id", "n_convs", "chars", "path", "x1", "x2", (F.col("depth") - 1).alias("p_depth"),
        F.when(inner, up["k1"]).otherwise(F.col("x1")).alias("p1"), F.when(inner, up["k2"]).otherwise(F.col("x2")).alias("p2"),
    )
    children = linked.groupBy(F.col("p_depth").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    none = F.lit(None).cast("long")
    whole = linked.unionByName(
        root.select("*", F.array().cast(linked.schema["path"].dataType).alias("path"), zero.alias("x1"), zero.alias("x2"),
                    none.alias("p_depth"), none.alias("p1"), none.alias("p2"))
    )
    whole = whole.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero))
    leaf = (F.col("n_children") == 0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    whole = materialise(whole.select("*", leaf.alias("leaf"), saved.alias("saved")), "linked")

    # sums within blocks: each node adds to its ancestors in its own block, and to the block's start
    own = whole.filter("depth > 0")
    starts = own.groupBy(F.floor((F.col("depth") - 1) / block).alias("b"), F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    starts = starts.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    bounds = own.filter(F.col("depth") % block == 0).select(
        (F.col("depth") / block).cast("long").alias("b"), "k1", "k2",
        F.col("x1").alias("u1"), F.col("x2").alias("u2"), (F.col("depth") / block - 1).cast("long").alias("ub"), "path",
    )
    linked_bounds = starts.join(bounds.drop("path"), ["b", "k1", "k2"], "left")
    deepest = (whole.agg(F.max("depth")).first()[0] or 1) - 1
    below = _sums_below(linked_bounds, max(0, deepest // block))
    under = bounds.join(below.select("b", "k1", "k2", "leaves", "saved"), ["b", "k1", "k2"])
    given = own.select("depth", "path", F.col("leaf").alias("leaves"), "saved").unionByName(
        under.select((F.col("b") * block).alias("depth"), "path", "leaves", "saved")
    )
    spread = given.select(F.posexplode("path").alias("i", "k"), (F.col("depth") - F.size("path") + 1).alias("top"), "leaves", "saved")
    summed = spread.groupBy((F.col("top") + F.col("i")).alias("depth"), "k.k1", "k.k2").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    whole_root = root.select(*key).join(
        below.filter("b = 0").select("k1", "k2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), ["k1", "k2"], "left"
    )
    summed = summed.unionByName(
        whole_root.select(*key, F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    )

    last = blocks.filter(F.col("total") == F.col("b") * block + F.size("turns")).select(
        F.col("total").alias("depth"), F.col("x1").bitwiseXOR(F.col("h1")).alias("k1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("k2"), "conv_id"
    )
    turnless = conversations.filter("total = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ends = digest_of_ids(last.unionByName(turnless), key)

    parents = whole.select(F.col("depth").alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = whole.join(parents, ["p_depth", "p1", "p2"], "left").join(summed, key).join(ends, key, "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations that take their first turns from the first one of their family."""
    turns, whole = rebuilt(turns_of(conversations))
    return trie(turns, whole, block)


def own_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialise(turns_of(conversations).withColumnRenamed("of", "total"), "turns")
    return trie(turns, turns.filter("at = 0").select("conv_id", "total"), block)
