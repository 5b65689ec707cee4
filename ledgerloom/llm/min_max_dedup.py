"""Near-duplicate groups by min-max hashing of five-word shingles.

Each permutation gives two values of a document, the smallest and the largest, so 128 permutations make a signature of
256 values for half the hashing. Bands of five values are the blocking keys; a pair at the threshold shares none of the
51 bands with a probability of one in a million. Steps:

1. Documents of equal shingle sets fold into one node (an aggregate), so exact copies cost nothing further.
2. Each band has a head: the node of it that shares most bands with most nodes, in a group of copies what they were
   copied from. Members are laid beside the head; pairs whose sizes or sketches (four bits of each signature value) rule
   the threshold out are left, the others confirmed on full shingle sets. Members far from the head get a second one.
3. Links that don't go through a head: nodes close to the same head but in different components are compared on full
   sets in blocks, which return only the links that connect something.
4. Members far from both heads: each is laid beside all members of the band, and what passes the bounds of size and sketch
   is confirmed one by one, unless these are more pairs than `PAIRS_A_SHINGLE` times the members' shingles. In such
   crowded bands (documents that share a template, say) members are compared by their rare shingles: of two sets at
   the threshold, the rarest quarter of one (and one more) shares a shingle with that of the other. That is exact, and
   shingles of a template are rare in no set that has others. Groups of a rare shingle with more than `FEW` members go
   through blocks as in step 3.
5. Connected components of the confirmed links.

So every pair of a band is either in one component already or is decided on full sets, without all pairs of a large
group being made.

The sketch rules out a pair at the threshold with a probability of about one in 10 million. All joins are equi-joins on
bands or nodes, which adaptive execution splits; nothing is capped and nothing is gathered by group.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; shorter texts than the shingle
are one shingle; long texts are taken whole, a text without blanks being one word; rows that share a doc_id count as one
document; rows without doc_id are linked with nothing and stay; ties are no matter, as links and components are sets;
input columns that clash with results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.text import packed, unpack
from ledgerloom.llm.word_arrays import Words, chunks, mix, runs
from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import materialise

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BAND_ROWS = 128, 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: A sketch has four bits of each signature value. Of the 256 values, a pair of similarity s differs in 240 (1 - s) on
#: average: in 60 at the threshold, with a deviation of 6.8.
MOST_APART = 100
SKETCH_LONGS = 2 * PERMUTATIONS // 16

_rng = np.random.default_rng(75)
_FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND_FACTORS = _rng.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes, offsets): the distinct shingles of some rows, sorted within each row."""
    for row, end, data, offsets in chunks(texts):
        words = Words(data, offsets, lower=True)
        own = []
        for a, b in zip(words.first, words.last, strict=True):
            n = int(b - a)
            own.append(np.unique(runs(words.hashes[a:b], min(k, n), 0 if n >= k else n)) if n else words.hashes[:0])
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        yield row, end, np.concatenate(own), np.concatenate([[0], np.cumsum(sizes)])


SIGNATURE = "doc_id bigint, size bigint, set1 bigint, set2 bigint, bands array<bigint>, sketch array<bigint>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's signature; that of a row without shingles is null."""
    for batch in batches:
        for row, end, hashes, offsets in shingle_sets(batch.column(1)):
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            place = np.full(end - row, -1)
            place[full] = np.arange(len(full))
            at = pa.array(place, mask=place < 0)
            columns = [c.take(at) for c in _signed(hashes, offsets[:-1][full], sizes[full])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row).cast(pa.int64()), pa.array(sizes), *columns],
                names=["doc_id", "size", "set1", "set2", "bands", "sketch"],
            )


def _signed(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Two digests of each set, its bands and its sketch."""
    values = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    set1 = set2 = np.zeros(0, np.uint64)
    if len(starts):
        for p in range(PERMUTATIONS):
            permuted = (hashes ^ _MASKS[p]) * _FACTORS[p]
            np.minimum.reduceat(permuted, starts, out=values[p])
            np.maximum.reduceat(permuted, starts, out=values[PERMUTATIONS + p])
        set1 = np.add.reduceat(mix(hashes), starts)
        set2 = np.bitwise_xor.reduceat(mix(hashes * _FACTORS[1]), starts) ^ sizes.astype(np.uint64)
    banded = mix(values[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS, -1)) * _BAND_FACTORS[None, :, None]
    banded = mix(banded.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * _FACTORS[0])
    nibbles = (mix(values) >> np.uint64(60)).reshape(SKETCH_LONGS, 16, -1)
    sketch = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None]).sum(axis=1, dtype=np.uint64)
    return [
        pa.array(set1.view(np.int64)),
        pa.array(set2.view(np.int64)),
        _lists(np.ascontiguousarray(banded.T).view(np.int64)),
        _lists(np.ascontiguousarray(sketch.T).view(np.int64)),
    ]


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, hashes, offsets in shingle_sets(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists], names=["node", "shingles"])


def _close(a: str, b: str) -> Column:
    """Whether sizes and sketches leave the threshold possible."""
    apart = F.lit(0)
    for i in range(SKETCH_LONGS):
        differs = F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
        for shift in (1, 2):  # gather a value's four bits in its lowest one
            differs = differs.bitwiseOR(F.shiftright(differs, shift))
        apart = apart + F.bit_count(differs.bitwiseAND(F.lit(0x1111111111111111)))
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (100 * small >= PERCENT * large) & (apart <= MOST_APART)


#: Places of the bit map that sorts out most documents which aren't asked for (512 KB), and bits of one part of it.
MAP_PLACES, PART_BITS = 1 << 22, 32768


def _perhaps_among(doc_id: Column, nodes: DataFrame) -> Column:
    """False only for ids that are none of the nodes: their hashes' places in a bit map of fixed size."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_PLACES)).cast("int")
    part, bit = (lambda c: F.floor(c / PART_BITS).cast("int")), (lambda c: c % PART_BITS)
    parts = nodes.groupBy(part(place(F.col("node"))).alias("part")).agg(F.bitmap_construct_agg(bit(place(F.col("node")))).alias("bits"))
    bits = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits")))).scalar()
    own = bit(place(doc_id))
    octet = F.conv(F.hex(F.substr(F.try_element_at(bits, part(place(doc_id))), F.floor(own / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.call_function("shiftright", octet.cast("int"), own % 8) % 2 == 1, F.lit(False))


def _shingles_of(nodes: DataFrame, base: DataFrame) -> DataFrame:
    """node and its full shingle set, for the nodes given. Texts of documents that can't be among them leave the plan before
    the join, so that no exchange of it holds many others."""
    known = materialise(nodes, "asked-for")
    few = base.filter(_perhaps_among(F.col("doc_id"), known))
    texts = few.join(known.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text")
    return materialise(texts.mapInArrow(_sets, "node bigint, shingles array<bigint>"), "shingle-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - shared
    linked = pairs.join(right, "b").join(left, "a").filter(100 * shared >= PERCENT * either)
    return materialise(linked.select("a", "b"), "confirmed")


def _link_block(block: pa.Table) -> pa.Table:
    """Links between nodes of a block that have different roots, left against right, decided on full sets.

    Of the links found, as many are returned as connect what they connect; all others follow from these.
    """
    left, node, root = (block.column(c).to_numpy() for c in ("left", "node", "root"))
    sets = [np.asarray(x.values) for x in block.column("shingles")]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    known, word = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(word, minlength=len(known)) > 1  # a shingle of one set alone is shared with none
    number = np.cumsum(often) - 1
    row = np.zeros(-(-max(1, int(often.sum())) // 64) * 64, bool)
    packed_bits = np.empty((len(sets), len(row) // 64), np.uint64)
    for k, own in enumerate(np.split(word, np.cumsum(sizes)[:-1])):
        row[:] = False
        row[number[own[often[own]]]] = True
        packed_bits[k] = np.packbits(row).view(np.uint64)
    right = np.flatnonzero(~left)
    parent = {int(n): int(n) for n in node}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in np.flatnonzero(left):
        shared = np.bitwise_count(packed_bits[right] & packed_bits[i]).sum(axis=1, dtype=np.int64)
        near = (100 * shared >= PERCENT * (sizes[right] + sizes[i] - shared)) & (root[right] != root[i])
        for j in right[near]:
            x, y = find(int(node[i])), find(int(node[j]))
            if x != y:
                parent[x] = y
                links.append((int(node[i]), int(node[j])))
    ends = list(zip(*links, strict=True)) or [[], []]
    return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})


#: Sets in a side of a block, and shingles in all of them.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: A band is crowded if it has more far members than `FEW`, and so many pairs that its shingles are less to deal with.
FEW, PAIRS_A_SHINGLE = 64, 16


def _links_within(groups: DataFrame, roots: DataFrame, sets: DataFrame, marked: DataFrame) -> DataFrame:
    """Links between members of a group (head, node) that have different roots.

    All but the members of the group's main root are compared with every member, in blocks of about `BLOCK` by `BLOCK`
    sets, or fewer where sets are large, so neither a task nor the result grows with the square of a group.
    """
    sizes = marked.select("node", F.col("of.size").alias("size"))
    rooted = groups.join(roots, "node", "left").select("head", "node", F.coalesce("root", "node").alias("root"))
    rooted = rooted.join(sizes, "node")
    counted = rooted.groupBy("head", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    main = counted.groupBy("head").agg(
        F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main"),
        F.sum("n").alias("all"), F.sum("size").alias("size"),
    )
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    main = main.filter("main.n < all").select(
        "head", F.col("main.root").alias("main"),
        blocks(F.col("all") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("lefts"),
        blocks(F.col("all"), F.col("size")).alias("rights"),
    )
    placed = materialise(rooted.drop("size").join(materialise(main, "mixed-groups"), "head"), "mixed-members")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("root != main").select(
        "head", "node", "root", F.lit(True).alias("left"), own("lefts").alias("i"), every("rights").alias("j")
    )
    right = placed.select(
        "head", "node", "root", F.lit(False).alias("left"), own("rights").alias("j"), every("lefts").alias("i")
    )
    full = left.unionByName(right).join(sets, "node")
    return full.groupBy("head", "i", "j").applyInArrow(_link_block, "a bigint, b bigint")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(s, node): those of each set's shingles by which it meets every set that is similar enough.

    Shingles are ordered by how many sets have them, rarest first. Two sets with `PERCENT` of their union in common share
    one of the first `size - ceil(PERCENT / 100 * size) + 1`. Shingles of one set alone meet none, but take up places.
    """
    tokens = sets.select("node", F.explode("shingles").alias("s"))
    shared = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = lookup_join(tokens, shared, ["s"], "inner").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("known"))
    size = F.size("shingles")
    places = size - F.ceil(size * PERCENT / F.lit(100)).cast("int") + 1 - (size - F.size("known"))
    first = F.slice("known", F.lit(1), F.greatest(places, F.lit(0)))
    return sets.join(known, "node").select("node", F.explode(F.transform(first, lambda k: k["s"])).alias("s"))


def _links_by_rare_shingles(nodes: DataFrame, marked: DataFrame, roots: DataFrame, base: DataFrame) -> DataFrame:
    """Links between nodes of different roots, found by their rare shingles."""
    sets = _shingles_of(nodes, base)
    rare = materialise(_rare_shingles(sets), "rare-shingles")
    groups = rare.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = lookup_join(rare, groups, ["s"], "inner").join(marked.drop("reach"), "node").join(roots, "node", "left")
    placed = materialise(placed.withColumn("root", F.coalesce("root", "node")), "placed-rare")
    few, many = placed.filter(F.col("n") <= FEW), placed.filter(F.col("n") > FEW)
    one, two = ([F.col(c).alias(f"{c}_{side}") for c in ("node", "of", "root")] for side in "ab")
    pairs = few.select("s", *one).join(few.select("s", *two), "s").filter("node_a < node_b AND root_a != root_b")
    pairs = pairs.filter(_close("of_a", "of_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    links = _confirmed(materialise(pairs, "rare-pairs"), sets)
    return links.unionByName(_links_within(many.select(F.col("s").alias("head"), "node"), roots, sets, marked))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of documents."""
    base = packed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = materialise(base.mapInArrow(_signatures, SIGNATURE), "signatures")
    known = signatures.filter("doc_id IS NOT NULL AND size > 0")
    folded = known.groupBy("set1", "set2", "size").agg(F.min("doc_id").alias("node"))
    nodes = materialise(folded, "nodes")
    heads = nodes.withColumn("doc_id", F.col("node"))
    leads = materialise(known.join(heads, ["doc_id", "set1", "set2", "size"]).drop("set1", "set2"), "leads")
    banded = leads.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    shared = materialise(shared.filter("a != b").select("band", "n"), "shared-bands")
    members = materialise(banded.join(shared, "band"), "band-members")

    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    sketches = leads.select("node", F.struct("size", "sketch").alias("of"))
    marked = materialise(reach.join(sketches, "node"), "sketches")
    ranked = members.select("band", "node").join(marked.select("node", "reach"), "node")
    ranked = materialise(ranked, "ranked")

    def led(rows: DataFrame, name: str) -> DataFrame:
        """The member of each band that shares most bands with most nodes: of copies, what they were copied from."""
        best = rows.groupBy("band").agg(F.max(F.struct("reach", "node")).alias("best"))
        return materialise(best.select("band", F.col("best.node").alias("head")), name)

    def close_to(rows: DataFrame) -> DataFrame:
        """Distinct (head, node) that size and sketch leave possible."""
        one = marked.select(F.col("node").alias("head"), F.col("of").alias("of_a"))
        two = marked.select("node", F.col("of").alias("of_b"))
        pairs = rows.filter("node != head").select("head", "node").distinct()
        pairs = pairs.join(two, "node").join(one, "head").filter(_close("of_a", "of_b"))
        return materialise(pairs.select("head", "node"), "close")

    first = ranked.join(led(ranked, "first-heads"), "band")
    close = close_to(first)
    flagged = first.join(close.withColumn("seen", F.lit(True)), ["head", "node"], "left")
    flagged = flagged.withColumn("near", F.col("seen").isNotNull() | (F.col("node") == F.col("head")))
    flagged = materialise(flagged.select("band", "node", "reach", "near"), "flagged")
    second = flagged.join(led(flagged.filter("NOT near"), "second-heads"), "band")
    close_again = close_to(second)
    again = second.join(close_again.withColumn("seen", F.lit(True)), ["head", "node"], "left")
    again = again.withColumn("near_second", F.col("seen").isNotNull() | (F.col("node") == F.col("head")))
    again = materialise(again.select("band", "node", "near", "near_second"), "flagged-again")

    groups = materialise(close.unionByName(close_again).distinct(), "groups")
    sets = _shingles_of(groups.select(F.explode(F.array("head", "node")).alias("node")).distinct(), base)
    links = _confirmed(groups.select(F.col("head").alias("a"), F.col("node").alias("b")), sets)
    roots = components(links, "a", "b")
    whole = groups.unionByName(groups.select("head", F.col("head").alias("node")).distinct())
    within = materialise(_links_within(whole, roots, sets, marked), "links-within")

    placed = again.join(marked.drop("reach"), "node").join(roots, "node", "left")
    placed = materialise(placed.withColumn("root", F.coalesce("root", "node")).select(*again.columns, "of", "root"), "placed")
    one = [F.col(c).alias(f"{c}_a") for c in ("node", "near_second", "of", "root")]
    two = [F.col(c).alias(f"{c}_b") for c in ("node", "near", "near_second", "of", "root")]
    apart = (
        (F.col("root_a") != F.col("root_b"))
        & ~(F.col("near_second_a") & F.col("near_second_b"))
        & (F.col("near_b") | (F.col("node_a") < F.col("node_b")))
    )
    counted = placed.groupBy("band").agg(
        F.count_if(~F.col("near")).alias("far"), F.count(F.lit(1)).alias("n"), F.sum("of.size").alias("size")
    )
    crowded = counted.filter((F.col("far") > FEW) & (F.col("far") * F.col("n") > PAIRS_A_SHINGLE * F.col("size")))
    crowded = materialise(crowded.select("band"), "crowded-bands")
    calm = placed.join(crowded, "band", "left_anti")
    far = calm.filter("NOT near").select("band", *one).join(calm.select("band", *two), "band")
    far = far.filter(apart & _close("of_a", "of_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    far = materialise(far.distinct(), "far-pairs")
    if not far.isEmpty():
        ends = far.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        within = within.unionByName(_confirmed(far, _shingles_of(ends, base)))
    if not crowded.isEmpty():
        nodes_in = placed.join(crowded, "band", "left_semi").select("node").distinct()
        within = within.unionByName(materialise(_links_by_rare_shingles(nodes_in, marked, roots, base), "rare-links"))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(within), "a", "b")

    rows = signatures.select("doc_id", "set1", "set2", "size")
    rows = rows.join(nodes, ["set1", "set2", "size"], "left").join(roots, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    columns = docs.columns
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = materialise(gone, "near-copies")
    base = packed(docs)
    return unpack(base.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"), columns)
