"""Removal of passages of 35 words that stand anywhere else, by compressed full-text indexes.

A window of 35 words has an anchor: of its runs of eight words the one with the smallest hash. Equal windows have equal
anchors, so the anchor decides in which shard a window is looked up, and each window meets all its equals there without
any document being compared with every shard. Consecutive windows with the same anchor make a segment.

1. Segments are counted by anchor, with the smallest and largest hash of their words. An anchor that occurs once is done;
   one whose segments are all equal is repeated as a whole.
2. Of the others, equal segments fold into one with a count. Folded segments are repeated; of those left alone the words
   are fetched, together with the other segments of their anchor.
3. Each shard builds an FM-index over its segments (suffix order, Burrows-Wheeler transform, wavelet matrix) and streams
   the lonely segments through it: backward search yields for each window whether its words occur twice.
4. An anchor with more than `CROWD` different segments would not fit a shard; its windows are counted by a hash of their
   words instead, each with its partial sums, which is as exact.
5. Masks of repeated windows go back to the segments' documents, and words under a repeated window are cut.

Words are compared by 64-bit hashes, segments by two of them. Counts are summed up before they are shuffled, and joins
are equi-joins that adaptive execution splits, so a passage that a third of all documents share is no hot task.

Defined cases: a null text has no words; windows are judged on the input, not on what is left; rows that repeat doc_id
and text are rows of their own and cut each other's words; a text without removals is its words joined by single
blanks; whole texts are searched, a text without blanks being one word; of windows with equal words none comes first: all
are removed; input columns named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.fm_index import Index, repeated_windows
from ledgerloom.llm.text import packed, row_key, unpack
from ledgerloom.llm.word_arrays import Words, chunks, mix, runs
from ledgerloom.session import materialise

WINDOW, ANCHOR = 35, 8
SPAN = WINDOW - ANCHOR + 1  # runs of a window among which its anchor is chosen, and most windows of a segment
CROWD = 2000
SHARD_WORDS = 400_000

_BASE = 0x9E6C63D0876A9A47 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some rows: row, first word within the row, number of windows, anchor hash and content hash of each segment."""
    hashes, n = words.hashes, len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchors = runs(hashes, ANCHOR, 4)
    seen = np.lib.stride_tricks.sliding_window_view(anchors, SPAN)
    place = np.concatenate([seen[i : i + 65536].argmin(axis=1) for i in range(0, len(seen), 65536)])
    place = place + np.arange(len(place))  # the anchor of the window that begins at each word
    row = np.repeat(np.arange(len(words.first)), words.last - words.first)[: len(place)]
    whole = np.arange(len(place)) + WINDOW <= words.last[row]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at][1:] != place[at][:-1]) | (row[at][1:] != row[at][:-1])
    heads = np.flatnonzero(new)
    begin, count = at[heads], np.diff(np.append(heads, len(at)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    end = begin + count + WINDOW - 1
    content = (total[end] - total[begin]) * _powers(_UNBASE, n)[begin]
    content = mix(content + count.astype(np.uint64))
    return row[begin], begin - words.first[row[begin]], count, anchors[place[begin]], content


SEGMENT = "row_id bigint, row_hash bigint, start int, windows int, anchor bigint, content bigint"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch.column(0), batch.column(1)
        for first, end, data, offsets in chunks(batch.column(2)):
            row, start, count, anchor, content = segments(Words(data, offsets))
            at = pa.array(first + row)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at),
                    tags.take(at),
                    pa.array(start.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(content.view(np.int64)),
                ],
                names=["row_id", "row_hash", "start", "windows", "anchor", "content"],
            )


WORDS = "anchor bigint, content bigint, alone boolean, crowded boolean, windows int, words array<bigint>"


def _segment_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the segments wanted of them: the words of these segments, as hashes."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        for first, end, data, offsets in chunks(batch.column(0)):
            words = Words(data, offsets)
            parts, rows = [], []
            for r in range(end - first):
                for s in wanted[first + r]:
                    a = int(words.first[r]) + s["start"]
                    parts.append(words.hashes[a : a + s["windows"] + WINDOW - 1])
                    rows.append((s["anchor"], s["content"], s["alone"], s["crowded"], s["windows"]))
            if rows:
                sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts).view(np.int64)))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists], names=["anchor", "content", "alone", "crowded", "windows", "words"]
                )


def _search_shard(shard: pa.Table) -> pa.Table:
    """Masks of the repeated windows of a shard's lonely segments, by backward search in the shard's index."""
    lists = shard.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
    ends = np.cumsum(sizes)
    symbols = np.unique(flat, return_inverse=True)[1] + 1
    index = Index(symbols, ends)
    alone = shard.column("alone").to_numpy()
    windows = np.where(alone, shard.column("windows").to_numpy(), 0)
    masks = repeated_windows(index, symbols, ends - sizes, windows, WINDOW)
    hit = pa.array(np.flatnonzero(masks))
    return pa.table(
        {
            "anchor": shard.column("anchor").take(hit),
            "content": shard.column("content").take(hit),
            "mask": pa.array(masks[masks != 0]),
        }
    )


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of crowded segments, by two hashes of its words."""
    for batch in batches:
        lists = batch.column(2).to_pylist()
        parts = [np.array(words, np.int64).view(np.uint64) for words in lists]
        counts = [len(p) - WINDOW + 1 for p in parts]
        at = pa.array(np.repeat(np.arange(len(parts)), counts))
        one = np.concatenate([runs(p, WINDOW) for p in parts] or [np.zeros(0, np.uint64)])
        two = np.concatenate([runs(mix(p), WINDOW, 1) for p in parts] or [np.zeros(0, np.uint64)])
        place = np.concatenate([np.arange(c) for c in counts] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                batch.column(3).take(at),
                pa.array(place.astype(np.int32)),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
            ],
            names=["anchor", "content", "alone", "place", "h1", "h2"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts less the words under repeated windows."""
    for batch in batches:
        texts, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out, before, removed = [], [], []
        for text, marked in zip(texts, marks, strict=True):
            words = (text or "").encode().split()
            before.append(len(words))
            if marked:
                cover = np.zeros(len(words) + 1, np.int64)
                for m in marked:
                    for j in range(SPAN):
                        if m["mask"] >> j & 1:
                            cover[m["start"] + j] += 1
                            cover[m["start"] + j + WINDOW] -= 1
                stay = np.cumsum(cover)[:-1] == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            removed.append(before[-1] - len(words))
            out.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())],
            names=["row", "kept_text", "before", "removed"],
        )


def repeated_segments(base: DataFrame) -> DataFrame:
    """row_id, row_hash, start and mask of the segments with repeated windows. base: row_id, row_hash, text."""
    every = F.expr("shiftleft(1L, windows) - 1")
    segs = base.mapInArrow(_segments, SEGMENT)
    anchors = segs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"), F.min("content").alias("least"), F.max("content").alias("most")
    )
    anchors = anchors.filter("times > 1").select("anchor", (F.col("least") == F.col("most")).alias("uniform"))
    hits = materialise(segs.join(materialise(anchors, "anchors"), "anchor"), "segment-hits")

    first = F.min(F.struct("row_id", "row_hash", "start", "windows")).alias("first")
    folded = hits.filter("NOT uniform").groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("times"))
    folded = materialise(folded, "folded")
    kinds = folded.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("different"), F.count_if(F.col("times") == 1).alias("lonely")
    )
    kinds = kinds.filter("lonely > 0").select("anchor", (F.col("different") > CROWD).alias("crowded"))
    wanted = folded.join(materialise(kinds, "open-anchors"), "anchor").select(
        "first.row_id",
        "first.row_hash",
        F.struct(
            "anchor", "content", (F.col("times") == 1).alias("alone"), "crowded", "first.start", "first.windows"
        ).alias("segment"),
    )
    by_row = wanted.groupBy("row_id", "row_hash").agg(F.collect_list("segment").alias("wanted"))
    texts = base.join(by_row, ["row_id", "row_hash"]).select("text", "wanted")
    words = materialise(texts.mapInArrow(_segment_words, WORDS), "segment-words")

    size = words.filter("NOT crowded").agg(F.sum(F.size("words"))).first()[0] or 0
    shards = -(-size // SHARD_WORDS) or 1
    sharded = words.filter("NOT crowded").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = sharded.groupBy("shard").applyInArrow(_search_shard, "anchor bigint, content bigint, mask bigint")

    crowd = words.filter("crowded").select("anchor", "content", "words", "alone")
    single = crowd.mapInArrow(
        _window_hashes, "anchor bigint, content bigint, alone boolean, place int, h1 bigint, h2 bigint"
    )
    single = materialise(single, "crowd-windows")
    twice = single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h1", "h2")
    marked = single.filter("alone").join(twice, ["h1", "h2"]).groupBy("anchor", "content")
    crowd_found = marked.agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))

    masks = materialise(found.unionByName(crowd_found), "masks")
    lonely = folded.filter("times = 1").select(
        "first.row_id", "first.row_hash", "first.start", "anchor", "content"
    )
    lonely = lonely.join(masks, ["anchor", "content"]).select("row_id", "row_hash", "start", "mask")
    repeated = folded.filter("times > 1").select("anchor", "content")
    uniform = hits.filter("uniform").select("row_id", "row_hash", "start", every.alias("mask"))
    folded_hits = hits.filter("NOT uniform").join(repeated, ["anchor", "content"])
    folded_hits = folded_hits.select("row_id", "row_hash", "start", every.alias("mask"))
    return uniform.unionByName(folded_hits).unionByName(lonely)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with `text` cut, `n_words` before and `n_removed`."""
    columns = docs.columns
    base = packed(docs)
    keyed = base.select("row", "text", *row_key(F.col("doc_id"), F.col("text")))
    marks = repeated_segments(keyed.select("row_id", "row_hash", "text"))
    by_row = marks.groupBy("row_id", "row_hash").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    joined = keyed.join(by_row, ["row_id", "row_hash"], "left").select("row", "text", "marks")
    kind = base.schema["row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut, f"row {kind}, kept_text string, before bigint, removed bigint")
    results = {"text": F.col("kept_text"), "n_words": F.col("before"), "n_removed": F.col("removed")}
    return unpack(cut, columns, **results)
