"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from what its words and characters look like, gated
attention weighs the passages of a document, and the weighted representation is scored. Encoder, attention and scorer
are learned together from document labels, by gradient descent on the log loss.

Learning uses a bounded sample: the `SAMPLE` labelled documents that come first by a hash of doc_id, each with at most
`MOST_PASSAGES` evenly spaced passages. Their bags are all that reaches the driver (`SAMPLE * MOST_PASSAGES` short
vectors at most). Scoring takes every passage of every document, where the documents lie, without a shuffle.

Labels, language, source and doc_id are no inputs of a score. Defined cases: a null, empty or blank text is one passage
without words; a document labelled twice counts twice; labels that are null are left out; without labels of both kinds
every score is the share of label 1 (0.5 without labels); repeated rows get equal scores; input columns that clash with
results are replaced; a text of any length is scored by all its passages, a word of any length being one word; a score
exactly at the threshold is accepted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import packed, text_of, unpack
from ledgerloom.llm.word_arrays import IS_BLANK, Words, chunks

PASSAGE = 64
SAMPLE, MOST_PASSAGES = 4000, 32
HIDDEN, GATES = 16, 8
STEPS, RATE, DECAY = 200, 0.03, 1e-4
THRESHOLD = 0.7

_CLASSES = np.zeros((7, 256), np.float32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 97:123] = 1  # small letters
_CLASSES[2, 48:58] = 1  # digits
_CLASSES[3, [ord(c) for c in "#*$%&|<>@^~=_+\\/{}[]"]] = 1
_CLASSES[4, [ord(c) for c in ".,;:?'\"()-"]] = 1
_CLASSES[5, ord("!")] = 1
_CLASSES[6, 128:] = 1
FEATURES = len(_CLASSES) + 10


def passages(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, features of all passages, first passage of each row and their number)."""
    for row, end, data, offsets in chunks(texts):
        words = Words(data, offsets)
        counts = np.maximum(1, -(-(words.last - words.first) // PASSAGE))
        firsts = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros((firsts[-1], FEATURES), np.float32)
        out[:, -1] = 1
        if len(words.hashes):
            _describe(out, data, words, np.repeat(np.arange(end - row), words.last - words.first), firsts)
        yield row, end, out, firsts


def _describe(out: np.ndarray, data: np.ndarray, words: Words, doc: np.ndarray, firsts: np.ndarray) -> None:
    """Fill in the features of the passages that have words."""
    n = len(words.hashes)
    place = np.arange(n) - words.first[doc]
    passage = firsts[doc] + place // PASSAGE
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[heads]
    size = np.diff(np.append(heads, n)).astype(np.float32)
    bounds = words.starts[heads]
    chars = np.add.reduceat(~IS_BLANK[data], bounds, dtype=np.int64).astype(np.float32)
    for k, members in enumerate(_CLASSES):
        out[own, k] = np.add.reduceat(members[data], bounds) / chars
    c = len(_CLASSES)
    lengths = (words.ends - words.starts).astype(np.float32)
    out[own, c] = np.add.reduceat(lengths, heads) / size / 8
    out[own, c + 1] = np.add.reduceat((lengths <= 3).astype(np.float32), heads) / size
    out[own, c + 2] = np.add.reduceat((lengths > 14).astype(np.float32), heads) / size
    order = np.lexsort((words.hashes, doc))
    same = (words.hashes[order][1:] == words.hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(n, np.float32)
    again[order[1:][same]] = 1
    out[own, c + 3] = np.add.reduceat(again, heads) / size
    pairs = words.hashes.copy()
    pairs[:-1] ^= words.hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((pairs, passage))
    same = (pairs[order][1:] == pairs[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    twice = np.zeros(n, np.float32)
    twice[order[1:][same]] = 1
    out[own, c + 4] = np.add.reduceat(twice, heads) / size
    neighbour = np.zeros(n, np.float32)
    neighbour[1:] = words.hashes[1:] == words.hashes[:-1]
    out[own, c + 5] = np.add.reduceat(neighbour, heads) / size
    symbol_end = _CLASSES[3][data[words.ends - 1]] + _CLASSES[5][data[words.ends - 1]]
    out[own, c + 6] = np.add.reduceat(symbol_end, heads) / size
    out[own, c + 7] = np.minimum(1, size / PASSAGE)
    out[own, c + 8] = np.add.reduceat(data == 10, bounds, dtype=np.int64) / size


class Net:
    """Encoder, gated attention and scorer; `weights` maps names to arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, share: float = 0.5):
        rng = np.random.default_rng(8)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.share, self.trained = share, weights is not None
        self.weights = weights or {
            "centre": np.zeros(FEATURES), "scale": np.ones(FEATURES),
            "encode": small(FEATURES, HIDDEN), "encode0": np.zeros(HIDDEN),
            "look": small(HIDDEN, GATES), "gate": small(HIDDEN, GATES), "attend": small(GATES, 1)[:, 0],
            "score": small(HIDDEN, 1)[:, 0], "score0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - w["centre"]) / w["scale"]
        h = np.tanh(x @ w["encode"] + w["encode0"])
        look, gate = np.tanh(h @ w["look"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        raw = (look * gate) @ w["attend"]
        starts, sizes = firsts[:-1], np.diff(firsts)
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        attention = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))
        return {"x": x, "h": h, "look": look, "gate": gate, "attention": attention, "z": z, "p": p}

    def gradients(self, f: dict[str, np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(labels)
        out = (f["p"] - labels) / n
        dz = np.repeat(out[:, None] * w["score"], sizes, axis=0)
        da = (dz * f["h"]).sum(1)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        draw = f["attention"] * (da - np.repeat(np.add.reduceat(f["attention"] * da, starts), sizes))
        dlook = draw[:, None] * w["attend"] * f["gate"] * (1 - f["look"] ** 2)
        dgate = draw[:, None] * w["attend"] * f["look"] * f["gate"] * (1 - f["gate"])
        dh = f["attention"][:, None] * dz + dlook @ w["look"].T + dgate @ w["gate"].T
        dh *= 1 - f["h"] ** 2
        return {
            "encode": f["x"].T @ dh, "encode0": dh.sum(0), "look": f["h"].T @ dlook, "gate": f["h"].T @ dgate,
            "attend": (f["look"] * f["gate"]).T @ draw, "score": f["z"].T @ out, "score0": np.array([out.sum()]),
        }

    def scores(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return self.forward(x, firsts)["p"] if self.trained else np.full(len(firsts) - 1, self.share)


def fit(x: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> Net:
    """A net fitted to bags; the same bags in the same order give the same net."""
    if len(set(labels.tolist())) < 2:
        return Net(share=float(labels.mean()) if len(labels) else 0.5)
    net, sizes = Net(), np.diff(firsts)
    net.weights["centre"], net.weights["scale"] = x.mean(0), x.std(0) + 1e-3
    first = {k: 0.0 for k in net.weights}
    second = {k: 0.0 for k in net.weights}
    for step in range(1, STEPS + 1):
        for k, g in net.gradients(net.forward(x, firsts), sizes, labels).items():
            g = g + DECAY * net.weights[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return Net(net.weights)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept apart from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """A net learned from the labelled documents that are not held out."""
    usable = labels.select(labels["doc_id"].alias("labelled"), labels["quality"].cast("int").alias("label"))
    usable = usable.filter(F.col("label").isin(0, 1) & F.col("labelled").isNotNull() & ~held_out(F.col("labelled")))
    chosen = usable.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, x, firsts in passages(batch.column(2)):
                bag = []
                for a, b in zip(firsts[:-1], firsts[1:], strict=True):
                    some = np.unique(np.linspace(a, b - 1, min(b - a, MOST_PASSAGES)).round().astype(int))
                    bag.append(x[some].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(bag, pa.binary())],
                    names=["labelled", "label", "bag"],
                )

    base = packed(docs).select(F.col("doc_id").cast("long"), "text")
    few = F.broadcast(chosen.select(F.col("labelled").cast("long"), "label"))  # at most `sample` rows
    found = base.join(few, F.col("doc_id") == F.col("labelled")).select("labelled", "label", "text")
    rows = found.mapInArrow(bags, "labelled bigint, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["labelled"], r["label"], bytes(r["bag"])))
    bagged = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    if not bagged:
        return Net()
    firsts = np.concatenate([[0], np.cumsum([len(b) for b in bagged])])
    return fit(np.concatenate(bagged).astype(np.float64), firsts, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """The documents with `score` (0 to 1) and `predicted`."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for first, end, x, firsts in passages(text_of(rows)):
                scored = pa.array(net.scores(x, firsts))
                yield pa.RecordBatch.from_arrays([rows.slice(first, end - first), scored], names=["row", "own_score"])

    base = packed(docs).select("row")
    scored = base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, own_score double")
    predicted = (F.col("own_score") >= THRESHOLD).cast("int")
    return unpack(scored, columns, score=F.col("own_score"), predicted=predicted)
