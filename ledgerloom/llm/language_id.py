"""Language identification in two steps: the language's family, then the language within it.

Families are told apart by one linear support vector machine each (family against rest, the largest margin wins);
within a family one machine for each pair of its languages decides between the two (one against one), most duels won
wins, and the sum of margins breaks ties. So machines for close relatives learn only what tells these two apart.

Features are the hashed runs of 1 to 4 bytes of the lower-cased text, with everything that is no letter taken as one
blank between words, as shares of the text's length. A margin is then a mean over the text, and scoring needs one look-up
per machine and run, where the documents lie, without a shuffle.

Learning uses a bounded sample: of each language so many documents as `SAMPLE` says on average (chosen by a hash of id
and text), whole texts, for the `LANGUAGES` most frequent languages. Each machine is fitted in a task of its own by dual
coordinate descent; weights are all that reaches the driver.

Labels, source and doc_id are no inputs of a prediction. Defined cases: a text that is null or has no letter is `und`
with score 0, as is every text if nothing was learned; of one learned language every text with a letter is in it, with
score 1; a code that `FAMILIES` doesn't list is a family of its own; equal margins go to the code that comes first; equal
texts get equal results, and repeated rows (equal id and text) are learned once; texts are read whole, whatever
their length, words as long as the text included; input columns that clash with results are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.quality_mil import held_out
from ledgerloom.llm.text import packed, text_of, unpack
from ledgerloom.llm.word_arrays import chunks

SAMPLE, LANGUAGES = 500, 128
ORDERS, BUCKET_BITS = 4, 15
COST, ROUNDS = 300.0, 30
UNKNOWN = "und"

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo yi",
    "romance": "fr es pt it ro ca gl oc co sc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt ug",
    "indo-aryan": "hi ur bn pa gu mr ne si or as",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am ti",
    "austronesian": "id ms tl jv su mg mi",
    "bantu": "sw zu xh rw sn",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def runs_of_bytes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, buckets by order and place, first place of each row) for some rows at a time."""
    lowered = pc.utf8_lower(texts)
    for row, end, data, offsets in chunks(lowered):
        n = end - row
        doc = np.repeat(np.arange(n), np.diff(offsets))
        spaced = np.zeros(len(data) + n, np.uint8)  # each row ends with a blank
        spaced[np.arange(len(data)) + doc] = data
        letter = _LETTER[spaced]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        counts = np.add.reduceat(keep, offsets[:-1] + np.arange(n), dtype=np.int64)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        kept = np.where(letter, spaced, 32)[keep].astype(np.uint32)
        place = np.arange(len(kept)) - np.repeat(firsts[:-1], counts)
        code, buckets = np.zeros(len(kept), np.uint32), np.empty((ORDERS, len(kept)), np.uint32)
        for k in range(ORDERS):
            back = np.full(len(kept), 32, np.uint32)
            back[k:] = kept[: len(kept) - k]
            back[place < k] = 32
            code |= back << np.uint32(8 * k)
            buckets[k] = (code * _FACTORS[k] + np.uint32(k)) >> np.uint32(32 - BUCKET_BITS)
        yield row, end, buckets, firsts


def shares(buckets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one row: its buckets and how often each occurs for a byte of the text."""
    found, counts = np.unique(buckets[:, a:b], return_counts=True)
    return found.astype(np.int32), (counts / max(1, b - a)).astype(np.float32)


def support_vectors(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights, offset last, of a linear machine with squared hinge loss; the same rows in the same order give the same."""
    weights = np.zeros((1 << BUCKET_BITS) + 1)
    last, alpha = 1 << BUCKET_BITS, np.zeros(len(x))
    shift = 1 / (2 * cost)
    squares = np.array([float(v.astype(float) @ v) + 1 + shift for _, v in x])
    rng = np.random.default_rng(12)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(x)):
            found, value = x[i]
            slope = y[i] * (weights[found] @ value + weights[last]) - 1 + shift * alpha[i]
            new = max(alpha[i] - slope / squares[i], 0.0)
            step, alpha[i] = (new - alpha[i]) * y[i], new
            if step:
                weights[found] += step * value
                weights[last] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


@dataclass
class Model:
    """Learned codes by family, the families' machines, and those of pairs of languages (positive: the first)."""

    families: dict[str, list[str]] = field(default_factory=dict)
    rest: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, buckets: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and scores of rows that have letters; anything for others."""
        n, names = len(firsts) - 1, sorted(self.families)
        everyone = np.arange(n)
        if len(names) > 1:
            margins = np.stack([_margins(self.rest[f], buckets, firsts, everyone) for f in names])
            family = margins.argmax(0)
            ranked = np.sort(margins, axis=0)
            score = _sure((ranked[-1] - ranked[-2]) / 2)
        else:
            family, score = np.zeros(n, int), np.ones(n)
        lang = np.empty(n, object)
        for f, name in enumerate(names):
            rows, codes = np.flatnonzero(family == f), self.families[name]
            won, lead = np.zeros((len(codes), len(rows))), np.zeros((len(codes), len(rows)))
            sure = np.zeros((len(codes), len(rows)))
            for a, b in combinations(range(len(codes)), 2):
                m = _margins(self.pairs[codes[a], codes[b]], buckets, firsts, rows)
                for side, sign in ((a, m), (b, -m)):
                    won[side] += sign >= 0 if side == a else sign > 0
                    lead[side] += sign
                    sure[side] += _sure(sign)
            best = np.lexsort((-np.arange(len(codes))[:, None] + 0 * won, lead, won), axis=0)[-1]
            lang[rows] = np.array(codes, object)[best]
            if len(codes) > 1:
                score[rows] *= sure[best, np.arange(len(rows))] / (len(codes) - 1)
        return lang, score


def _margins(weights: np.ndarray, buckets: np.ndarray, firsts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sizes = firsts[rows + 1] - firsts[rows]
    out = np.full(len(rows), weights[-1])
    some = sizes > 0
    if not some.any():
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    at = slice(None) if len(rows) == len(firsts) - 1 else np.repeat(firsts[rows[some]] - starts, sizes[some]) + np.arange(sizes.sum())
    total = weights[buckets[0][at]]
    for one in buckets[1:]:
        total = total + weights[one[at]]
    out[some] += np.add.reduceat(total, starts) / sizes[some]
    return out


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model learned from the documents with a language that are not held out."""
    usable = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"))
    usable = usable.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")) & has_letter(F.col("text")))
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counted:
        return Model()
    families: dict[str, list[str]] = {}
    for code in sorted(r["lang"] for r in counted):
        families.setdefault(family_of(code), []).append(code)
    wanted = F.create_map(*[F.lit(v) for r in counted for v in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / float(1 << 53)
    chosen = usable.filter(drawn < F.get(F.array(wanted[F.col("lang")]), F.lit(0)))
    jobs = {("", name): [c for codes in families.values() for c in codes] for name in families if len(families) > 1}
    jobs |= {pair: list(pair) for codes in families.values() for pair in combinations(codes, 2)}
    if not jobs:
        return Model(families)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buckets, firsts in runs_of_bytes(batch.column(1)):
                made = [shares(buckets, a, b) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row),
                        pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary()),
                    ],
                    names=["lang", "same", "found", "value"],
                )

    rows = chosen.select("lang", "text", F.concat_ws(" ", F.col("id").cast("string"), F.xxhash64("text").cast("string")).alias("same"))
    vectors = rows.mapInArrow(sparse, "lang string, same string, found binary, value binary").dropDuplicates(["lang", "same"])
    uses = F.create_map(*[
        x for code in sorted({c for cs in jobs.values() for c in cs})
        for x in (F.lit(code), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for (a, b), cs in jobs.items() if code in cs]))
    ])
    dealt = vectors.select("*", F.explode(uses[F.col("lang")]).alias("job")).select("lang", "same", "found", "value", "job.*")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["same", "lang"])
        a, b = rows["a"].iloc[0], rows["b"].iloc[0]
        x = [
            (np.frombuffer(f, np.int32), np.frombuffer(v, np.float32))
            for f, v in zip(rows["found"], rows["value"], strict=True)
        ]
        first = [lang == a if a else family_of(lang) == b for lang in rows["lang"]]
        weights = support_vectors(x, np.where(first, 1.0, -1.0)).astype(np.float32)
        return pd.DataFrame({"a": [a], "b": [b], "weights": [weights.tobytes()]})

    model = Model(families)
    for r in dealt.groupBy("a", "b").applyInPandas(fit, "a string, b string, weights binary").collect():
        weights = np.frombuffer(bytes(r["weights"]), np.float32)
        if r["a"]:
            model.pairs[r["a"], r["b"]] = weights
        else:
            model.rest[r["b"]] = weights
    zero = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    for a, b in jobs:  # none is missing unless the draw took no document of its languages
        (model.pairs.setdefault((a, b), zero) if a else model.rest.setdefault(b, zero))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `lang_pred` and `score` (0 to 1)."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for first, end, buckets, firsts in runs_of_bytes(text_of(rows)):
                lang, score = model.predict(buckets, firsts)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(first, end - first), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=["row", "own_lang", "own_score"],
                )

    base = packed(docs).select("row")
    kind = f"row {base.schema['row'].dataType.simpleString()}, own_lang string, own_score double"
    told = base.mapInArrow(run, kind) if model.families else base.select("row", F.lit(None).alias("own_lang"), F.lit(0.0).alias("own_score"))
    text = next(f.name for f in base.schema["row"].dataType.fields if f.name.lower() == "text")
    known = has_letter(F.col(f"row.`{text}`")) & F.col("own_lang").isNotNull()
    return unpack(
        told, columns,
        lang_pred=F.when(known, F.col("own_lang")).otherwise(UNKNOWN), score=F.when(known, F.col("own_score")).otherwise(0.0),
    )
