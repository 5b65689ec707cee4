"""Personal data by fixed patterns and by a semi-Markov conditional random field.

The patterns give the base spans: email, ip, card, phone, each leftmost and non-overlapping, with their checks. The
random field works on islands: stretches of words that hold a digit or an at sign, without which nothing can be an
entity. Every segment of an island of at most `LONGEST` tokens is a candidate for every kind and is scored as a whole
(shape, number and groups of digits, signs, neighbours on both sides); dynamic programming over segment ends picks the
segmentation of the highest score, boundaries and kinds jointly. Spans it finds beside the base spans are added; base
spans stay as they are.

The field is learned by gradient ascent on the likelihood of islands labelled with base spans, from a bounded sample
that is drawn over all documents, kind by kind: of the different islands whose first span is of a kind, the `EXAMPLES`
that come first by a hash, and as many without spans. So rare kinds have examples however many plain numbers there are;
`Field.examples` says how many. Islands are taken whole; those of more than `MOST_TOKENS` tokens, and those with a match
that failed its check (unless it is part of a span), are no examples, so the field decides them by what the others
taught. Every task passes on its own first ones by hash only. Documents are searched whole and where they lie; nothing is
shuffled.

Defined cases: a null or empty text has no spans; without any labelled island nothing is added; texts of any length are
searched whole, in time in proportion to their islands; repeated rows give equal rows and are one example; spans that
start together are listed in the order of kinds; of equal scores the segmentation with later starts and earlier kinds
is taken; other input columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import packed, whole_text
from ledgerloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
EXAMPLES, MOST_TOKENS, EPOCHS, RATE, PENALTY = 80, 200, 6, 0.1, 1e-3

# The base patterns. Local part and numbers begin where their run of characters does.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.DOTALL)
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = int(d) * (1 + n % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def pattern_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans by start and kind, and the matches that failed their check."""
    good, failed = (list(_emails(text)) if "@" in text else []), []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
            (good if valid else failed).append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if len(digits) > 3:
                valid = 12 <= len(digits) <= 19 and luhn(digits)
                (good if valid else failed).append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                valid = 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15
                (good if valid else failed).append((m.start(), m.end(), "phone"))
    good.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return good, failed


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of words with a digit or at sign, one blank apart at most."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        b = _SPACE.search(text, m.end())
        b = b.start() if b else len(text)
        if start >= 0 and a - end <= 1:
            end = b
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _bucket(n: int) -> str:
    return str(n) if n <= 5 else "6-8" if n <= 8 else "9-11" if n <= 11 else "12-19" if n <= 19 else "20+"


def _group(n: int) -> str:
    return str(n) if n <= 4 else "5-8" if n <= 8 else "9-11" if n <= 11 else "12-19" if n <= 19 else "20+"


def _form(token: str) -> str:
    return f"9{_group(len(token))}" if token[0] in "0123456789" else "a" if token[0].isalpha() else token


class Island:
    """Tokens of an island with what segment features need."""

    def __init__(self, text: str, start: int, end: int):
        self.at: list[int] = []
        self.tokens: list[str] = []
        for m in _TOKEN.finditer(text, start, end):
            self.at.append(m.start())
            self.tokens.append(m.group())
        self.at.append(end)
        self.forms = [_form(t) for t in self.tokens]

    def segments(self, end: int) -> Iterator[int]:
        """First tokens of the candidates that end before token `end`."""
        last = self.tokens[end - 1]
        if not (last[0].isalnum() or last == ")"):
            return
        marked = False
        for start in range(end - 1, max(-1, end - 1 - LONGEST), -1):
            token = self.tokens[start]
            if token == "\n":
                return
            marked = marked or token[0] in "0123456789@"
            if marked and (token[0].isalnum() or token in "+("):
                yield start

    def look(self, start: int, end: int) -> tuple[str, ...]:
        """The features of a segment, without its kind."""
        forms, tokens = self.forms, self.tokens
        numbers = [t for t in tokens[start:end] if t[0] in "0123456789"]
        before = forms[start - 1] if start else "^"
        after = forms[end] if end < len(tokens) else "$"
        small = all(len(t) <= 3 and int(t) <= 255 for t in numbers)
        signs = "".join(sorted({t for t in tokens[start:end] if not t[0].isalnum()}))
        return (
            "any",
            "shape " + "".join(forms[start:end]) if end - start <= 8 or "@" not in tokens[start:end] else "long",
            f"digits {_bucket(sum(map(len, numbers)))}",
            f"groups {min(6, len(numbers))} small {small}",
            f"signs {signs}",
            f"before {before[:1]}",
            f"after {after[:1]}",
            f"edges {before[:1]}{forms[start][:1]} {forms[end - 1][:1]}{after[:1]}",
        )


class Field:
    """Weights of kind and feature; the weight of a token outside; the weight of entities side by side."""

    def __init__(self, weights: dict[str, float], examples: dict[str, int] | None = None):
        self.weights, self.examples = weights, examples or {}
        self._scores: dict[tuple[str, ...], tuple[float, ...]] = {}

    def scores(self, look: tuple[str, ...]) -> tuple[float, ...]:
        known = self._scores.get(look)
        if known is None:
            if len(self._scores) > 100_000:
                self._scores.clear()
            get = self.weights.get
            known = self._scores[look] = tuple(sum(get(f"{k}|{f}", 0.0) for f in look) for k in KINDS)
        return known

    def outside(self, form: str) -> float:
        return self.weights.get(f"out|{form}", 0.0)

    @property
    def beside(self) -> float:
        return self.weights.get("beside", 0.0)

    def best(self, island: Island) -> list[tuple[int, int, int]]:
        """First token, end and kind of the entities of the best segmentation. State 1: an entity ended here."""
        n, low = len(island.tokens), -math.inf
        value = [[low, low] for _ in range(n + 1)]
        came: list[list] = [[None, None] for _ in range(n + 1)]
        value[0][0] = 0.0
        for end in range(1, n + 1):
            before = value[end - 1]
            state = int(before[1] > before[0])
            value[end][0] = before[state] + self.outside(island.forms[end - 1])
            came[end][0] = (end - 1, state, None)
            for start in island.segments(end):
                scores = self.scores(island.look(start, end))
                kind = max(range(len(KINDS)), key=scores.__getitem__)
                state = int(value[start][1] + self.beside > value[start][0])
                total = value[start][state] + state * self.beside + scores[kind]
                if total > value[end][1]:
                    value[end][1], came[end][1] = total, (start, state, kind)
        out, end, state = [], n, int(value[n][1] > value[n][0])
        while end:
            start, state_before, kind = came[end][state]
            if kind is not None:
                out.append((start, end, kind))
            end, state = start, state_before
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    most = max(values, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(v - most) for v in values))


def _gradient(field: Field, island: Island, gold: list[tuple[int, int, int]]) -> dict[str, float]:
    """Observed less expected features: forward and backward sums over all segmentations."""
    n, low = len(island.tokens), -math.inf
    segments = [(s, e, island.look(s, e)) for e in range(1, n + 1) for s in island.segments(e)]
    scored = [(s, e, look, field.scores(look)) for s, e, look in segments]
    ending, starting = defaultdict(list), defaultdict(list)
    for x in scored:
        ending[x[1]].append((x[0], _log_sum(list(x[3]))))
        starting[x[0]].append((x[1], _log_sum(list(x[3]))))
    ahead, back = [[low, low] for _ in range(n + 1)], [[low, low] for _ in range(n + 1)]
    ahead[0][0] = 0.0
    for e in range(1, n + 1):
        ahead[e][0] = _log_sum(ahead[e - 1]) + field.outside(island.forms[e - 1])
        ahead[e][1] = _log_sum([_log_sum([ahead[s][0], ahead[s][1] + field.beside]) + v for s, v in ending[e]])
    back[n] = [0.0, 0.0]
    for s in range(n - 1, -1, -1):
        out = back[s + 1][0] + field.outside(island.forms[s])
        entity = _log_sum([back[e][1] + v for e, v in starting[s]])
        back[s] = [_log_sum([out, entity]), _log_sum([out, entity + field.beside])]
    whole = back[0][0]
    change: dict[str, float] = defaultdict(float)
    for e in range(1, n + 1):
        p = math.exp(_log_sum(ahead[e - 1]) + field.outside(island.forms[e - 1]) + back[e][0] - whole)
        change[f"out|{island.forms[e - 1]}"] -= p
    for s, e, look, scores in scored:
        apart, beside = ahead[s][0] + back[e][1] - whole, ahead[s][1] + field.beside + back[e][1] - whole
        for k, v in zip(KINDS, scores, strict=True):
            p, q = math.exp(apart + v), math.exp(beside + v)
            change["beside"] -= q
            for f in look:
                change[f"{k}|{f}"] -= p + q
    covered = {t for s, e, _ in gold for t in range(s, e)}
    for t in range(n):
        if t not in covered:
            change[f"out|{island.forms[t]}"] += 1
    for n_gold, (s, e, k) in enumerate(gold):
        change["beside"] += float(n_gold > 0 and gold[n_gold - 1][1] == s)
        for f in island.look(s, e):
            change[f"{KINDS[k]}|{f}"] += 1
    return change


def _example(text: str) -> tuple[Island, list[tuple[int, int, int]]] | None:
    """An island with its base spans as segments, if the spans end at tokens and no match failed."""
    island, (spans, failed) = Island(text, 0, len(text)), pattern_spans(text)
    failed = [f for f in failed if not any(s[0] <= f[0] and f[1] <= s[1] for s in spans)]  # else parts of a span
    if any(_digits(text, s) >= 7 for s in failed) or any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)):
        return None
    place = {at: n for n, at in enumerate(island.at)}
    gold = [(place.get(s, -1), place.get(e, -1), KINDS.index(k)) for s, e, k in spans]
    if any(s < 0 or e < 0 or s not in island.segments(e) for s, e, _ in gold) or len(island.tokens) > MOST_TOKENS:
        return None
    return island, gold


def _digits(text: str, span: Span) -> int:
    return sum(map(len, _DIGITS.findall(text, span[0], span[1])))


def fit(texts: list[str]) -> Field | None:
    """A field learned from island texts; the same texts give the same field."""
    examples = [e for e in map(_example, texts) if e]
    if not any(gold for _, gold in examples):
        return None
    field, squares = Field({}), defaultdict(float)
    for _ in range(EPOCHS):
        for island, gold in examples:
            field._scores.clear()
            for f, g in _gradient(field, island, gold).items():
                g -= PENALTY * field.weights.get(f, 0.0)
                squares[f] += g * g
                field.weights[f] = field.weights.get(f, 0.0) + RATE * g / (math.sqrt(squares[f]) + 1e-6)
    counts = dict.fromkeys((*KINDS, "none"), 0)
    for _, gold in examples:
        for kind in {KINDS[k] for _, _, k in gold} or {"none"}:
            counts[kind] += 1
    return Field(dict(field.weights), counts)


def _first_islands(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of this task's usable islands the first `most` of each kind by hash, with kind and hash."""
    first: dict[str, dict[int, str]] = defaultdict(dict)
    limit: dict[str, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for a, b in islands(text):
                island = text[a:b]
                rank = int.from_bytes(hashlib.blake2b(island.encode(), digest_size=8).digest(), "big") >> 1
                if all(rank >= limit.get(k, 1 << 63) for k in (*KINDS, "none")):
                    continue
                example = _example(island)
                if example is None:
                    continue
                kind = KINDS[example[1][0][2]] if example[1] else "none"
                if rank < limit.get(kind, 1 << 63):
                    own = first[kind]
                    own[rank] = island
                    if len(own) > most:
                        del own[max(own)]
                        limit[kind] = max(own)
    rows = [(kind, rank, island) for kind, own in first.items() for rank, island in own.items()]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "rank", "island"])


def train(docs: DataFrame, examples: int = EXAMPLES) -> Field | None:
    """A field learned from at most `examples` islands of each kind and as many without spans, of all documents."""
    texts = packed(docs).select(whole_text(F.col("text")).alias("text"))
    drawn = texts.mapInArrow(lambda batches: _first_islands(batches, examples), "kind string, rank bigint, island string")
    drawn = materialise(drawn, "islands")
    found = []
    for kind in (*KINDS, "none"):
        own = drawn.filter(F.col("kind") == kind).select("rank", "island").distinct()
        found += [r["island"] for r in own.orderBy("rank", "island").limit(examples).collect()]
    return fit(found)


def spans_of(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    base, _ = pattern_spans(text)
    if field is None:
        return base, base
    starts, reach, added = [s[0] for s in base], [0], []
    for _, end, _ in base:
        reach.append(max(reach[-1], end))
    for start, end in islands(text):
        island = Island(text, start, end)
        for a, b, kind in field.best(island):
            span = (island.at[a], island.at[b], KINDS[kind])
            if reach[bisect_left(starts, span[1])] <= span[0]:  # no base span that begins before its end reaches it
                added.append(span)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per document: counts of base spans by kind, base spans and all spans as `kind:start:end` lists."""
    weights = None if field is None else field.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if weights is None else Field(weights)
        for batch in batches:
            found = [spans_of(t or "", own) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([_listed(base) for base, _ in found], pa.string()),
                    pa.array([_listed(every) for _, every in found], pa.string()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"],
            )

    return packed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
