"""Encoding and decoding with a SentencePiece model as a weighted transducer.

Compiling reads the model once: the normaliser (its character map as a transducer of prefixes, longest first; blanks
become the mark of a word's start, one is put in front, runs and ends are squeezed if the model says so), an arc for each
piece, and arcs of single bytes for characters without a piece. An input is composed with it as a lattice:
states are positions with the piece that led there, arcs are pieces with weights in the tropical semiring (weights are
added along a path, the least path counts).

* A unigram model weighs an arc by the negative score of its piece.
* A merge (BPE) model weighs a piece after another by 0 if merging the two pieces' text gives just these two pieces, and
  by infinity otherwise. The encoding by merges is the one path whose neighbours all fit, so it is the only path of
  finite weight, and each position has at most one state of finite weight.

No piece has a word mark behind another character, so words (with the run of blanks before them) are independent inputs;
their paths are remembered in a dictionary of bounded size. Documents are encoded where they lie; nothing is shuffled.
The search takes time in proportion to the text, words and runs of blanks of any length included.

Models with user-defined pieces, with marks at the end of words or inside pieces, and merge models with unused pieces are
refused when they are compiled.

Defined cases: of paths of equal weight the one found first is taken, which starts with the longer piece; a null text is an empty one; an empty text has no ids; repeated rows are encoded one by one; the mark
itself in a text reads as a blank, so such a text doesn't come back; input columns named like a result are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import packed, text_of, unpack

MARK = "▁"
MOST_MODEL_BYTES = 64 << 20
REMEMBERED = 600_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, kind of model and normaliser of a serialised SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                self.kind = own.get(3, UNIGRAM)
                if own.get(24):
                    raise ValueError("word marks at the end of words are not supported")
            elif field == 3:
                own = dict(_fields(value))
                charsmap = own.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        self.charsmap = charsmap
        if not self.escape:
            raise ValueError("models that keep blanks as they are are not supported")
        if USER_DEFINED in self.types or (UNUSED in self.types and self.kind == MERGES):
            raise ValueError("user-defined pieces, and unused ones of merge models, are not supported")
        if any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL):
            raise ValueError("a piece spans two words")


class Normaliser:
    """The character map as a transducer from prefixes of a text to what replaces them, then blanks.

    The map is a trie in an array of 32-bit units: bits 0 to 7 and 31 hold the label, bit 8 tells that a value follows,
    and the rest, shifted by 8 if bit 9 is set, is the exclusive-or distance to the children. A value is the place of
    the replacement in a block of zero-ended strings.
    """

    def __init__(self, model: Model):
        self.prefix, self.squeeze = model.prefix, model.squeeze
        self.units, self.strings = np.zeros(0, np.uint32).tolist(), b""
        if model.charsmap:
            size = int.from_bytes(model.charsmap[:4], "little")
            self.units = np.frombuffer(model.charsmap[4 : 4 + size], "<u4").tolist()
            self.strings = model.charsmap[4 + size :]
        self.same = not self.units and not self.squeeze  # nothing but blanks is changed

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix."""
        found, place = None, (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
        for end in range(at, len(data)):
            place ^= data[end]
            unit = self.units[place]
            if unit & 0x800000FF != data[end]:
                break
            place ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[place] & 0x7FFFFFFF
                found = end + 1 - at, self.strings[value : self.strings.index(0, value)]
        return found

    def mapped(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            found = self._longest(data, at)
            if found is None:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = size, data[at : at + size]
            out.append(found[1])
            at += found[0]
        return b"".join(out).decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        """The text with blanks in place of marks, and a blank in front where the model asks for one."""
        text = self.mapped(text.replace(MARK, " ") if not self.units else text).replace(MARK, " ")
        if self.squeeze:
            text = " ".join(part for part in text.split(" ") if part)
        return " " + text if self.prefix and text else text


class Transducer:
    """A compiled model."""

    def __init__(self, data: bytes):
        model = self.model = Model(data)
        self.normalise = Normaliser(model)
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [i for i, t in enumerate(model.types) if t == BYTE]
        if len(self.bytes) not in (0, 256):
            raise ValueError("the model has some bytes but not all")
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.unknown_weight = 10.0 - min((model.scores[i] for i in self.ids.values()), default=0.0)
        self._trees: dict[int, tuple | None] = {}
        self._fits: dict[int, bool] = {}
        self._reach: dict[str, int] = {}  # the longest piece by its first two characters
        for piece in self.ids:
            self._reach[piece[:2]] = max(self._reach.get(piece[:2], 1), len(piece))
        self.words = _Remembered(lambda w: self._packed(MARK + w))
        self.bare = _Remembered(self._packed)
        self.text_of = [self._decoded(i) for i in range(len(model.pieces))]

    # --- arcs ---------------------------------------------------------------------------------------------------

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[tuple]:
        """Merging by best score first, the leftmost of equals: trees (text, score or None, left, right)."""
        parts: list[tuple | None] = [(c, None, None, None) for c in text]
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = parts[i][0] + parts[after[i]][0]
                piece = self.ids.get(both)
                if piece is not None:
                    heapq.heappush(waiting, (-self.model.scores[piece], i, both))

        for i in range(len(parts)):
            offer(i)
        while waiting:
            weight, i, both = heapq.heappop(waiting)
            j = after[i]
            if parts[i] is None or j < 0 or parts[i][0] + parts[j][0] != both:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = (both, -weight, parts[i], parts[j]), None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _tree(self, piece: int) -> tuple | None:
        """(right edge, left edge) of how merges make the piece: (text, made at, used up at), None if they don't.

        Times are negative scores; they must rise from part to whole, else there are no edges and pairs are merged out.
        """
        if piece not in self._trees:
            parts = self.merged(self.model.pieces[piece])
            self._trees[piece] = None
            if len(parts) == 1:
                self._trees[piece] = tuple(_edge(parts[0], side) for side in (3, 2))
        return self._trees[piece]

    def fits(self, first: int, second: int) -> bool:
        """Whether merging the text of two pieces gives these two."""
        key = first << 32 | second
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._merge_apart(first, second)
        return known

    def _merge_apart(self, first: int, second: int) -> bool:
        one, two = self._tree(first), self._tree(second)
        if one is None or two is None:
            return False
        if not one[0] or not two[1]:
            texts = [p[0] for p in self.merged(self.model.pieces[first] + self.model.pieces[second])]
            return texts == [self.model.pieces[first], self.model.pieces[second]]
        for a, a_made, a_used in one[0]:
            for b, b_made, b_used in two[1]:
                if max(a_made, b_made) < min(a_used, b_used):
                    both = self.ids.get(a + b)
                    if both is not None and -self.model.scores[both] < a_used and -self.model.scores[both] <= b_used:
                        return False
        return True

    # --- shortest paths -----------------------------------------------------------------------------------------

    def path(self, text: str) -> list[int]:
        """The ids on the least path through the lattice of a normalised text."""
        return self._merge_path(text) if self.model.kind == MERGES else self._unigram_path(text)

    def _merge_path(self, text: str) -> list[int]:
        """Depth first, longer pieces first. All finite paths weigh 0 and a position has one state of finite weight, so
        the first path to the end is the least, and a position that led nowhere is not tried again."""
        ids, reach, known, pieces = self.ids, self._reach, self._fits, self.model.pieces
        path: list[int] = []  # -1: the bytes of a character without a piece
        dead: set[int] = set()
        at, before, end = 0, -1, len(text)
        size = min(end, reach.get(text[:2], 1))
        while at < end:
            while size:
                piece = ids.get(text[at : at + size])
                if piece is not None and at + size not in dead:
                    if before < 0:
                        fit = self._tree(piece) is not None
                    else:
                        fit = known.get(before << 32 | piece)
                        if fit is None:
                            fit = self.fits(before, piece)
                    if fit:
                        path.append(piece)
                        at += size
                        before, size = piece, min(end - at, reach.get(text[at : at + 2], 1))
                        break
                size -= 1
            else:
                if text[at] not in ids:
                    path.append(-1)
                    at += 1
                    before, size = -1, min(end - at, reach.get(text[at : at + 2], 1))
                    continue
                if before < 0:
                    raise AssertionError(f"no path of finite weight for {text[:100]!r}")
                dead.add(at)
                size = len(pieces[path.pop()])
                at -= size
                before, size = path[-1] if path else -1, size - 1
        if -1 not in path:
            return path
        out, at = [], 0
        for piece in path:
            out += [piece] if piece >= 0 else self._fallback(text[at])
            at += len(pieces[piece]) if piece >= 0 else 1
        return out

    def _unigram_path(self, text: str) -> list[int]:
        weight, came = [0.0] + [INFINITE] * len(text), [(0, -1)] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(text[start:end])
                arc = -self.model.scores[piece] if piece is not None else self.unknown_weight if end - start == 1 else None
                if arc is not None and weight[start] + arc < weight[end]:
                    weight[end], came[end] = weight[start] + arc, (start, -1 if piece is None else piece)
        out: list[list[int]] = []
        end, last = len(text), 0
        while end:
            start, piece = came[end]
            if piece >= 0 or self.bytes or last >= 0:  # unknown characters in a row are one unknown piece
                out.append([piece] if piece >= 0 else self._fallback(text[start:end]))
            end, last = start, piece
        return [i for part in reversed(out) for i in part]

    # --- texts --------------------------------------------------------------------------------------------------

    def _packed(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids) if (ids := self.path(text)) else b""

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        if not text:
            return b""
        if not self.normalise.same:
            return self._spaced(self.normalise(text))
        text = text.replace(MARK, " ")
        line_end = None if "\n" in self.ids else self._packed("\n")
        lines = [text] if line_end is None else text.split("\n")
        out = []
        for n, line in enumerate(lines):
            marked = n == 0 and self.model.prefix
            if n:
                out.append(line_end)
            if "  " in line or line[-1:] == " " or (marked and line[:1] == " "):
                out.append(self._spaced(" " + line if marked else line))
                continue
            words = line.split(" ")
            if not marked:
                if words[0]:
                    out.append(self.bare[words[0]])
                words = words[1:]
            out += map(self.words.__getitem__, words)
        return b"".join(out)

    def _spaced(self, line: str) -> bytes:
        """A line with runs of blanks: a word is what follows a run, with the run."""
        out, at = [], 0
        while at < len(line):
            end = at
            while end < len(line) and line[end] == " ":
                end += 1
            stop = line.find(" ", end)
            stop = len(line) if stop < 0 else stop
            out.append(self.bare[line[at:stop].replace(" ", MARK)])
            at = stop
        return b"".join(out)

    def forget(self) -> None:
        """Give back the memory of remembered words at the end of a task, since workers outlive it."""
        self.words.clear()
        self.bare.clear()

    def _decoded(self, i: int) -> bytes:
        kind, piece = self.model.types[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.model.types[i] != CONTROL), None)
        marked = first is not None and self.model.types[first] == NORMAL and self.model.pieces[first][:1] == MARK
        return text[1:] if marked and (self.model.prefix or self.model.squeeze) else text


def _edge(tree: tuple, side: int) -> list[tuple]:
    """The nodes down one side of a merge tree with the times when they are made and used up; none if times fall."""
    out, used = [], INFINITE
    while tree is not None:
        made = -INFINITE if tree[1] is None else -tree[1]
        if made >= used:
            return []
        out.append((tree[0], made, used))
        used, tree = made, tree[side]
    return out


class _Remembered(dict):
    """Results of a function by argument, forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


_compiled: dict[int, Transducer] = {}


def _of(data: bytes) -> Transducer:
    """The transducer of this Python worker."""
    key = hash(data)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(data)
    return _compiled[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError("the model is sent to all executors; at most 64 MB are meant")
    return data


def _id_lists(packed_ids: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in packed_ids), np.int64, len(packed_ids))
    values = np.frombuffer(b"".join(packed_ids), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """The documents with `ids`, `n_ids` and, with `check`, `round_trip`: whether decoding gives the text again."""
    columns, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _of(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in text_of(part.column(0)).to_pylist()]
                ids = [transducer.encode(t) for t in texts]
                same = [
                    not check or transducer.decode(memoryview(i).cast("i").tolist()) == t
                    for i, t in zip(ids, texts, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _id_lists(ids), pa.array(same)], names=["row", "ids", "same"]
                )
        transducer.forget()

    base = packed(docs).select("row")
    kind = f"row {base.schema['row'].dataType.simpleString()}, ids array<int>, same boolean"
    done = base.mapInArrow(run, kind)
    results = {"ids": F.col("ids"), "n_ids": F.size("ids").cast("long")}
    return unpack(done, columns, **results, **({"round_trip": F.col("same")} if check else {}))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with `text` made from their `ids`; null ids give a null text, ids outside the model raise."""
    columns, sent = encoded.columns, encoded.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _of(sent.value)
        for batch in batches:
            texts = [None if i is None else transducer.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "made"])

    base = encoded.select(F.struct(*[encoded[f"`{c}`"] for c in columns]).alias("row"), encoded["ids"])
    done = base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, made string")
    return unpack(done, columns, text=F.col("made"))
