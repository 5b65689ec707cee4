"""Removal of lines that many documents share.

Lines are exploded as hashes of their keys, documents are counted for each hash, and the lines of frequent hashes are
dropped; the others are put together again by position. Only hashes and positions take part in the count, so a line
that stands in a third of all documents is summed up before the shuffle, and the join that finds its places is an
equi-join whose large partitions adaptive execution splits. The list of frequent hashes is written once.

Defined cases: a null text is one empty line; empty keys (shorter than `min_chars`) are never dropped; each row counts
as one document, repeated rows too; a row without doc_id is treated like any other; input columns named like a result
are replaced; lines of any length are keyed whole; a key in exactly `min_docs` documents is dropped, and lines keep the
order of the text, so there are no ties; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import BLANK_CHARS, ascii_lower, bind, packed, row_key, two_hashes, unpack, whole_text
from ledgerloom.session import materialise


def lines_of(text: Column) -> Column:
    return F.split(whole_text(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def _hashed(lines: Column, min_chars: int) -> Column:
    """position, h1, h2 of each line whose key is long enough."""
    keys = F.transform(lines, lambda line: line_key(line))
    hashed = F.transform(
        keys,
        lambda key, i: F.struct(
            i.alias("position"), *[h.alias(n) for n, h in zip(("h1", "h2"), two_hashes(key), strict=True)],
            (F.char_length(key) >= min_chars).alias("counts"),
        ),
    )
    return F.filter(hashed, lambda x: x["counts"])


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """h1, h2 of the keys found in at least `min_docs` documents."""
    own = F.array_distinct(F.transform(_hashed(lines_of(F.col("text")), min_chars), lambda x: F.struct(x["h1"], x["h2"])))
    once = docs.select(F.explode(own).alias("line")).select("line.h1", "line.h2")
    counted = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with `text` cut to the lines that stay, `n_lines` before and `n_dropped`."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars start at 1")
    columns, base = docs.columns, packed(docs)
    frequent = materialise(frequent_lines(base, min_docs, min_chars), "frequent-lines")
    places = base.select(
        *row_key(F.col("doc_id"), F.col("text")),
        F.explode(_hashed(lines_of(F.col("text")), min_chars)).alias("line"),
    ).select("row_id", "row_hash", "line.position", "line.h1", "line.h2")
    dropped = (
        places.join(frequent, ["h1", "h2"])
        .groupBy("row_id", "row_hash")
        .agg(F.collect_set("position").alias("dropped"))
    )
    keyed = base.select("row", "text", *row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(dropped, ["row_id", "row_hash"], "left")
    lines, gone = lines_of(F.col("text")), F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    kept = bind(
        lines,
        lambda all_lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone), lambda i: F.get(all_lines, i)
            ),
            "\n",
        ),
    )
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(kept)
    return unpack(joined, columns, text=text, n_lines=F.size(lines).cast("long"), n_dropped=F.size(gone).cast("long"))
