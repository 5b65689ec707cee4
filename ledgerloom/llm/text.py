"""Column expressions and row helpers that the text operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK_CHARS = " \t\n\x0b\x0c\r"
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. Plain ASCII takes the fast path, on which lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(whole_text(text), BLANKS), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns, never null, that are equal for rows of equal doc_id and text and differ otherwise."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("row_id"), F.xxhash64(doc_id, text).alias("row_hash")]


def two_hashes(value: Column) -> list[Column]:
    """128 bits of a text: two hashes of different seeds."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as `row`, so that no name of the input can clash with a working column."""
    return docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def text_of(rows: pa.StructArray) -> pa.Array:
    """The texts within `row`, so that they need not be sent to Python twice."""
    return rows.field(next(i for i, f in enumerate(rows.type) if f.name.lower() == "text"))


def unpack(packed_rows: DataFrame, names: list[str], **results: Column) -> DataFrame:
    """The input's columns out of `row`, and the results; a result replaces an input column of its name.

    Results are made in a step of their own, so that no input column can be taken for one that they read.
    """
    new = {k.lower() for k in results}
    made = F.struct(F.lit(True).alias("made"), *[v.alias(k) for k, v in results.items()])
    apart = packed_rows.select(F.col("row").alias("__row"), made.alias("__made"))
    old = [F.col(f"__row.`{c}`").alias(c) for c in names if c.lower() not in new]
    return apart.select(*old, *[F.col(f"__made.`{k}`").alias(k) for k in results])
