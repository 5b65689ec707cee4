"""Small tables with the odd cases that every operator has to stand."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog.\nAnd again it jumps.",
    "",
    None,
    " \t\n ",
    "one",
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich",
    LONG,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "漢字 😀 ﷽ ▁ mark",
]


def rows():
    own = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    own += [own[0], own[6], (None, TEXTS[0], None, None, None), (100, TEXTS[0], "en", None, 1), (None, None, None, None, None)]
    return own


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names of results and of working columns of the operators.
CLASHES = (
    "row", "row_id", "row_hash", "digest", "kept", "keep_id", "group_size", "component_id", "node", "root", "band", "size",
    "copy", "shuffle_key", "count", "drawn", "rate", "n_lines", "n_dropped", "dropped", "position", "h1", "h2", "anchor",
    "content", "start", "mask", "marks", "ids", "n_ids", "same", "score", "predicted", "own_score", "labelled", "label",
    "host", "n_docs", "n_words", "n_removed", "base", "spans", "licence", "line_no", "at", "chosen", "island", "sketch",
    "rated", "distribution", "own_source", "gone", "stay_id", "rows", "first", "locator", "batch", "own", "words", "wanted",
)


def clashing(spark):
    """The odd documents with extra columns of those names."""
    from pyspark.sql import functions as F

    return docs(spark).select("*", *[F.lit(f"extra {n}").alias(n) for n in CLASHES])
