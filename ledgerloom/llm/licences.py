"""Licence scans by digests of canonical texts.

A text is made canonical by built-in functions: lower case, copyright lines out, equivalent spellings alike,
punctuation and blanks to single spaces. Its SHA-256 is looked up among the digests of known licences by a hash join.
Units are the entire text of a document, and as entire texts of their own each of its lines, each block between blank
lines, and each run of lines that starts with the first words of a known text of more than `SHORT` words, ends with its
last ones and is as long. So a notice is found when it fills a line or block, and a header or licence between other
lines, however either is broken into lines. Lines without canonical letters and copyright lines within a run don't count.
The known texts are a fixed list; their digests, ends and lengths are the only thing broadcast.

Only hit lines take part in a shuffle. Texts of any length are canonical as a whole. Defined cases: a null or empty text and a text without letters match nothing;
equal rows are reported one by one; ties don't arise, as canonical texts of the list are distinct; clashing input
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import packed, row_key, whole_text
from ledgerloom.llm.licence_texts import LICENCES

#: Equivalent spellings, applied in this order to lower-cased text.
SPELLINGS = (
    ("licenc", "licens"),
    ("\\bsub-licens", "sublicens"),
    ("\\(c\\)|©", "copyright"),
    ("\\bnon-?commercial", "noncommercial"),
    ("https?://", ""),
    ("&", " and "),
    ("\\bver(?:sion|\\.)?[ \\t]+([0-9])|\\bv\\.?[ \\t]*([0-9])", "version $1$2"),
    ("\\bcc[- ]by", "cc by"),
    ("\\bhonour", "honor"),
    ("\\bfavour", "favor"),
    ("\\borganis", "organiz"),
    ("\\backnowledgement", "acknowledgment"),
)
_YEAR = "(?:[0-9]{4}|<year>|\\[year\\]|yyyy)"
_SIGN = "(?:\\(c\\)|©)"
#: Lines that name a holder: copyright with a year, or followed by its sign or 'by'. Prose such as 'copyright notice' stays.
COPYRIGHT_LINE = (
    f"(?m)^[^a-z0-9\\n]*(?:copyright|{_SIGN})[^\\n]*{_YEAR}[^\\n]*$"
    f"|^[^a-z0-9\\n]*(?:copyright[ \\t]*(?:{_SIGN}|by\\b)|{_SIGN}[ \\t]*copyright\\b)[^\\n]*$"
    "|^[^a-z0-9\\n]*all rights reserved[^a-z0-9\\n]*$"
)
#: Opening words of a grant; a copyright line ends before them where line breaks are gone.
_GRANT = "(?:" + "|".join(
    (
        "permission is (?:hereby )?granted", "permission to use", "redistribution and use", "licen[cs]ed (?:under|to)\\b",
        "released under\\b", "distributed under\\b", "this (?:program|library|software) is (?:free|provided|licen[cs]ed|released)",
        "this source code form", "use of this source code", "spdx-licen[cs]e-identifier", "everyone is permitted",
    )
).replace(" ", "[ \\t]+") + ")"
#: Line breaks put back around a copyright line in running text that goes on with a grant.
COPYRIGHT_START = f"[ \\t]+(?=(?:{_SIGN}[ \\t]*)?copyright[ \\t]*(?:{_SIGN}|by\\b|{_YEAR})[^\\n]*?[ \\t]{_GRANT})"
COPYRIGHT_END = f"(copyright[^\\n]*?|{_SIGN}[ \\t]*{_YEAR}[^\\n]*?)[ \\t]+(?={_GRANT})"
LINE_ENDS = "\r\x0b\x0c\x85\u2028\u2029"
#: Each known text holds one of these in any of its spellings; a text without them needs no canonical form.
STEMS = ("licen", "permission", "cc0", "redistribution", "released", "distributed", "available", "published")
#: Known texts of more words are looked for as runs of lines, shorter ones as blocks.
SHORT = 16
BLANK_LINES = "\n(?:[ \\t\\x0b\f\r]*\n)+"


def may_match(text: Column) -> Column:
    """Whether a text holds a stem, so that it can equal a known text at all."""
    low = F.lower(whole_text(text))
    return reduce(or_, [F.contains(low, F.lit(stem)) for stem in STEMS])


def canonical_lines(text: Column) -> Column:
    """The form in which texts are compared, with a line feed in place of a space where a line ends."""
    out = F.translate(F.lower(whole_text(text)), LINE_ENDS, "\n" * len(LINE_ENDS))
    apart = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_START, "\n"), COPYRIGHT_END, "$1\n")
    out = F.when(F.rlike(out, F.lit(_GRANT)), apart).otherwise(out)
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for spelling, common in SPELLINGS:
        out = F.regexp_replace(out, spelling, common)
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}\n]+", " ")
    return F.btrim(F.regexp_replace(out, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def joined(lines: Column) -> Column:
    return F.translate(lines, "\n", " ")


def canonical(text: Column) -> Column:
    """The form in which texts are compared."""
    return joined(canonical_lines(text))


def known_licences(spark: SparkSession, licences: dict[str, str] = LICENCES) -> DataFrame:
    """licence and digest; the list is short and fixed by the caller."""
    without = [name for name, body in licences.items() if not any(stem in body.lower() for stem in STEMS)]
    if without:
        raise ValueError(f"no stem in {without}; add one that these texts hold in every spelling")
    rows = spark.createDataFrame(list(licences.items()), "licence string, body string")
    rows = rows.select("licence", canonical(F.col("body")).alias("form"))
    short = F.size(F.split("form", " ")) <= SHORT
    return rows.select("licence", F.sha2("form", 256).alias("digest"), short.alias("short"))


def known_runs(spark: SparkSession, licences: dict[str, str] = LICENCES) -> DataFrame:
    """head and pattern of the texts of more than SHORT words: the first words, and runs of lines of these ends and length."""
    rows = spark.createDataFrame([(body,) for body in licences.values()], "body string")
    rows = rows.select(canonical(F.col("body")).alias("form")).filter(F.size(F.split("form", " ")) > SHORT)
    ends = rows.select(
        F.regexp_extract("form", "^(?:[^ ]+ ){5}[^ ]+", 0).alias("head"),
        F.regexp_extract("form", "[^ ]+(?: [^ ]+){5}$", 0).alias("tail"),
        F.char_length("form").alias("n"),
    )
    between = F.col("n") - F.char_length("head") - F.char_length("tail")
    anywhere = [F.replace(F.col(c), F.lit(" "), F.lit("[ \n]")) for c in ("head", "tail")]
    pattern = F.concat(
        F.lit("(?m)^(?=("), anywhere[0], F.lit("[\\s\\S]{"), between.cast("string"), F.lit("}"), anywhere[1], F.lit(")$)")
    )
    return ends.select("head", pattern.alias("pattern")).distinct()


def _with_digest(units: DataFrame, place: str) -> DataFrame:
    """Digests of the units that are two lines or more and not the whole text."""
    part = F.contains("unit", F.lit("\n")) & (F.char_length("unit") < F.col("n"))
    digest = F.sha2(joined(F.col("unit")), 256).alias("digest")
    return units.filter(part).select("row_id", "row_hash", F.lit(place).alias("place"), "at", "start", digest)


def _blocks(texts: DataFrame) -> DataFrame:
    split = F.split(whole_text(F.col("text")), BLANK_LINES, -1)
    some = F.filter(split, lambda b: F.contains(b, F.lit("\n")) & may_match(b))
    units = texts.select(
        "row_id", "row_hash", F.char_length("form").alias("n"), F.posexplode(F.transform(some, canonical_lines)).alias("at", "unit")
    )
    return _with_digest(units.withColumn("start", F.lit("")), "block")


def _runs(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """Runs of lines with a known text's ends. The first six words from each line's start on (they may lie in up to six
    lines) are joined with the known ones; only those that are known carry the text along."""
    lines = F.split("form", "\n")
    heads = F.transform(lines, lambda _, i: F.regexp_extract(F.array_join(F.slice("lines", i + 1, F.lit(6)), " "), "^(?:[^ ]+ ){5}[^ ]+", 0))
    known = starts.agg(F.collect_set("head").alias("heads")).scalar()
    forms = texts.select("row_id", "row_hash", "form", lines.alias("lines"))
    forms = forms.select("row_id", "row_hash", "form", F.explode(F.array_intersect(heads, known)).alias("head"))
    near = forms.join(starts, "head")
    units = near.select(
        "row_id", "row_hash", F.char_length("form").alias("n"), F.col("pattern").alias("start"),
        F.posexplode(F.regexp_extract_all("form", F.col("pattern"), F.lit(1))).alias("at", "unit"),
    )
    return _with_digest(units, "run")


def scan(docs: DataFrame, licences: dict[str, str] = LICENCES) -> DataFrame:
    """doc_id, the licence that the whole text is (or null), and which licences its lines are, how often.

    Likewise which licences blocks and runs of two lines or more are; a known text within another counts too.
    """
    if len(licences) > 10_000:
        raise ValueError("the list of known licences is broadcast; at most 10,000 texts are meant")
    spark = docs.sparkSession
    known = F.broadcast(known_licences(spark, licences))
    base = packed(docs)
    digest = F.when(may_match(F.col("text")), F.sha2(canonical(F.col("text")), 256))
    whole = base.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", digest.alias("digest"))
    whole = whole.join(known, "digest", "left").withColumnRenamed("licence", "whole_licence").drop("digest", "short")
    numbered = F.transform(
        F.split(whole_text(F.col("text")), "\n", -1), lambda line, n: F.struct(n.alias("line_no"), line.alias("line"))
    )
    some = F.filter(numbered, lambda x: may_match(x["line"]))
    texts = base.filter(may_match(F.col("text"))).select(*row_key(F.col("doc_id"), F.col("text")), "text")
    lines = texts.select("row_id", "row_hash", F.explode(some).alias("x"))
    line_digest = F.sha2(canonical(F.col("x.line")), 256).alias("digest")
    lines = lines.select("row_id", "row_hash", F.lit("line").alias("place"), F.col("x.line_no").alias("at"), F.lit("").alias("start"), line_digest)
    formed = texts.withColumn("form", canonical_lines(F.col("text")))
    units = lines.union(_blocks(formed)).union(_runs(formed, F.broadcast(known_runs(spark, licences))))
    hits = units.join(known, "digest").filter((F.col("place") != "block") | F.col("short")).drop("digest", "short").distinct()
    found = hits.groupBy("row_id", "row_hash").agg(
        F.count_if(F.col("place") == "line").alias("n_licence_lines"),
        F.array_sort(F.collect_set(F.when(F.col("place") == "line", F.col("licence")))).alias("line_licences"),
        F.count_if(F.col("place") != "line").alias("n_licence_blocks"),
        F.array_sort(F.collect_set(F.when(F.col("place") != "line", F.col("licence")))).alias("block_licences"),
    )
    listed = [F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("line_licences", "block_licences")]
    return whole.join(found, ["row_id", "row_hash"], "left").select(
        "doc_id",
        "whole_licence",
        F.coalesce("n_licence_lines", F.lit(0).cast("long")).alias("n_licence_lines"),
        listed[0],
        F.coalesce("n_licence_blocks", F.lit(0).cast("long")).alias("n_licence_blocks"),
        listed[1],
    )
