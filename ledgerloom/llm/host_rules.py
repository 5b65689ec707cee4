"""Quality rules judged by document and by host.

Each document is measured by built-in functions. The failures of each rule are summed by host; the hosts' rates are
drawn towards the mean by a beta prior fitted to all hosts (moments, less the binomial noise), and a host whose rate
lies above the limit even two standard deviations lower is rejected for that rule. The verdict is joined back to the
documents. The host table is written once: Spark broadcasts it below its size threshold, and otherwise shuffles the
narrow measures, where adaptive execution splits a host that owns a third of the rows. The measures are written once
too, so the texts are read once. The driver receives one row: the prior's moments.

Defined cases: a null or empty text has no words and fails the length rule; a null host is a host of its own; equal
rows are judged one by one; without any spread between hosts every host gets the common rate; an empty table gives an
empty result; texts are measured whole, in memory in proportion to the longest; a rate exactly at the limit is no
failure; of clashing input columns only doc_id, text and the host column are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import BLANKS, bind, whole_text, words_of
from ledgerloom.session import materialise

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """Document limits, as the rules' thresholds, and the host limits."""

    min_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 10
    dup_line_percent: int = 30
    min_word_chars: float = 2.0
    max_word_chars: float = 12.0
    host_rate: float = 0.5
    deviations: float = 2.0


RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by a run of `window` words that occurs twice or more in the text."""

    def covered(hashes: Column) -> Column:
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def lengths(by_hash: Column) -> Column:
            def same(k: Column, x: Column) -> Column:
                return F.get(by_hash, k)["h"].eqNullSafe(x["h"])

            at_all = F.transform(by_hash, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
            twice = F.filter(at_all, lambda i: i.isNotNull())
            return bind(
                F.array_sort(twice),
                lambda at: F.aggregate(
                    F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window)))),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(places, lengths))

    def hashed(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, window)))

    return bind(words, lambda own: F.when(F.size(own) <= window, 0).otherwise(bind(hashed(own), covered)))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each whole text."""
    text = whole_text(docs["text"])
    words = words_of(text)
    worded = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\x0c\r"))) > 0)
    return docs.select(
        docs["doc_id"],
        F.coalesce(docs[f"`{host}`"].cast("string"), F.lit("")).alias("host"),
        docs[f"`{host}`"].isNull().alias("no_host"),
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(worded).cast("long").alias("n_worded_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


def failures(limits: Limits) -> dict[str, Column]:
    """Rule: whether a row of `measures` breaks it."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": words < limits.min_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > limits.symbol_percent * chars,
        "dup_lines": 100 * F.col("n_dup_lines") > limits.dup_line_percent * F.col("n_worded_lines"),
        "word_length": (chars < limits.min_word_chars * words) | (chars > limits.max_word_chars * words),
    }


def host_verdicts(measured: DataFrame, limits: Limits) -> DataFrame:
    """One row per host: documents, shrunk rate of each rule, and whether the host is rejected."""
    fails = failures(limits)
    counts = materialise(
        measured.groupBy("host", "no_host").agg(
            F.count(F.lit(1)).alias("n_docs"), *[F.count_if(fails[r]).alias(f"fails_{r}") for r in RULES]
        ),
        "host-counts",
    )

    def moments(rule: str) -> list[Column]:
        n, k = F.col("n_docs"), F.col(f"fails_{rule}")
        rate = k / n
        return [
            (F.sum(k) / F.sum(n)).alias(f"mean_{rule}"),
            F.var_samp(rate).alias(f"spread_{rule}"),
            F.avg(F.lit(1.0) / n).alias(f"noise_{rule}"),
        ]

    fitted = counts.agg(*[m for r in RULES for m in moments(r)]).first()
    rejected, rates = F.lit(False), []
    for rule in RULES:
        mean, spread, noise = (fitted[f"{part}_{rule}"] or 0.0 for part in ("mean", "spread", "noise"))
        between = spread - mean * (1 - mean) * noise
        n, k = F.col("n_docs"), F.col(f"fails_{rule}")
        if between > 0 and mean * (1 - mean) > between:
            strength = mean * (1 - mean) / between - 1
            a, b = k + strength * mean, n - k + strength * (1 - mean)
            rate, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        elif between > 0:
            rate, deviation = k / n, F.lit(0.0)
        else:
            rate, deviation = F.lit(float(mean)), F.lit(0.0)
        rejected = rejected | (rate - limits.deviations * deviation > limits.host_rate)
        rates.append(rate.alias(f"rate_{rule}"))
    return counts.select("host", "no_host", F.col("n_docs").alias("host_docs"), rejected.alias("host_rejected"), *rates)


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Measures of each document, `base_failed`, the host's verdict, and `kept`."""
    measured = materialise(measures(docs, host), "measures")
    hosts = materialise(host_verdicts(measured, limits), "hosts")
    fails = failures(limits)
    base = fails["short"] | fails["repeats"]
    return (
        measured.withColumn("base_failed", base)
        .join(hosts, ["host", "no_host"], "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .withColumn("host", F.when(~F.col("no_host"), F.col("host")))
        .drop("no_host")
    )
