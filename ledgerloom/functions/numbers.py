"""Numbers and ranges written in free text, in Brazilian or US notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.structs import let, record

# How an amount looks in a range text (sign and currency mark, number, unit suffix).
# A run of four or more digits is taken whole; then digits grouped by three; then a short number.
AMOUNT = r"-?\s*R?\$?\s*(\d{4,}(?:[.,]\d+)?|\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:[.,]\d+)?)"
SUFFIX_FIRST = r"\s*(mil|milhão|milhões|MM|mi|M|K|B|bi|bilhões)?"
SUFFIX_LONGEST = r"\s*((?:milhões|milhão|bilhões|mil|MM|mi|bi|M|K|B)(?!\p{L}))?"

# Unit suffix -> multiplier
MULTIPLIERS = {
    "k": 1e3,
    "mil": 1e3,
    "m": 1e6,
    "mi": 1e6,
    "mm": 1e6,
    "milhão": 1e6,
    "milhões": 1e6,
    "b": 1e9,
    "bi": 1e9,
    "bilhões": 1e9,
}


def parse_amount(raw: Column, suffix: Column) -> Column:
    """Amount as double.

    With both separators the later one marks decimals. A single kind of separator groups thousands when all
    later groups have three digits and the first group is not a lone zero; otherwise it marks decimals.
    """
    has_dot, has_comma = raw.contains("."), raw.contains(",")
    comma_is_last = F.instr(F.reverse(raw), ",") < F.instr(F.reverse(raw), ".")
    grouped = raw.rlike(r"^(?!-?0[.,])[^.,]*([.,][^.,]{3})+$")
    plain = (
        F.when(has_dot & has_comma & comma_is_last, F.translate(raw, ",.", "."))
        .when(has_dot & has_comma, F.translate(raw, ",", ""))
        .when(grouped, F.translate(raw, ".,", ""))
        .otherwise(F.translate(raw, ",", "."))
    )
    factors = F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])
    factor = F.coalesce(F.try_element_at(factors, F.lower(F.trim(suffix))), F.lit(1.0))
    return plain.try_cast("double") * factor


def amounts_in(text: Column, literal: bool = True) -> Column:
    """All amounts of a text in order, signed, as array<double>.

    literal=True reads the suffix by the first alternative that fits and takes the sign from the first place
    where the digits occur in the text. literal=False reads whole suffix words, and a hyphen right after a
    digit separates a range instead of negating.
    """
    if literal:
        pattern, number_group = "(?iU)" + AMOUNT + SUFFIX_FIRST, 1
        signs = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            lambda n: F.when(F.instr(text, n) > 1, F.substr(text, F.instr(text, n) - 1, F.lit(1))).otherwise(""),
        )
    else:
        pattern, number_group = r"(?iU)((?<!\d\s{0,3})-)?" + AMOUNT.removeprefix("-?") + SUFFIX_LONGEST, 2
        signs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(number_group))
    suffixes = F.regexp_extract_all(text, F.lit(pattern), F.lit(number_group + 1))
    found = F.arrays_zip(numbers.alias("number"), suffixes.alias("suffix"), signs.alias("sign"))
    signed = F.transform(
        found,
        lambda m: parse_amount(m["number"], m["suffix"]) * F.when(m["sign"] == "-", F.lit(-1.0)).otherwise(F.lit(1.0)),
    )
    return F.filter(signed, lambda v: v.isNotNull())


def first_range(text: Column, literal: bool = True) -> Column:
    """struct<low, high> of the first two amounts; one amount counts twice; none gives null."""


    def ends(amounts: Column) -> Column:
        low = F.get(amounts, F.lit(0))
        return F.when(low.isNotNull(), record(low=low, high=F.coalesce(F.get(amounts, F.lit(1)), low)))

    return let(amounts_in(text, literal), ends)
