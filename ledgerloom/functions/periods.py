"""Period tags, semesters and cut-offs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_to_iso(tag: Column) -> Column:
    """`PMMYYYY` -> ISO date: A ends the year, S and I end their half-year, T ends its month; else null."""
    kind, month, year = F.substring(tag, 1, 1), F.substring(tag, 2, 2), F.substring(tag, 4, 100)
    half_year = F.when(month == "06", F.concat(year, F.lit("-06-30"))).otherwise(F.concat(year, F.lit("-12-31")))
    month_end = F.last_day(F.concat_ws("-", year, month, F.lit("01")).try_cast("date")).cast("string")
    return (
        F.when(kind == "A", F.concat(year, F.lit("-12-31")))
        .when(kind.isin("S", "I"), half_year)
        .when(kind == "T", month_end)
    )


def semester_number(month: Column) -> Column:
    return F.when(month <= 6, F.lit(1)).otherwise(F.lit(2))


def semester_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-S"), semester_number(month).cast("string"))


def semester_ordinal(year: Column, month: Column) -> Column:
    """Comparable key `year * 10 + semester`; year and month that are not numbers count as 0."""
    y = F.coalesce(year.try_cast("double"), F.lit(0.0)).cast("int")
    m = F.coalesce(month.try_cast("double"), F.lit(0.0)).cast("int")
    return y * 10 + semester_number(m)


def following_semester(year: Column, month: Column) -> Column:
    """Label of the semester after the one that holds (year, month)."""
    return F.when(month <= 6, F.concat(year.cast("string"), F.lit("-S2"))).otherwise(
        F.concat((year + 1).cast("string"), F.lit("-S1"))
    )


def parse_cutoff(text: str) -> tuple[int, int]:
    """`2024-S1`, `2024S1`, `202406` or `202412` -> (year, semester)."""
    plain = text.strip().upper().replace("-", "")
    year, rest = plain[:4], plain[4:]
    halves = {"S1": 1, "S2": 2, "06": 1, "12": 2}
    if not (year.isdigit() and len(year) == 4 and rest in halves):
        raise ValueError(f"cut-off {text!r}: expected YYYY-S1, YYYY-S2, YYYY06 or YYYY12")
    return int(year), halves[rest]
