"""Fields read from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import layout
from ledgerloom.functions.periods import semester_label


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _group(name: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(name, pattern, index)


def filing_name(name: Column) -> Column:
    """struct<style, cnpj, base, submission>; style is 'typed', 'dated' or null for a name outside both patterns.

    `base` is YYYYMM as written in the name; a dated name holds no submission type.
    """
    typed, dated = name.rlike(layout.FILING_NAME_TYPED), name.rlike(layout.FILING_NAME_DATED)
    return F.struct(
        F.when(typed, "typed").when(dated, "dated").alias("style"),
        F.when(typed, _group(name, layout.FILING_NAME_TYPED, 1))
        .when(dated, _group(name, layout.FILING_NAME_DATED, 2))
        .alias("cnpj"),
        F.when(typed, F.substring(_group(name, layout.FILING_NAME_TYPED, 3), 1, 6))
        .when(dated, _group(name, layout.FILING_NAME_DATED, 1))
        .alias("base"),
        F.when(typed, _group(name, layout.FILING_NAME_TYPED, 2)).alias("submission"),
    )


def source_name(name: Column) -> Column:
    """struct<yyyymm, ano, mes, semestre_label, cnpj8, codigo>, or null for a name outside the pattern."""
    yyyymm = _group(name, layout.SOURCE_NAME, 1)
    year, month = F.substring(yyyymm, 1, 4).try_cast("int"), F.substring(yyyymm, 5, 2).try_cast("int")
    return F.when(
        name.rlike(layout.SOURCE_NAME),
        F.struct(
            yyyymm.alias("yyyymm"),
            year.alias("ano"),
            month.alias("mes"),
            semester_label(year, month).alias("semestre_label"),
            _group(name, layout.SOURCE_NAME, 3).alias("cnpj8"),
            _group(name, layout.SOURCE_NAME, 2).alias("codigo"),
        ),
    )


def prediction_name(name: Column) -> Column:
    """struct<inst_hash, provider, model>, or null for failures and for names outside the pattern."""
    return F.when(
        name.rlike(layout.PREDICTION_NAME) & ~name.endswith(".error.json"),
        F.struct(
            _group(name, layout.PREDICTION_NAME, 1).alias("inst_hash"),
            _group(name, layout.PREDICTION_NAME, 2).alias("provider"),
            _group(name, layout.PREDICTION_NAME, 3).alias("model"),
        ),
    )


def safe_for_names(text: Column) -> Column:
    """Characters that file systems refuse become hyphens."""
    return F.regexp_replace(text, layout.FORBIDDEN_IN_NAMES, "-")
