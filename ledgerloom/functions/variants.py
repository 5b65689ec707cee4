"""Small helpers over VARIANT values, used where a JSON type must be told apart from its text."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as "not given"
_EMPTY = ['""', "0", "0.0", "false", "null", "[]", "{}"]


def field(value: Column, name: str) -> Column:
    """Member of an object; null when absent or when `value` is no object."""
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def is_integer(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    finite = F.abs(number) <= sys.float_info.max
    return is_number(value) & F.coalesce((number == F.rint(number)) & finite, F.lit(False))


def given(value: Column) -> Column:
    """The value, or null when it is missing, null, empty, zero or false."""
    return F.when(~F.to_json(value).isin(_EMPTY), value)


def unwrap_single(value: Column) -> Column:
    """`[{...}]` -> `{...}`; an object stays; anything else is null."""
    items = as_list(value)
    inner = F.when(F.size(items) == 1, F.get(items, F.lit(0)))
    return F.when(as_map(value).isNotNull(), value).when(as_map(inner).isNotNull(), inner)
