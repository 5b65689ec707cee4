"""Identifier clean-up and salted hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.layout import BLANKS


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def zero_pad(text: Column, width: int) -> Column:
    """Left-pad with zeros; longer texts stay whole (lpad alone would cut them)."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def hash_plain(cnpj: Column, salt: str) -> Column:
    """sha256(salt + id), hex."""
    return F.sha2(F.concat(F.lit(salt), cnpj), 256)


def hash_padded(cnpj8: Column, salt: str) -> Column:
    """sha256(salt::id), hex, with the id stripped and padded to 8 digits first."""
    return F.sha2(F.concat(F.lit(salt + "::"), zero_pad(strip(cnpj8.cast("string")), 8)), 256)


def cnpj8_of(value: Column, dtype: str = "string") -> Column:
    """First 8 of the 14 digits; numbers lose their fraction first, a value without digits gives ''."""
    text = value if dtype == "string" else value.cast("decimal(38,0)").cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(value.isNull() | (digits == ""), F.lit("")).otherwise(F.substring(zero_pad(digits, 14), 1, 8))
