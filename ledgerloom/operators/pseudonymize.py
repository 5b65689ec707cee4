"""Simple pseudonymisation of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identity import hash_plain
from ledgerloom.functions.keyed_random import uniform


def _multiplier(inst_hash: Column, secret: str, low: float, high: float) -> Column:
    return uniform(low, high, F.lit(secret), F.lit("k"), inst_hash)


def pseudonymize(
    facts: DataFrame,
    salt: str,
    secret: str,
    low: float = 0.60,
    high: float = 1.40,
    noise: float = 0.0,
    noise_key: list[str] | None = None,
) -> DataFrame:
    """Replace `cnpj` by `inst_hash` in front, scale `valor` per institution, with optional noise of +-`noise`.

    Multipliers and noise are keyed on `secret`: they cannot be guessed without it and repeat under recomputation.
    `noise_key` names the columns that identify a row; by default all of them.
    """
    missing = {"cnpj", "valor"} - set(facts.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    hashed = facts.withColumn("inst_hash", hash_plain(F.col("cnpj"), salt))
    value = F.col("valor") * _multiplier(F.col("inst_hash"), secret, low, high)
    if noise > 0:
        key = [F.col(c) for c in (noise_key or facts.columns)]
        value = value * (F.lit(1.0) + uniform(-noise, noise, F.lit(secret), F.lit("n"), *key))
    others = [c for c in facts.columns if c != "cnpj"]
    return hashed.withColumn("valor", value).select("inst_hash", *others)


def pseudonym_mapping(
    facts: DataFrame, salt: str, secret: str, low: float = 0.60, high: float = 1.40
) -> DataFrame:
    """Private table (inst_hash, cnpj, k_multiplier), one row per institution."""
    return (
        facts.select("cnpj")
        .distinct()
        .select(hash_plain(F.col("cnpj"), salt).alias("inst_hash"), "cnpj")
        .withColumn("k_multiplier", _multiplier(F.col("inst_hash"), secret, low, high))
    )
