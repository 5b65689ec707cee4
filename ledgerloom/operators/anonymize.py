"""Anonymisation of the panel: cut-off, hashing, scaling, noise, ratios and the audit mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import layout
from ledgerloom.functions.identity import hash_padded
from ledgerloom.functions.keyed_random import uniform
from ledgerloom.functions.periods import semester_ordinal
from ledgerloom.functions.ratios import number, panel_ratios, percent_change, round_to
from ledgerloom.operators.joins import lookup_join


@dataclass(frozen=True)
class Settings:
    """Parameters of one run. There is no default salt."""

    salt: str
    seed: int = 42
    factor_min: float = 0.60
    factor_max: float = 1.40
    noise_min: float = 0.98
    noise_max: float = 1.02
    digits: int = 3

    def __post_init__(self) -> None:
        if len(self.salt or "") < 16:
            raise ValueError("the salt needs at least 16 characters")
        if not 0 < self.factor_min < self.factor_max:
            raise ValueError("factors need 0 < factor_min < factor_max")
        if not 0 < self.noise_min < self.noise_max:
            raise ValueError("noise needs 0 < noise_min < noise_max")
        if not 0 <= self.digits <= 10:
            raise ValueError("digits must lie between 0 and 10")


def semester_cutoff(panel: DataFrame, year: int, semester: int, keep_undated: bool = True) -> DataFrame:
    """Rows up to and including the semester. A row without year counts as year 0 and so passes by default."""
    passes = semester_ordinal(F.col("Ano"), F.col("Mes")) <= year * 10 + semester
    if not keep_undated:
        passes &= F.col("Ano").try_cast("double").isNotNull()
    return panel.filter(passes)


def cutoff_excluded(panel: DataFrame, year: int, semester: int, entity: str = "CNPJ8") -> DataFrame:
    """Entities that have rows, but none up to the cut-off. One aggregate, no self-join."""
    inside = semester_ordinal(F.col("Ano"), F.col("Mes")) <= year * 10 + semester
    return (
        panel.groupBy(entity)
        .agg(F.count("*").alias("linhas"), F.count_if(inside).alias("__inside"))
        .filter(F.col("__inside") == 0)
        .drop("__inside")
    )


def hash_entities(panel: DataFrame, salt: str) -> DataFrame:
    return panel.withColumn("inst_hash", hash_padded(F.col("CNPJ8"), salt))


def auditor_category(name: Column) -> Column:
    return F.when(F.coalesce(name.rlike(layout.LARGE_AUDITOR_PATTERN), F.lit(False)), layout.LARGE_AUDITOR).otherwise(
        layout.OTHER_AUDITOR
    )


def auditor_distribution(panel: DataFrame, column: str = "Ident__Auditor_Independente") -> DataFrame:
    return panel.groupBy(auditor_category(F.col(column)).alias("categoria")).agg(F.count("*").alias("linhas"))


def entity_factor(inst_hash: Column, s: Settings) -> Column:
    """The entity's fixed factor, a function of its hash: no list of entities, no join."""
    return uniform(s.factor_min, s.factor_max, F.lit(s.salt), F.lit(s.seed), inst_hash)


def cell_noise(inst_hash: Column, period: Column, column: str, s: Settings) -> Column:
    """Independent draw per cell, from a stream of its own."""
    return uniform(s.noise_min, s.noise_max, F.lit(s.salt), F.lit(s.seed + 1), inst_hash, period, F.lit(column))


def entity_factors(panel: DataFrame, s: Settings) -> DataFrame:
    """(inst_hash, fator) of every entity of a hashed panel."""
    return panel.select("inst_hash").distinct().withColumn("fator", entity_factor(F.col("inst_hash"), s))


def scale_by_entity(panel: DataFrame, s: Settings | None = None, factors: DataFrame | None = None) -> DataFrame:
    """Multiply the 16 account columns by the entity's factor; what is no number counts as 0.

    The factor is drawn from the hash (`s`), or looked up in `factors` (inst_hash, fator) of an earlier run; an
    entity missing there fails the job.
    """
    if factors is None:
        assert s is not None
        with_factor = panel.withColumn("_Fator_Escalonamento", entity_factor(F.col("inst_hash"), s))
    else:
        joined = lookup_join(panel, factors.select("inst_hash", "fator"), ["inst_hash"])
        with_factor = joined.withColumn(
            "_Fator_Escalonamento",
            F.coalesce("fator", F.raise_error(F.concat(F.lit("no factor for "), F.col("inst_hash"))).cast("double")),
        ).drop("fator")
    zero = F.lit(0.0)
    return with_factor.withColumns(
        {
            c: F.coalesce(number(panel, c), zero) * F.col("_Fator_Escalonamento")
            for c in layout.ACCOUNT_COLUMNS
            if c in panel.columns
        }
    )


def add_noise(panel: DataFrame, s: Settings, period: str = "Semestre_Ref") -> DataFrame:
    zero = F.lit(0.0)
    return panel.withColumns(
        {
            c: F.coalesce(number(panel, c), zero) * cell_noise(F.col("inst_hash"), F.col(period), c, s)
            for c in layout.NOISE_COLUMNS
            if c in panel.columns
        }
    )


def keep_original_ratios(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"_Orig_{c}": number(panel, c) for c in layout.RATIO_COLUMNS if c in panel.columns})


def recalculate_ratios(panel: DataFrame, digits: int = 3) -> DataFrame:
    account = {c: number(panel, c) for c in layout.ACCOUNT_COLUMNS}
    return panel.withColumns(panel_ratios(account, digits))


def transform_panel(panel: DataFrame, year: int, semester: int, s: Settings) -> DataFrame:
    """Cut-off to recalculated ratios as one chain of projections: no shuffle, no join.

    The result still holds identities, `_Orig_*` and `_Fator_*`; dataset and mapping are both read from it.
    """
    hashed = hash_entities(semester_cutoff(panel, year, semester), s.salt)
    if "Ident__Auditor_Independente" in hashed.columns:
        hashed = hashed.withColumn(
            "Ident__Auditor_Independente", auditor_category(F.col("Ident__Auditor_Independente"))
        )
    noisy = add_noise(scale_by_entity(hashed, s), s)
    return recalculate_ratios(keep_original_ratios(noisy), s.digits)


def audit_mapping(transformed: DataFrame) -> DataFrame:
    """Private table: identity, factor (6 digits) and change of four ratios in percent (4 digits)."""
    changes = {
        "Var_%_ROE": "Indic__ROE",
        "Var_%_Eficiencia": "Indic__Indice_Eficiencia",
        "Var_%_Liquidez": "Indic__Liquidez_Imediata",
        "Var_%_Capitalizacao": "Indic__Indice_Capitalizacao",
    }
    return transformed.select(
        "inst_hash",
        "Semestre_Ref",
        "Ident__CNPJ",
        "Ident__Razao_Social",
        round_to(F.col("_Fator_Escalonamento"), 6).alias("Fator_Escalonamento"),
        *[
            round_to(percent_change(F.col(c), F.col(f"_Orig_{c}")), 4).alias(label)
            for label, c in changes.items()
        ],
    )


def anonymized_panel(transformed: DataFrame) -> DataFrame:
    """Public dataset: no identities, no helper columns. Sorting is left to the sink."""
    helpers = [c for c in transformed.columns if c.startswith(("_Orig_", "_Fator_"))]
    return transformed.drop(*layout.PRIVATE_COLUMNS, *helpers)
