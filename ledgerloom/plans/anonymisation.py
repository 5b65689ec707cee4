"""Job C, second half, and job B: anonymised and pseudonymised outputs with their private mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.operators import anonymize as A
from ledgerloom.operators.pseudonymize import pseudonym_mapping, pseudonymize
from ledgerloom.operators.summary import run_summary
from ledgerloom.session import materialise


@dataclass(frozen=True)
class AnonymisedTables:
    dataset: DataFrame
    mapping: DataFrame
    summary: DataFrame


def anonymised_tables(panel: DataFrame, year: int, semester: int, s: A.Settings) -> AnonymisedTables:
    """All three are projections of one scan; draws are keyed, so dataset and mapping agree without caching."""
    transformed = A.transform_panel(panel, year, semester, s)
    summary = run_summary(panel, year, semester).withColumns(
        {
            "corte": F.lit(f"{year}-S{semester}"),
            "seed": F.lit(s.seed),
            "salt_sha256": F.substring(F.sha2(F.lit(s.salt), 256), 1, 16),
            "fator_min": F.lit(s.factor_min),
            "fator_max": F.lit(s.factor_max),
            "ruido_min": F.lit(s.noise_min),
            "ruido_max": F.lit(s.noise_max),
            "casas_decimais": F.lit(s.digits),
        }
    )
    return AnonymisedTables(A.anonymized_panel(transformed), A.audit_mapping(transformed), summary)


def run(
    panel: DataFrame, target: str, private: str, year: int, semester: int, s: A.Settings, inputs: DataFrame | None = None
) -> AnonymisedTables:
    """Dataset and summary go to `target`, the mapping to the separate `private` path.

    `inputs` (see `panel_inputs`) adds the malformed files to the summary, and a table of all files with their
    fingerprints. Nothing is written or replaced if the panel has no row, or none inside the cutoff.
    """
    tables = anonymised_tables(panel, year, semester, s)
    summary = tables.summary
    if inputs is not None:
        stored = materialise(inputs.select("CNPJ8", "path", "sha256_16", (F.col("legivel") & (F.size("missing") == 0)).alias("lido")), "inputs")
        summary = summary.crossJoin(stored.agg(F.count_if(~F.col("lido")).alias("csvs_malformados")))  # one row each
    summary = materialise(summary, "summary")
    counts = summary.first()
    if not counts["linhas_antes_corte"]:
        raise ValueError("the panel has no rows")
    if not counts["linhas_apos_corte"]:
        raise ValueError(f"no institution has rows up to {year}-S{semester}")
    sinks.write_sorted(tables.dataset, f"{target}/dataset", ["inst_hash", "Ano", "Mes"])
    sinks.write_csv(tables.mapping, f"{private}/mapping", ";", bom=True)
    sinks.write_csv(summary, f"{target}/resumo", ";")
    if inputs is not None:
        sinks.write_csv(stored.orderBy("path"), f"{target}/entradas", ";")
    return tables


def run_pseudonyms(facts: DataFrame, target: str, private: str, salt: str, secret: str, noise: float = 0.0) -> None:
    sinks.write_csv(pseudonymize(facts, salt, secret, noise=noise), target)
    sinks.write_csv(pseudonym_mapping(facts, salt, secret), private)
