"""Run summaries and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import file_name_of, filing_name, source_name
from ledgerloom.functions.periods import semester_ordinal


def run_summary(panel: DataFrame, year: int, semester: int, entity: str = "CNPJ8") -> DataFrame:
    """One row of counters before and after the cut-off: a sum over per-entity counts."""
    inside = semester_ordinal(F.col("Ano"), F.col("Mes")) <= year * 10 + semester
    per_entity = panel.groupBy(entity).agg(F.count("*").alias("n"), F.count_if(inside).alias("m"))
    return per_entity.agg(
        F.count("*").alias("instituicoes_encontradas"),
        F.count_if(F.col("m") > 0).alias("instituicoes_incluidas"),
        F.count_if(F.col("m") == 0).alias("instituicoes_sem_dados"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas_antes_corte"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("linhas_apos_corte"),
    )


def processing_stats(results: DataFrame, entity: str = "cnpj8", ok: str = "readable") -> DataFrame:
    """One row of counters over per-document results: documents processed and failed, institutions with and without failures."""
    per_entity = results.groupBy(entity).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("m"))
    zero = F.lit(0)
    return per_entity.agg(
        F.coalesce(F.sum("n"), zero).alias("total"),
        F.coalesce(F.sum("m"), zero).alias("processados"),
        F.coalesce(F.sum(F.col("n") - F.col("m")), zero).alias("falhas"),
        F.count_if(F.col("n") == F.col("m")).alias("instituicoes_ok"),
        F.count_if(F.col("n") != F.col("m")).alias("instituicoes_com_falhas"),
    )


def prediction_stats(status: DataFrame) -> DataFrame:
    """Successes and failures per provider and model."""
    return status.groupBy("provider", "model").agg(
        F.count_if(F.col("success")).alias("sucessos"), F.count_if(~F.col("success")).alias("falhas")
    )


def parse_filing_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Add style, cnpj, base, submission of filing names; style is null for a name outside the patterns."""
    name = file_name_of(F.col(path))
    return files.select("*", filing_name(name).alias("__n")).select(
        *files.columns, "__n.style", "__n.cnpj", "__n.base", "__n.submission"
    )


def source_listing(files: DataFrame, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """Source documents with a valid name: institution, year, month, semester, name."""
    name = file_name_of(F.col(path))
    return (
        files.select(*keep, source_name(name).alias("m"), name.alias("arquivo"))
        .filter(F.col("m").isNotNull())
        .select(*keep, "m.cnpj8", "m.ano", "m.mes", "m.semestre_label", "arquivo")
    )


def file_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Per institution: number of documents, first and last month. Names outside the pattern count under null."""
    meta = source_name(file_name_of(F.col(path)))
    return (
        files.select(meta["cnpj8"].alias("cnpj8"), meta["yyyymm"].alias("yyyymm"))
        .groupBy("cnpj8")
        .agg(F.count("*").alias("arquivos"), F.min("yyyymm").alias("primeiro"), F.max("yyyymm").alias("ultimo"))
    )


def missing_sources(folders: DataFrame, files: DataFrame, folder: str = "pasta", path: str = "path") -> DataFrame:
    """Institution folders (8 digits) without their own `<id>/<id>.csv`."""
    pattern = r"(?:^|/)(\d{8})/\1\.csv$"
    found = files.select(F.regexp_extract(path, pattern, 1).alias(folder)).filter(F.col(folder) != "").distinct()
    return folders.filter(F.col(folder).rlike(r"^\d{8}$")).join(found, folder, "left_anti")
