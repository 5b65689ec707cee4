"""Job A: filings to fact table, run log and balance check."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import layout, sinks
from ledgerloom.functions.names import filing_name
from ledgerloom.operators.contract import with_status
from ledgerloom.operators.flatten import flatten_accounts
from ledgerloom.operators.quality import balance_qc
from ledgerloom.operators.replacement import filing_keys, filing_rejects, replaced_filings
from ledgerloom.session import materialise
from ledgerloom.sources.documents import decode_documents, read_files
from ledgerloom.sources.tables import silver_scan


@dataclass(frozen=True)
class FilingTables:
    status: DataFrame
    facts: DataFrame
    balance: DataFrame


def with_version_keys(documents: DataFrame, unified: bool = False) -> DataFrame:
    """Documents with a name and keys; `unified` also takes the prefix of a name from its base."""
    keyed = filing_keys(documents, unified)
    return keyed.withColumn("prefix", filing_name(F.col("file_name"))["base"]) if unified else keyed


def without_replaced(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rows of the documents that stay, less their path."""
    return rows.join(replaced, "path", "left_anti").drop("path")


def filing_tables(
    documents: DataFrame, rules: Mapping[str, Iterable[str]] = layout.DEFAULT_RULES
) -> FilingTables:
    """The three results of (path, file_name, text), all lazy."""
    judged = with_status(documents, rules, listed=False)
    facts = flatten_accounts(judged.filter(F.col("status") == "valid"), rules)
    return FilingTables(
        status=judged.select(F.col("file_name").alias("arquivo"), "status", "mensagem"),
        facts=facts,
        balance=balance_qc(facts),
    )


def run(
    spark: SparkSession,
    source: str,
    target: str,
    rules: Mapping[str, Iterable[str]] = layout.DEFAULT_RULES,
    table: str | None = None,
    unified: bool = False,
) -> FilingTables:
    """Read `source`, write silver, run log, rejected files and balance check below `target`.

    Keys are read first, and the paths of replaced versions stored, a narrow list. Judged documents are written once and
    read back, so validation runs once for log and facts. The list is held against the rows of log and facts, after
    flattening, so no text and no parsed document is ever exchanged; the balance check reads the stored facts.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of a key given twice the last counts
    documents = decode_documents(read_files(spark, source))
    keyed = with_version_keys(documents, unified)
    keys = ("cnpj_key", "base_key", "submission")
    replaced = materialise(replaced_filings(keyed.select(*keys, "path"), order="path"), "replaced")
    judged = with_status(keyed.drop(*keys), rules, listed=False)
    stage = f"{target}/judged"
    judged.drop("text", "readable").write.mode("overwrite").parquet(stage)
    stored = spark.read.parquet(stage)
    status = without_replaced(stored.select("path", F.col("file_name").alias("arquivo"), "status", "mensagem"), replaced)
    sinks.write_csv(status, f"{target}/runtime_log")
    rejects = filing_rejects(documents).select(F.col("file_name").alias("arquivo"), "motivo")
    sinks.write_csv_if_any(rejects, f"{target}/rejeitados")
    facts = without_replaced(flatten_accounts(stored.filter(F.col("status") == "valid"), rules, keep=["path"]), replaced)
    sinks.write_silver(facts, f"{target}/silver")
    silver = silver_scan(spark, f"{target}/silver")
    balance = balance_qc(silver)
    sinks.write_csv_if_any(balance, f"{target}/bp_inconsistencias")
    if table:
        sinks.write_table(silver, table)
    return FilingTables(status, silver, balance)
