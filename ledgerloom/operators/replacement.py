"""Choosing between versions of one filing, and skipping work that is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import filing_name
from ledgerloom.operators.contract import STRICT
from ledgerloom.operators.joins import lookup_join


FOREIGN_NAME, UNREADABLE = "nome fora do padrão", "JSON ilegível"


def _with_keys(documents: DataFrame, unified: bool, header: Column | None) -> DataFrame:
    """Add `cnpj_key`, `base_key`, `submission`, and `motivo` where there are none."""
    if header is None:
        header = F.from_json("text", "`@cnpj` string, `@dataBase` string, `@tipoRemessa` string", STRICT)
    named = documents.withColumn("__name", filing_name(F.col("file_name"))).withColumn("__head", header)
    dated = F.col("__name.style") == "dated"
    base = F.col("__head.`@dataBase`")
    if unified:
        base = F.concat(F.substring(base, 3, 4), F.substring(base, 1, 2))
    keyed = named.withColumn("cnpj_key", F.when(dated, F.col("__head.`@cnpj`")).otherwise(F.col("__name.cnpj")))
    keyed = keyed.withColumns(
        {
            "base_key": F.when(dated, base).otherwise(F.col("__name.base")),
            "submission": F.when(dated, F.coalesce("__head.`@tipoRemessa`", F.lit("I"))).otherwise(F.col("__name.submission")),
            "motivo": F.when(F.col("__name.style").isNull(), FOREIGN_NAME).when(F.col("cnpj_key").isNull(), UNREADABLE),
        }
    )
    return keyed.drop("__name", "__head")


def filing_keys(documents: DataFrame, unified: bool = False, header: Column | None = None) -> DataFrame:
    """Add `cnpj_key`, `base_key` and `submission`; documents without keys are dropped (`filing_rejects` has them).

    A dated name takes the three fields from the document (submission I when absent), a typed name from itself.
    Written as they are, the two kinds hold the base as MMYYYY and YYYYMM and so never meet; `unified` writes
    both as YYYYMM. `header` is a struct with `@cnpj`, `@dataBase`, `@tipoRemessa`; by default it is parsed from
    `text`.
    """
    return _with_keys(documents, unified, header).filter(F.col("motivo").isNull()).drop("motivo")


def filing_rejects(documents: DataFrame, header: Column | None = None) -> DataFrame:
    """The documents that `filing_keys` leaves out, with `motivo`: a name outside both patterns, or a dated name whose
    document has no readable institution."""
    rejected = _with_keys(documents, False, header).filter(F.col("motivo").isNotNull())
    return rejected.select(*documents.columns, "motivo")


def replaced_filings(
    filings: DataFrame, keys: tuple[str, ...] = ("cnpj_key", "base_key"), kind: str = "submission", order: str = "file_name"
) -> DataFrame:
    """The `order` values of filings that another one of their key replaces; reads nothing but keys, kind and order.

    A substitution (S) stays before anything else, then the first by `order`. The winner is found by a partial
    aggregate over keys that occur more than once, and laid beside their filings.
    """
    narrow = filings.select(*keys, kind, order)
    rank = F.struct(F.when(F.col(kind) == "S", 0).otherwise(1).alias("r"), F.col(order).alias("o"))
    repeated = narrow.groupBy(*keys).agg(F.min(rank).alias("__best"), F.count("*").alias("__n")).filter(F.col("__n") > 1)
    beside = lookup_join(narrow, repeated.select(*keys, F.col("__best.o").alias("__winner")), list(keys), "inner")
    return beside.filter(F.col(order) != F.col("__winner")).select(order)


def dedup_replacement(
    filings: DataFrame, keys: tuple[str, ...] = ("cnpj_key", "base_key"), kind: str = "submission", order: str = "file_name"
) -> DataFrame:
    """Keep one filing per key: a substitution (S) before anything else, then the first by `order`.

    `order` must tell the filings apart. Filings are only laid beside the list of replaced ones, which is as short as
    replacements are rare; it is broadcast if its measured size allows, and then no content is exchanged.
    """
    gone = replaced_filings(filings, keys, kind, order).withColumnRenamed(order, "__gone")
    return filings.join(gone, F.col(order) == F.col("__gone"), "left_anti")


def resume_pending(found: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work not stored yet; `force` gives all of it."""
    if force:
        return found
    return found.join(done.select(*keys).distinct(), keys, "left_anti")
