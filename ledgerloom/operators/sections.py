"""Sectioned extraction records to panel rows, and the drift of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import layout
from ledgerloom.functions import variants as V
from ledgerloom.functions.names import source_name
from ledgerloom.functions.structs import compute_once, record


def with_record(extractions: DataFrame, text: str = "text") -> DataFrame:
    """Add `readable` and `record`: the parsed object, taken out of a one-element list; null for other shapes."""
    parsed = compute_once(extractions, "__json", F.try_parse_json(F.col(text)))
    unwrapped = compute_once(parsed, "record", V.unwrap_single(F.col("__json")))
    return unwrapped.withColumn("readable", F.col("__json").isNotNull()).drop("__json")


def context_columns(file_name: Column) -> list[Column]:
    """The six context columns, read from the name of the source document."""
    source = F.regexp_replace(file_name, r"(?i)\.json$", ".pdf")
    meta = source_name(source)
    return [
        meta["semestre_label"].alias("Semestre_Ref"),
        meta["ano"].alias("Ano"),
        meta["mes"].alias("Mes"),
        meta["yyyymm"].alias("YYYYMM"),
        meta["cnpj8"].alias("CNPJ8"),
        source.alias("Arquivo_PDF"),
    ]


def section_columns(record: Column) -> list[Column]:
    """The 27 section columns in panel order; absent fields are null. Casts tolerate numbers given as text."""
    out = []
    for section, fields in layout.SECTION_FIELDS.items():
        kind = "string" if section == "Identificacao" else "double"
        out += [
            F.try_variant_get(record, f'$["{section}"]["{name}"]', kind).alias(layout.SECTION_PREFIX[section] + name)
            for name in fields
        ]
    return out


def flatten_sections(extractions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Panel rows of (file_name, record); a record of unexpected shape keeps its context only."""
    return extractions.select(*keep, *context_columns(F.col("file_name")), *section_columns(F.col("record")))


def schema_drift(extractions: DataFrame, key: str = "file_name") -> DataFrame:
    """Fields missing from a record, and fields of it that no panel column holds."""
    root = V.as_map(F.col("record"))
    expected = F.array(
        *[F.struct(F.lit(s).alias("secao"), F.lit(f).alias("campo")) for s, fs in layout.SECTION_FIELDS.items() for f in fs]
    )
    present = F.flatten(
        F.transform(
            F.map_entries(root),
            lambda e: F.coalesce(
                F.transform(F.map_keys(V.as_map(e["value"])), lambda k: record(secao=e["key"], campo=k)),
                F.array(),
            ),
        )
    )

    def labelled(items: Column, label: str) -> Column:
        return F.transform(items, lambda i: record(tipo=F.lit(label), secao=i["secao"], campo=i["campo"]))

    return (
        compute_once(extractions.filter(F.col("record").isNotNull()), "__present", present)
        .select(
            key,
            F.explode(
                F.concat(
                    labelled(F.array_except(expected, "__present"), "missing"),
                    labelled(F.array_except(F.col("__present"), expected), "unmapped"),
                )
            ).alias("d"),
        )
        .select(key, "d.tipo", "d.secao", "d.campo")
    )
