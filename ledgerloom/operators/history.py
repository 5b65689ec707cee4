"""Histories of institutions as JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import numbered
from ledgerloom.session import materialise

HEADING = "Série Histórica de Dados (JSON):"  # fixed value
ROWS = 1000


def _text(rows: Column) -> Column:
    return F.to_json(rows, {"ignoreNullFields": "false"})


def _short(items: DataFrame, entity: str, rows: int) -> DataFrame:
    """Parts of entities of which each fits in one list: sorted there, then cut."""
    at = [c for c in items.columns if c != entity]
    gathered = items.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(*at))).alias("__all"))
    starts = F.sequence(F.lit(0), F.size("__all") - 1, F.lit(rows))
    parts = F.transform(starts, lambda s: F.slice("__all", s + 1, F.lit(rows)))
    return gathered.select(entity, F.posexplode(parts).alias("part", "__rows")).select(
        entity,
        F.col("part").cast("bigint").alias("part"),
        F.size("__rows").cast("bigint").alias("n"),
        _text(F.transform("__rows", lambda i: i["__row"])).alias("payload"),
    )


def _long(items: DataFrame, entity: str, rows: int) -> DataFrame:
    """Parts of entities of any size: rows are numbered over ranges first, so that a list holds one part."""
    places = numbered(items, [entity], [c for c in items.columns if c != entity], "__at")
    gathered = F.array_sort(F.collect_list(F.struct("__at", "__row")))
    part = F.floor(F.col("__at") / rows).alias("part")
    return places.groupBy(entity, part).agg(
        F.count("*").alias("n"), _text(F.transform(gathered, lambda i: i["__row"])).alias("payload")
    )


def history_payload(panel: DataFrame, entity: str = "inst_hash", rows: int = ROWS) -> DataFrame:
    """(entity, part, n, payload): chronological JSON array of the entity's rows, without the entity itself.

    Rows are ordered by year and month, or by `Semestre_Ref` in a panel without these columns; rows without year or
    month come last. Rows of a semester that occurs more than once are all kept, ordered by their values. An entity of
    at most `rows` rows (500 years of semesters) is one text; a longer history goes on in further parts. The panel is
    stored once and its rows counted by entity: entities of at most 1,000 rows are gathered whole, the rows of others
    numbered over ranges of the sorted rows, so that no list is longer, whatever an entity's share of the panel.
    """
    names = set(panel.columns)
    order = ["Ano", "Mes"] if {"Ano", "Mes"} <= names else ["Semestre_Ref"] if "Semestre_Ref" in names else []
    fields = F.struct(*[F.col(f"`{c}`") for c in panel.columns if c != entity])
    key = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"__no{i}"), F.col(c).alias(f"__key{i}"))]
    items = materialise(panel.select(entity, *key, fields.alias("__row")), "history-rows")
    many = items.groupBy(entity).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > ROWS).select(entity)
    many = materialise(many, "long-histories")
    if many.isEmpty():
        return _short(items, entity, rows)
    own = items[entity].eqNullSafe(many[entity])
    return _short(items.join(many, own, "left_anti"), entity, rows).union(_long(items.join(many, own, "left_semi"), entity, rows))


def user_message(history: DataFrame, entity: str = "inst_hash") -> DataFrame:
    """(entity, part, mensagem): each part of the history wrapped in a text."""
    return history.select(
        entity,
        "part",
        F.concat(F.lit(f"{entity}: "), F.col(entity), F.lit(f"\n\n{HEADING}\n"), F.col("payload")).alias("mensagem"),
    )
