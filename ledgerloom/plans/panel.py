"""Job C, first half: stored extraction records to panel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.operators.sections import flatten_sections
from ledgerloom.sources.tables import read_extractions


def panel_from_extractions(extractions: DataFrame, only: str | None = None) -> DataFrame:
    """Panel of readable records; `only` restricts it to one institution."""
    rows = flatten_sections(extractions.filter("readable")).filter(F.col("CNPJ8").isNotNull())
    return rows if only is None else rows.filter(F.col("CNPJ8") == only)


def run(spark: SparkSession, source: str, target: str, only: str | None = None) -> DataFrame:
    panel = panel_from_extractions(read_extractions(spark, source), only)
    sinks.write_panel(panel, target)
    return panel
