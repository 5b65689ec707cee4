"""Job D: stored responses to a scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.operators.forecasts import clean_responses, payload_fields, prediction_status
from ledgerloom.operators.scorecard import accuracy_tally, scorecard
from ledgerloom.session import materialise
from ledgerloom.sources.tables import csv_typed_scan, institution_headers, mapping_scan, read_prediction_files, truth_files, truth_scan


def usable_predictions(files: DataFrame) -> DataFrame:
    """Fields of usable, readable responses; the payload itself is not carried on."""
    cleaned = clean_responses(files.filter("usable")).filter(F.col("error").isNull())
    return payload_fields(cleaned).drop("text", "payload", "error")


def run(
    spark: SparkSession,
    responses: str,
    mapping: str,
    dataset: str,
    truth: DataFrame | str,
    target: str,
    run_id: str,
    models: list[str] | None = None,
) -> DataFrame:
    """Write the scorecard, its tally and the status of all responses below `target/run=<run_id>`.

    `truth` is a panel, or the folder of the institutions' CSVs, whose problems are then named as reasons.
    """
    files = read_prediction_files(spark, responses)
    predictions = materialise(usable_predictions(files), "predictions")
    if predictions.isEmpty():
        raise ValueError(f"no usable response in {responses}")
    panel, found = truth, None
    if isinstance(truth, str):
        headers = institution_headers(spark, truth)
        panel, found = truth_scan(spark, truth, headers), truth_files(spark, truth, headers)
    card = scorecard(predictions, mapping_scan(spark, mapping), panel_like(spark, dataset), panel, models, files=found)
    place = f"{target}/run={run_id}"
    sinks.write_csv(card, f"{place}/scorecard", ";", bom=True)
    sinks.write_csv(accuracy_tally(card), f"{place}/tally", ";")
    status = prediction_status(clean_responses(files.filter("usable")), keep=("path", "inst_hash", "provider", "model"))
    sinks.write_predictions(status, f"{place}/responses")
    return card


def panel_like(spark: SparkSession, path: str) -> DataFrame:
    """Year and month of a dataset CSV, whatever its other columns."""
    return csv_typed_scan(spark, path, "Ano int, Mes int", ";")

