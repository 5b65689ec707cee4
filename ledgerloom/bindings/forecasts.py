"""Queries over forecast responses: clean-up, ranges, pivot, truth, scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.bindings import inputs as I
from ledgerloom.bindings.filings import pad8
from ledgerloom.bindings.panels import entity_hash, factor, rounded
from ledgerloom.functions.identity import cnpj8_of
from ledgerloom.functions.numbers import amounts_in, first_range
from ledgerloom.operators import forecasts as FC
from ledgerloom.operators import scorecard as SC
from ledgerloom.operators.joins import lookup_join
from ledgerloom.operators.summary import prediction_stats as prediction_stats_of
from ledgerloom.session import new_table_path
from ledgerloom.sources import tables as T

# --- queries ---------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses with the fields of their names (the event columns of the same names are dropped)."""
    return FC.parse_prediction_files(I.response_texts(spark, sf_dir).drop("inst_hash", "model"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = FC.clean_responses(_files(spark, sf_dir).filter("usable")).filter(F.col("error").isNull())
    return FC.payload_fields(cleaned).select(
        "event_id", "path", "inst_hash", "provider", "model", "resultado", "viabilidade", "semestre_alvo",
        "faixa_bruta", "resultado_celula",
    )


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    identities = SC.latest_identity(I.user_mapping(spark, sf_dir))
    return FC.deanonymize_range(_predictions(spark, sf_dir), identities)


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.scorecard(
        _predictions(spark, sf_dir),
        I.user_mapping(spark, sf_dir),
        I.user_dataset(spark, sf_dir),
        I.user_panel(spark, sf_dir),
        I.MODELS,
        order="path",
    )


def parse_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("event_id", "inst_hash", "provider", "model", "usable")


def clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that responses hold once they are parsed, or why they can't be."""
    cleaned = FC.payload_fields(FC.clean_responses(I.response_texts(spark, sf_dir)))
    fields = ("resultado", "viabilidade", "semestre_alvo", "faixa_bruta")
    return cleaned.select("event_id", F.col("payload").isNotNull().alias("ok"), "error", *fields)


def forecast_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by hash as a map from model to cell, whichever models there are."""
    cells = SC.forecast_cells(_predictions(spark, sf_dir), "path", ("resultado_celula", "faixa_bruta"))
    return cells.select("inst_hash", F.explode("cells").alias("modelo", "c")).select("inst_hash", "modelo", "c.*")


def scorecard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard written as CSV and read back."""
    path, card = new_table_path(spark, "scorecard"), _card(spark, sf_dir)
    sinks.write_csv(card, path, ";", bom=True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in card.schema.fields)
    return T.csv_typed_scan(spark, path, kinds, ";")


def prediction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of responses, written with success and error apart and read back."""
    path = new_table_path(spark, "responses")
    sinks.write_predictions(prediction_status(spark, sf_dir), path)
    return spark.read.schema("event_id bigint, arquivo string, error string, success boolean").parquet(path)


def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select(
        "event_id", "resultado", "viabilidade", "semestre_alvo", "faixa_bruta", "resultado_celula"
    )


def extract_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.forecast_events(spark, sf_dir).select("event_id", first_range(I.range_text()).alias("r"))
    return found.select("event_id", "r.low", "r.high")


def parse_locale_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First amount of a text that holds the same value in the notation of the event type."""
    cents = F.rint(F.col("value") * 100.0).cast("bigint")
    whole = F.expr("cast(rint(value * 100.0) as bigint) div 100")
    decimals = F.lpad((cents % 100).cast("string"), 2, "0")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(whole.cast("string"), F.lit(","), decimals))
        .when(kind == "view", F.concat(whole.cast("string"), F.lit("."), decimals, F.lit(" mil")))
        .when(kind == "purchase", F.concat(F.lit("R$ "), F.format_number(cents * 1000, 2), F.lit("B")))
        .when(
            kind == "signup",
            F.concat(F.translate(F.format_number(cents * 1000, 0), ",", "."), F.lit(",50")),
        )
        .otherwise(F.concat(F.lit("0."), F.lpad((cents % 1000).cast("string"), 3, "0")))
    )
    return I.table(spark, sf_dir, "events").select("event_id", F.get(amounts_in(text), F.lit(0)).alias("numero"))


def deanonymize_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).select("event_id", "faixa_real", "minimo", "maximo")


def latest_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.latest_identity(I.user_mapping(spark, sf_dir))


def pivot_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("inst_hash", "provider", "model", "path", "resultado_celula", "faixa_real")
    return SC.pivoted_texts(_ranged(spark, sf_dir).select(*fields), I.MODELS, order="path")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    institutions = SC.latest_identity(I.user_mapping(spark, sf_dir)).withColumn(
        "CNPJ8", cnpj8_of(F.col("Ident__CNPJ"))
    )
    target = SC.next_period(I.user_dataset(spark, sf_dir)).scalar()
    return SC.ground_truth(institutions, I.user_panel(spark, sf_dir), target)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).select("inst_hash", "CNPJ8", "Real_Resultado", "Real_Lucro_Liquido")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _truth(spark, sf_dir).select("inst_hash", "Real_Resultado")
    scored = lookup_join(_predictions(spark, sf_dir), truth, ["inst_hash"])
    return scored.select(
        "event_id", SC.accuracy(F.col("resultado_celula"), F.col("Real_Resultado")).alias("acuracia")
    )


def accuracy_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.accuracy_tally(_card(spark, sf_dir))


def prediction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = I.response_texts(spark, sf_dir).withColumnRenamed("event_type", "provider")
    return FC.prediction_status(FC.clean_responses(responses), keep=("event_id",))


def prediction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = I.response_texts(spark, sf_dir).withColumnRenamed("event_type", "provider")
    return prediction_stats_of(FC.prediction_status(FC.clean_responses(responses), keep=("provider", "model")))


QUERIES = {
    "parse_prediction_files": parse_prediction_files,
    "clean_responses": clean_responses,
    "forecast_cells": forecast_cells,
    "scorecard_store": scorecard_store,
    "prediction_store": prediction_store,
    "payload_fields": payload_fields,
    "extract_ranges": extract_ranges,
    "parse_locale_number": parse_locale_number,
    "deanonymize_range": deanonymize_range,
    "latest_identity": latest_identity,
    "pivot_predictions": pivot_predictions,
    "ground_truth": ground_truth,
    "accuracy": accuracy,
    "accuracy_tally": accuracy_tally,
    "scorecard": _card,
    "prediction_status": prediction_status,
    "prediction_stats": prediction_stats,
}

# --- the same in SQL -------------------------------------------------------------------------------------------

_MODELS = I.MODELS

_EVENTS = f"""
base AS (
  SELECT event_id, ts, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round_even(value * 100.0::DOUBLE, 0) AS BIGINT) AS n,
         {entity_hash(pad8('user_id'))} AS inst_hash,
         CASE WHEN value < 20 THEN 'alpha-1.5' WHEN value < 60 THEN 'beta' ELSE 'gamma' END AS model
  FROM events),
spans AS (
  SELECT *,
         CASE kind WHEN 'click' THEN CAST(n * 1000 AS DOUBLE)
                   WHEN 'view' THEN CAST((n // 10) || '.' || (n % 10) AS DOUBLE) * 1000000.0::DOUBLE
                   WHEN 'purchase' THEN -CAST(n * 1000 AS DOUBLE)
                   WHEN 'signup' THEN CAST(n * 1000 AS DOUBLE)
                   ELSE CASE WHEN value < 100 THEN CAST(printf('%.2f', value) AS DOUBLE) END END AS low,
         CASE kind WHEN 'click' THEN CAST(n * 2000 AS DOUBLE)
                   WHEN 'view' THEN CAST(n AS DOUBLE) * 1000000.0::DOUBLE
                   WHEN 'purchase' THEN CAST(n * 2000 AS DOUBLE)
                   WHEN 'signup' THEN CAST(n * 2000 AS DOUBLE)
                   ELSE CASE WHEN value < 100 THEN CAST(printf('%.2f', value) AS DOUBLE) END END AS high,
         CASE kind WHEN 'click' THEN 'Entre ' || replace(format('{{:,}}', n * 1000), ',', '.') || ' e '
                                     || replace(format('{{:,}}', n * 2000), ',', '.')
                   WHEN 'view' THEN 'Entre R$ ' || (n // 10) || ',' || (n % 10) || 'M e R$ ' || n || 'M'
                   WHEN 'purchase' THEN 'entre -' || replace(format('{{:,}}', n * 1000), ',', '.') || ' e '
                                        || replace(format('{{:,}}', n * 2000), ',', '.')
                   WHEN 'signup' THEN (n * 1000) || ' a ' || (n * 2000)
                   ELSE CASE WHEN value < 100 THEN 'cerca de ' || printf('%.2f', value) ELSE 'sem estimativa' END
         END AS span_text,
         NOT (kind = 'error' AND k < 10) AND NOT (kind = 'signup' AND k < 5) AS usable,
         CASE WHEN kind = 'error' AND value < 15 THEN 'response is not valid JSON'
              WHEN kind = 'error' AND value < 25 THEN 'response is not a JSON object' END AS error,
         nullif(CASE WHEN k >= 95 THEN '' WHEN k >= 40 THEN 'Lucro' ELSE 'Prejuízo' END, '') AS resultado,
         nullif(CASE WHEN k < 50 THEN 'Saudável' WHEN k < 80 THEN 'Atenção' WHEN k < 90 THEN 'Alto Risco' ELSE '' END, '')
           AS viabilidade
  FROM base),
predictions AS (
  SELECT event_id, inst_hash, upper(kind) || '_' || model AS col, resultado, viabilidade, '2024-S1' AS semestre_alvo,
         CASE WHEN k < 90 THEN span_text END AS faixa_bruta,
         CASE WHEN k < 90 THEN low END AS low, CASE WHEN k < 90 THEN high END AS high,
         coalesce(resultado, '?') || ' | ' || coalesce(viabilidade, '?') AS resultado_celula
  FROM spans WHERE usable AND error IS NULL),
user_semesters AS (
  SELECT {pad8('user_id')} AS cnpj8, user_id, day(ts) > 15 AS late, sum(CAST(value AS DECIMAL(18, 2))) AS total,
         count(*) AS n, max(value) AS top
  FROM events GROUP BY user_id, day(ts) > 15),
mapping AS (
  SELECT {entity_hash('cnpj8')} AS inst_hash, CASE WHEN late THEN '2024-S1' ELSE '2023-S2' END AS semestre,
         CASE WHEN late AND top > 250 THEN NULL WHEN late AND top > 200 THEN '' ELSE cnpj8 || '000191' END AS cnpj,
         'Inst ' || user_id || ' ' || CASE WHEN late THEN '2024-S1' ELSE '2023-S2' END AS nome
  FROM user_semesters),
identities AS (
  SELECT inst_hash, arg_max(nome, semestre) AS nome, arg_max(cnpj, semestre) FILTER (WHERE cnpj IS NOT NULL) AS cnpj,
         {rounded(factor('inst_hash'), 6)} AS f
  FROM mapping GROUP BY inst_hash),
ranged AS (
  SELECT p.*,
         low / f AS minimo, high / f AS maximo,
         CASE WHEN faixa_bruta IS NULL THEN 'N/A (LLM não informou faixa)'
              WHEN low IS NULL THEN 'N/A (não foi possível extrair números) [bruto: ' || faixa_bruta || ']'
              ELSE 'Entre R$ ' || format('{{:,.0f}}', low / f) || ' e R$ ' || format('{{:,.0f}}', high / f) END AS faixa_real
  FROM predictions p JOIN identities USING (inst_hash)),
institutions AS (
  SELECT inst_hash, nome, f, coalesce(substr(cnpj, 1, 8), '') AS cnpj8 FROM identities),
actual AS (
  SELECT cnpj8, late, CASE WHEN top <= 300 THEN CAST(total - n * 50 AS DOUBLE) END AS net
  FROM user_semesters WHERE total > 1300),
truth AS (
  SELECT i.inst_hash, i.cnpj8, i.nome, i.f,
         CASE WHEN i.cnpj8 = '' THEN 'N/A (sem CNPJ ou semestre)'
              WHEN i.cnpj8 NOT IN (SELECT cnpj8 FROM actual) THEN 'N/A (arquivo ' || i.cnpj8 || '.csv não encontrado)'
              WHEN a.cnpj8 IS NULL THEN 'N/A (2024-S1 ainda não disponível)'
              WHEN a.net IS NULL THEN 'N/A (2024-S1 com valor inválido)'
              WHEN a.net > 0 THEN 'Lucro' WHEN a.net < 0 THEN 'Prejuízo' ELSE 'Neutro (zero)' END AS real_resultado,
         a.net AS real_lucro
  FROM institutions i LEFT JOIN actual a ON a.cnpj8 = i.cnpj8 AND a.late AND i.cnpj8 <> ''),
firsts AS (
  SELECT inst_hash, col, arg_min(resultado_celula, event_id) AS celula, arg_min(faixa_real, event_id) AS faixa
  FROM ranged GROUP BY inst_hash, col),
wide AS (
  SELECT inst_hash, {', '.join(
      f"coalesce(max(CASE WHEN col = '{m}' THEN celula END), 'INDISPONÍVEL') AS \"{m}_Resultado\", "
      f"coalesce(max(CASE WHEN col = '{m}' THEN faixa END), 'INDISPONÍVEL') AS \"{m}_Lucro_Projetado_Real\""
      for m in _MODELS)}
  FROM firsts GROUP BY inst_hash)"""


def _verdict(cell: str) -> str:
    said = f"trim(split_part({cell}, '|', 1))"
    return (
        f"CASE WHEN {said} NOT IN ('Lucro', 'Prejuízo') OR real_resultado NOT IN ('Lucro', 'Prejuízo') THEN '—' "
        f"WHEN {said} = real_resultado THEN '✓ Acertou' ELSE '✗ Errou' END"
    )


_CARD = f"""{_EVENTS},
card AS (
  SELECT nome AS Ident__Razao_Social, cnpj8 AS CNPJ8, inst_hash, '2024-S1' AS Semestre_Alvo_Inferido,
         f AS Fator_Desanonimizacao_Usado,
         {', '.join(f'"{m}_Resultado", "{m}_Lucro_Projetado_Real"' for m in _MODELS)},
         real_resultado AS Real_Resultado, real_lucro AS Real_Lucro_Liquido,
         {', '.join('{} AS "Real_Acuracia_{}"'.format(_verdict(f'"{m}_Resultado"'), m) for m in _MODELS)}
  FROM wide JOIN truth USING (inst_hash))"""

ORACLES = {
    "parse_prediction_files": f"""WITH {_EVENTS}
        SELECT event_id, CASE WHEN usable THEN inst_hash END AS inst_hash, CASE WHEN usable THEN kind END AS provider,
               CASE WHEN usable THEN model END AS model, usable FROM spans""",
    "clean_responses": f"""WITH {_EVENTS}
        SELECT event_id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN resultado END AS resultado,
               CASE WHEN error IS NULL THEN viabilidade END AS viabilidade,
               CASE WHEN error IS NULL THEN '2024-S1' END AS semestre_alvo,
               CASE WHEN error IS NULL AND k < 90 THEN span_text END AS faixa_bruta FROM spans""",
    "forecast_cells": f"""WITH {_EVENTS}
        SELECT inst_hash, col AS modelo, arg_min(resultado_celula, event_id) AS resultado_celula,
               arg_min(struct_pack(f := faixa_bruta), event_id).f AS faixa_bruta
        FROM predictions GROUP BY inst_hash, col""",
    "scorecard_store": f"WITH {_CARD} SELECT * REPLACE (nullif(CNPJ8, '') AS CNPJ8) FROM card",
    "prediction_store": f"""WITH {_EVENTS}
        SELECT event_id, inst_hash || '_' || kind || '-' || model
               || CASE WHEN error IS NULL THEN '.json' ELSE '.error.json' END AS arquivo,
               error IS NULL AS success, error FROM spans""",
    "payload_fields": f"""WITH {_EVENTS}
        SELECT event_id, resultado, viabilidade, semestre_alvo, faixa_bruta, resultado_celula FROM predictions""",
    "extract_ranges": f"WITH {_EVENTS} SELECT event_id, low, high FROM spans",
    "parse_locale_number": """
        WITH n AS (SELECT event_id, event_type AS kind, CAST(round_even(value * 100.0::DOUBLE, 0) AS BIGINT) AS c FROM events)
        SELECT event_id,
               CASE kind WHEN 'click' THEN CAST((c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS DOUBLE)
                         WHEN 'view' THEN CAST((c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 1000.0::DOUBLE
                         WHEN 'purchase' THEN CAST(c * 1000 AS DOUBLE) * 1000000000.0::DOUBLE
                         WHEN 'signup' THEN CAST(c * 1000 AS DOUBLE) + 0.5::DOUBLE
                         ELSE CAST('0.' || lpad(CAST(c % 1000 AS VARCHAR), 3, '0') AS DOUBLE) END AS numero
        FROM n""",
    "deanonymize_range": f"WITH {_EVENTS} SELECT event_id, faixa_real, minimo, maximo FROM ranged",
    "latest_identity": f"""WITH {_EVENTS}
        SELECT inst_hash, nome AS Ident__Razao_Social, cnpj AS Ident__CNPJ, f AS Fator_Escalonamento FROM identities""",
    "pivot_predictions": f"WITH {_EVENTS} SELECT * FROM wide",
    "ground_truth": f"""WITH {_EVENTS}
        SELECT inst_hash, cnpj8 AS CNPJ8, real_resultado AS Real_Resultado, real_lucro AS Real_Lucro_Liquido FROM truth""",
    "accuracy": f"""WITH {_EVENTS}
        SELECT event_id, {_verdict('resultado_celula')} AS acuracia
        FROM predictions JOIN truth USING (inst_hash)""",
    "accuracy_tally": f"""WITH {_CARD},
        long AS ({' UNION ALL '.join(
            f"SELECT '{m}' AS modelo, " + f'"Real_Acuracia_{m}" AS veredito FROM card' for m in _MODELS)})
        SELECT modelo, veredito, count(*) AS n FROM long GROUP BY modelo, veredito""",
    "scorecard": f"WITH {_CARD} SELECT * FROM card",
    "prediction_status": f"""WITH {_EVENTS}
        SELECT event_id, inst_hash || '_' || kind || '-' || model
               || CASE WHEN error IS NULL THEN '.json' ELSE '.error.json' END AS arquivo,
               error IS NULL AS success, error FROM spans""",
    "prediction_stats": f"""WITH {_EVENTS}
        SELECT kind AS provider, model, count(*) FILTER (WHERE error IS NULL) AS sucessos,
               count(*) FILTER (WHERE error IS NOT NULL) AS falhas
        FROM spans GROUP BY kind, model""",
}
