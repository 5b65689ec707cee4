"""Stored forecast responses: clean-up, field extraction, ranges back on their real scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import layout
from ledgerloom.functions import variants as V
from ledgerloom.functions.identity import strip
from ledgerloom.functions.names import file_name_of, prediction_name, safe_for_names
from ledgerloom.functions.numbers import first_range
from ledgerloom.functions.structs import compute_once, let
from ledgerloom.operators.joins import lookup_join

# Fixed value: a code fence opening or closing a block
_FENCE = r"(?mdU)^\s*```(?:json)?\s*|\s*```\s*$"


def strip_wrapping(text: Column) -> Column:
    """Text without code fences and without anything before its first `{` or `[`."""
    bare = strip(F.regexp_replace(text, _FENCE, ""))
    return let(bare, lambda b: F.coalesce(F.nullif(F.regexp_substr(b, F.lit(r"(?s)[{\[].*")), F.lit("")), b))


def clean_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add `payload` (VARIANT object, taken out of a one-element list) and `error`; one of the two is null."""
    parsed = compute_once(responses, "__json", F.try_parse_json(strip_wrapping(F.col(text))))
    unwrapped = compute_once(parsed, "payload", V.unwrap_single(F.col("__json")))
    return unwrapped.withColumn(
        "error",
        F.when(F.col("__json").isNull(), "response is not valid JSON").when(
            F.col("payload").isNull(), "response is not a JSON object"
        ),
    ).drop("__json")


def payload_columns(payload: Column) -> dict[str, Column]:
    """Outcome, viability, target semester and range text; each is looked up nested first, then at the root."""
    nested = V.field(payload, "predicao_proximo_semestre")

    def pick(name: str) -> Column:
        return F.coalesce(V.given(V.field(nested, name)), V.given(V.field(payload, name)))

    return {
        "resultado": V.as_text(pick("resultado_final_esperado")),
        "viabilidade": V.as_text(pick("viabilidade_operacional")),
        "semestre_alvo": V.as_text(pick("semestre_alvo")),
        "faixa_bruta": V.as_text(V.field(pick("projecao_resultado_absoluto"), "faixa_estimada_valor")),
    }


def result_cell(outcome: Column, viability: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        " | ",
        F.coalesce(F.nullif(outcome, blank), F.lit("?")),
        F.coalesce(F.nullif(viability, blank), F.lit("?")),
    )


def payload_fields(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the four fields and `resultado_celula`."""
    fields = F.struct(*[c.alias(n) for n, c in payload_columns(F.col(payload)).items()])
    with_fields = compute_once(responses, "__fields", fields).select(*responses.columns, "__fields.*")
    return with_fields.withColumn("resultado_celula", result_cell(F.col("resultado"), F.col("viabilidade")))


def parse_prediction_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add inst_hash, provider, model and `usable`; failures and foreign names are not usable."""
    meta = prediction_name(file_name_of(F.col(path)))
    return files.select(
        "*",
        meta["inst_hash"].alias("inst_hash"),
        meta["provider"].alias("provider"),
        meta["model"].alias("model"),
        meta.isNotNull().alias("usable"),
    )


def prediction_file_name(inst_hash: Column, provider: Column, model: Column, failed: Column) -> Column:
    ending = F.when(failed, F.lit(".error.json")).otherwise(F.lit(".json"))
    return F.concat(inst_hash, F.lit("_"), provider, F.lit("-"), safe_for_names(model), ending)


def with_range(predictions: DataFrame, literal: bool = True) -> DataFrame:
    """Add `faixa`, the amounts of the range text as struct<low, high>."""
    return compute_once(predictions, "faixa", first_range(F.col("faixa_bruta"), literal))


def real_range(raw: Column, found: Column, factor: Column) -> Column:
    """struct<texto, minimo, maximo>: the range divided by the factor, or the reason why there is none.

    `found` is the struct<low, high> of the amounts in `raw`.
    """
    note = F.concat(F.lit(" [bruto: "), raw, F.lit("]"))
    low, high = found["low"] / F.nullif(factor, F.lit(0.0)), found["high"] / F.nullif(factor, F.lit(0.0))
    no_factor = factor.isNull() | (factor == 0)
    usable = ~no_factor & found.isNotNull() & (F.coalesce(raw, F.lit("")) != "")
    text = (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(layout.NO_RANGE))
        .when(no_factor, F.concat(F.lit("N/A (fator inválido)"), note))
        .when(found.isNull(), F.concat(F.lit("N/A (não foi possível extrair números)"), note))
        .otherwise(
            F.concat(F.lit("Entre R$ "), F.format_number(low, 0), F.lit(" e R$ "), F.format_number(high, 0))
        )
    )
    return F.struct(
        text.alias("texto"), F.when(usable, low).alias("minimo"), F.when(usable, high).alias("maximo")
    )


def deanonymize_range(predictions: DataFrame, identities: DataFrame, literal: bool = True) -> DataFrame:
    """Add faixa_real, minimo, maximo to rows with inst_hash and faixa_bruta.

    `identities` has one row per hash with Fator_Escalonamento (see `latest_identity`).
    """
    factors = identities.select("inst_hash", F.col("Fator_Escalonamento").alias("__factor"))
    joined = lookup_join(with_range(predictions, literal), factors, ["inst_hash"])
    ranged = joined.withColumn("__range", real_range(F.col("faixa_bruta"), F.col("faixa"), F.col("__factor")))
    return ranged.select(
        *predictions.columns, F.col("__range.texto").alias("faixa_real"), "__range.minimo", "__range.maximo"
    )


def prediction_status(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per cleaned response: success, error and the name of the file it belongs to."""
    failed = F.col("error").isNotNull()
    return responses.select(
        *keep,
        prediction_file_name(F.col("inst_hash"), F.col("provider"), F.col("model"), failed).alias("arquivo"),
        (~failed).alias("success"),
        "error",
    )
