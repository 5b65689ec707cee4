import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.names import prediction_name, safe_for_names
from ledgerloom.functions.numbers import first_range
from ledgerloom.operators import forecasts as FC
from ledgerloom.operators import scorecard as SC

H = "a" * 64
G = "b" * 64

RANGES = {
    "Entre 12.500.000 e 18.000.000": (12.5e6, 18e6),
    "Entre R$ 12,5M e R$ 18M": (12.5e6, 18e6),
    "entre -500.000 e 1.200.000": (-500e3, 1.2e6),
    "5000000 a 8000000": (5e6, 8e6),
    "12.5": (12.5, 12.5),
    "1,5 a 2,25": (1.5, 2.25),
    "0.125 a 0,250": (0.125, 0.25),
    "12,500,000": (12.5e6, 12.5e6),
    "1.234,56 a 1,234.56": (1234.56, 1234.56),
    "R$ 3 mil": (3000.0, 3000.0),
    "2 bi e 3 MM": (2e9, 3e6),
    "1.234.56 e 7": (7.0, 7.0),
    "sem número": None,
    "": None,
    None: None,
    # the literal reading of suffixes and signs
    "12 milhões": (12000.0, 12000.0),
    "12 meses": (12e6, 12e6),
    "100-200": (100.0, -200.0),
    "-R$ 500": (500.0, 500.0),
}
STRICT = {
    "12 milhões": (12e6, 12e6),
    "12 meses": (12.0, 12.0),
    "100-200": (100.0, 200.0),
    "-R$ 500 a 1 milhão": (-500.0, 1e6),
    "Entre -5,5M e 3 bi": (-5.5e6, 3e9),
}


@pytest.mark.parametrize(("cases", "literal"), [(RANGES, True), (STRICT, False)])
def test_ranges(spark, cases, literal):
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(first_range(F.col("t"), literal).alias("r"))
    got = [None if r.r is None else tuple(r.r) for r in df.collect()]
    assert dict(zip(cases, got, strict=True)) == cases


def test_real_ranges(spark):
    cases = [
        ("Entre 1.000.000 e 2.000.000", 2.0, "Entre R$ 500,000 e R$ 1,000,000"),
        ("Entre 1.000.000 e 2.000.000", None, "N/A (fator inválido) [bruto: Entre 1.000.000 e 2.000.000]"),
        ("Entre 1.000.000 e 2.000.000", 0.0, "N/A (fator inválido) [bruto: Entre 1.000.000 e 2.000.000]"),
        ("nada", 2.0, "N/A (não foi possível extrair números) [bruto: nada]"),
        ("", 2.0, "N/A (LLM não informou faixa)"),
        (None, None, "N/A (LLM não informou faixa)"),
    ]
    df = spark.createDataFrame(cases, "faixa_bruta string, f double, e string")
    got = FC.with_range(df).select("e", FC.real_range(F.col("faixa_bruta"), F.col("faixa"), F.col("f"))["texto"])
    assert all(a == b for a, b in got.collect())


def test_names(spark):
    names = {
        f"{H}_openai-gpt-4.1.json": (H, "openai", "gpt-4.1"),
        f"{H.upper()}_Groq-meta-llama-x.json": (H.upper(), "Groq", "meta-llama-x"),
        f"{H}_openai-gpt.error.json": None,
        f"{H[1:]}_openai-gpt.json": None,
        f"{H}_open1ai-gpt.json": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select(prediction_name(F.col("n")).alias("p"))
    assert [None if r.p is None else tuple(r.p) for r in df.collect()] == list(names.values())
    assert spark.range(1).select(safe_for_names(F.lit('a/b:c"d'))).first()[0] == "a-b-c-d"


def test_clean_responses(spark):
    body = '{"a": {"b": [1, 2]}}'
    good = [body, f"```json\n{body}\n```", f"```\n{body}```", f"Aqui está:\n\n{body}", f"[{body}]", f"Lista: [{body}]", f"  {body}\n"]
    bad = ["", "nada", '{"a": ', "[1, 2]", f"[{body}, {body}]", '"texto"', None]
    df = spark.createDataFrame([(t,) for t in good + bad], "text string")
    got = FC.clean_responses(df).select(F.to_json("payload").alias("p"), "error").collect()
    assert [json.loads(r.p) for r in got[: len(good)]] == [json.loads(body)] * len(good)
    assert all(r.p is None and r.error for r in got[len(good) :])
    assert len(got) == len(good + bad)


def test_fields_fall_back_to_the_root(spark):
    payloads = [
        {"predicao_proximo_semestre": {"resultado_final_esperado": "Lucro", "semestre_alvo": "2025-S1",
                                       "projecao_resultado_absoluto": {"faixa_estimada_valor": "1 a 2"}}},
        {"predicao_proximo_semestre": {"resultado_final_esperado": "", "viabilidade_operacional": 0},
         "resultado_final_esperado": "Prejuízo", "viabilidade_operacional": "Atenção"},
        {"resultado_final_esperado": None, "projecao_resultado_absoluto": "1 a 2"},
        {"predicao_proximo_semestre": None, "projecao_resultado_absoluto": {"faixa_estimada_valor": ""}},
    ]
    df = FC.payload_fields(FC.clean_responses(spark.createDataFrame([(json.dumps(p),) for p in payloads], "text string")))
    got = [tuple(r) for r in df.select("resultado", "viabilidade", "semestre_alvo", "faixa_bruta", "resultado_celula").collect()]
    assert got == [
        ("Lucro", None, "2025-S1", "1 a 2", "Lucro | ?"),
        ("Prejuízo", "Atenção", None, None, "Prejuízo | Atenção"),
        (None, None, None, None, "? | ?"),
        (None, None, None, "", "? | ?"),
    ]


def mapping(spark, *rows_):
    return spark.createDataFrame(
        rows_, "inst_hash string, Semestre_Ref string, Ident__CNPJ string, Ident__Razao_Social string, Fator_Escalonamento double"
    )


def test_latest_identity_skips_gaps(spark):
    m = mapping(
        spark, (H, "2024-S1", None, "Novo", 2.0), (H, "2023-S1", "12345678000191", "Velho", 2.0), (H, "2022-S1", "1", "X", None)
    )
    assert tuple(SC.latest_identity(m).first()) == (H, "Novo", "12345678000191", 2.0)


def test_scorecard(spark):
    p = spark.createDataFrame(
        [
            (H, "openai", "gpt-4.1", "f1", "Lucro | Saudável", "Entre 2000 e 4000"),
            (H, "OpenAI", "gpt-4.1", "f2", "Prejuízo | ?", None),
            (H, "groq", "x", "f3", "Prejuízo | ?", None),
            (G, "groq", "x", "f4", "? | ?", "nada"),
        ],
        "inst_hash string, provider string, model string, file_name string, resultado_celula string, faixa_bruta string",
    )
    m = mapping(spark, (H, "2024-S2", "12345678000191", "Inst H", 2.0))
    dataset = spark.createDataFrame([(2024, 6), (2024, 12), (2023, 12)], "Ano int, Mes int")
    truth = spark.createDataFrame(
        [("12345678", " 2025-S1 ", "202506", 5.0), ("12345678", "2024-S2", "202412", -5.0)],
        "CNPJ8 string, Semestre_Ref string, YYYYMM string, Contas__Lucro_Liquido double",
    )
    card = SC.scorecard(p, m, dataset, truth)
    assert card.columns == [
        "Ident__Razao_Social", "CNPJ8", "inst_hash", "Semestre_Alvo_Inferido", "Fator_Desanonimizacao_Usado",
        "GROQ_x_Resultado", "GROQ_x_Lucro_Projetado_Real",
        "OPENAI_gpt-4.1_Resultado", "OPENAI_gpt-4.1_Lucro_Projetado_Real",
        "Real_Resultado", "Real_Lucro_Liquido", "Real_Acuracia_GROQ_x", "Real_Acuracia_OPENAI_gpt-4.1",
    ]
    by = {r.inst_hash: tuple(r) for r in card.collect()}
    assert by[H] == (
        "Inst H", "12345678", H, "2025-S1", 2.0, "Prejuízo | ?", "N/A (LLM não informou faixa)", "Lucro | Saudável",
        "Entre R$ 1,000 e R$ 2,000", "Lucro", 5.0, "✗ Errou", "✓ Acertou",
    )
    assert by[G] == (
        None, "", G, "2025-S1", None, "? | ?", "N/A (fator inválido) [bruto: nada]", "INDISPONÍVEL", "INDISPONÍVEL",
        "N/A (sem CNPJ ou semestre)", None, "—", "—",
    )
    tally = {(r.modelo, r.veredito): r.n for r in SC.accuracy_tally(card).collect()}
    assert tally == {("GROQ_x", "✗ Errou"): 1, ("GROQ_x", "—"): 1, ("OPENAI_gpt-4.1", "✓ Acertou"): 1, ("OPENAI_gpt-4.1", "—"): 1}
    without = SC.scorecard(p, m)
    assert {r.Real_Resultado for r in without.collect()} == {"N/A (ground truth não consultado)"}
    assert {r.Semestre_Alvo_Inferido for r in without.collect()} == {"N/A"}


def test_truth_reasons(spark):
    panel = spark.createDataFrame(
        [("1", "2025-S1", "202506", 1.0), ("2", "2024-S2", "202412", 1.0), ("3", "2025-S1", "202506", None), ("4", "2025-S1", "202506", 0.0)],
        "CNPJ8 string, Semestre_Ref string, YYYYMM string, Contas__Lucro_Liquido double",
    )
    inst = spark.createDataFrame([(str(i), c) for i, c in enumerate(["1", "2", "3", "4", "5", "", ""])], "inst_hash string, CNPJ8 string")
    got = {r.inst_hash: r.Real_Resultado for r in SC.ground_truth(inst, panel, F.lit("2025-S1")).collect()}
    assert got == {
        "0": "Lucro", "1": "N/A (2025-S1 ainda não disponível)", "2": "N/A (2025-S1 com valor inválido)",
        "3": "Neutro (zero)", "4": "N/A (arquivo 5.csv não encontrado)",
        "5": "N/A (sem CNPJ ou semestre)", "6": "N/A (sem CNPJ ou semestre)",
    }


def test_next_period(spark):
    df = spark.createDataFrame([(2023, 12), (2024, 6), (None, 12)], "Ano int, Mes int")
    assert SC.next_period(df).first()[0] == "2024-S2"
    assert SC.next_period(df.filter("Ano is null")).first()[0] is None


def test_scale_then_restore_is_identity(spark):
    df = spark.range(1, 200).select((F.col("id") * 1000).alias("v"), (F.col("id") / 100 + 0.5).alias("f"))
    text = F.concat(F.lit("Entre "), F.rint(F.col("v") * F.col("f")).cast("bigint").cast("string"), F.lit(" e 9999"))
    made = FC.with_range(df.withColumn("faixa_bruta", text))
    back = made.select("v", "f", FC.real_range(F.col("faixa_bruta"), F.col("faixa"), F.col("f"))["minimo"].alias("m"))
    assert all(abs(r.m - r.v) <= 1 / r.f for r in back.collect())
