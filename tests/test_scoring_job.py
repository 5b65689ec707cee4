import json

from ledgerloom import layout, sinks
from ledgerloom.plans import scoring
from ledgerloom.sources.tables import csv_typed_scan

H = "c" * 64


def test_job_end_to_end(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    answer = {"predicao_proximo_semestre": {"resultado_final_esperado": "Lucro", "viabilidade_operacional": "Saudável",
                                            "projecao_resultado_absoluto": {"faixa_estimada_valor": "2000 a 4000"}}}
    (folder / f"{H}_groq-m1.json").write_text(json.dumps(answer, ensure_ascii=False, indent=2), encoding="utf-8")
    (folder / f"{H}_openai-m2.error.json").write_text('{"error": "x"}')
    (folder / "notas.json").write_text("{}")
    (folder / f"{H}_gemini-m3.json").write_text("{")
    mapping = [(H, "2024-S1", "12345678000191", "Inst", 2.0, 0.0, 0.0, 0.0, 0.0)]
    sinks.write_csv(spark.createDataFrame(mapping, layout.MAPPING_SCHEMA), str(tmp_path / "mapping"), ";", bom=True)
    sinks.write_csv(spark.createDataFrame([(2024, 6, 1.0)], "Ano int, Mes int, x double"), str(tmp_path / "data"), ";", bom=True)
    truth = spark.createDataFrame(
        [("12345678", "2024-S2", "202412", -1.0)], "CNPJ8 string, Semestre_Ref string, YYYYMM string, Contas__Lucro_Liquido double"
    )
    target = str(tmp_path / "out")
    card = scoring.run(
        spark, str(folder), str(tmp_path / "mapping"), str(tmp_path / "data"), truth, target, "r1"
    ).collect()
    assert [(r["GROQ_m1_Resultado"], r["GROQ_m1_Lucro_Projetado_Real"], r["Real_Resultado"], r["Real_Acuracia_GROQ_m1"]) for r in card] == [
        ("Lucro | Saudável", "Entre R$ 1,000 e R$ 2,000", "Prejuízo", "✗ Errou")
    ]
    tally = csv_typed_scan(spark, f"{target}/run=r1/tally", "modelo string, veredito string, n bigint", ";")
    assert [tuple(r) for r in tally.collect()] == [("GROQ_m1", "✗ Errou", 1)]
