import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom import layout, sinks
from ledgerloom.functions.identity import cnpj8_of, hash_padded
from ledgerloom.functions.ratios import number, percent_change, round_to, safe_divide
from ledgerloom.operators import anonymize as A
from ledgerloom.operators.history import history_payload
from ledgerloom.operators.pseudonymize import pseudonym_mapping, pseudonymize
from ledgerloom.operators.sections import schema_drift, with_record
from ledgerloom.operators.summary import file_inventory, missing_sources, run_summary
from ledgerloom.plans.anonymisation import anonymised_tables
from ledgerloom.plans.panel import panel_from_extractions
from ledgerloom.sources.tables import discover_panels, panel_scan, read_extractions

SALT = "um-sal-de-teste-comprido"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def extraction(**contas):
    return {
        "Identificacao": {f: f"v {f}" for f in layout.SECTION_FIELDS["Identificacao"]},
        "Contas_Base": {f: i for i, f in enumerate(layout.SECTION_FIELDS["Contas_Base"])} | contas,
        "Indicadores": {f: 0.5 for f in layout.SECTION_FIELDS["Indicadores"]},
    }


def panel_rows(spark, *changes):
    """Panel with the given columns set and all others filled."""
    base = {
        **{c: "x" for c in layout.CONTEXT_COLUMNS + layout.IDENT_COLUMNS},
        "Ano": 2023, "Mes": 12, "Semestre_Ref": "2023-S2", "CNPJ8": "1234",
        **{c: float(i + 1) for i, c in enumerate(layout.ACCOUNT_COLUMNS)},
        **{c: 0.25 for c in layout.RATIO_COLUMNS},
    }
    made = [{**base, **c} for c in changes or ({},)]
    return spark.createDataFrame([[m[c] for c in layout.PANEL_COLUMNS] for m in made], layout.PANEL_SCHEMA)


@pytest.fixture
def stored(tmp_path):
    folder = tmp_path / "json" / "12345678"
    folder.mkdir(parents=True)
    full = extraction()
    partial = extraction(Novo=1)
    del partial["Contas_Base"]["Lucro_Liquido"], partial["Indicadores"]
    shapes = {
        "202006": full, "202012": [full], "202106": [full, full], "202112": "texto", "202206": partial,
        "202212": extraction(Ativo_Total="12.5", Patrimonio_Liquido=None),
    }
    for yyyymm, content in shapes.items():
        (folder / f"{yyyymm}-9010-12345678.json").write_text(json.dumps(content, indent=2))
    (folder / "202306-9010-12345678.json").write_text('{"Identificacao": {')
    return str(tmp_path / "json")


def test_sections_become_a_panel(spark, stored):
    panel = panel_from_extractions(read_extractions(spark, stored))
    assert panel.columns == layout.PANEL_COLUMNS
    by = {r.YYYYMM: r for r in panel.collect()}
    assert set(by) == {"202006", "202012", "202106", "202112", "202206", "202212"}
    assert by["202006"].Contas__Caixa_Equivalentes == by["202012"].Contas__Caixa_Equivalentes == 3.0
    assert (by["202006"].Semestre_Ref, by["202012"].Semestre_Ref) == ("2020-S1", "2020-S2")
    assert by["202006"].Arquivo_PDF == "202006-9010-12345678.pdf"
    assert by["202106"].Ident__CNPJ is None and by["202112"].Ident__CNPJ is None and by["202112"].CNPJ8 == "12345678"
    assert by["202206"].Contas__Lucro_Liquido is None and by["202206"].Indic__ROE is None
    assert (by["202212"].Contas__Ativo_Total, by["202212"].Contas__Patrimonio_Liquido) == (12.5, None)
    assert panel_from_extractions(read_extractions(spark, stored), only="0").isEmpty()


def test_drift(spark, stored):
    found = rows(schema_drift(read_extractions(spark, stored)), "tipo", "secao", "campo")
    assert found == sorted(
        [("missing", "Contas_Base", "Lucro_Liquido"), ("unmapped", "Contas_Base", "Novo")]
        + [("missing", "Indicadores", f) for f in layout.SECTION_FIELDS["Indicadores"]]
    )


def test_record_keeps_every_input(spark):
    texts = spark.createDataFrame([(t,) for t in ("{}", "[{}]", "[]", "x", "null", '{"a": 1} z')], "text string")
    assert with_record(texts).count() == texts.count()


def test_panel_csv_round_trip(spark, tmp_path):
    panel = panel_rows(spark, {"CNPJ8": "01027058"}, {"CNPJ8": "01027058", "Mes": 6}, {"CNPJ8": "20520298"})
    sinks.write_panel(panel, str(tmp_path / "panel"))
    assert rows(panel_scan(spark, str(tmp_path / "panel" / "*"))) == rows(panel)
    assert rows(discover_panels(spark, str(tmp_path / "panel")).drop("path", "ordem")) == rows(panel)


def test_only_own_csv_of_a_folder_is_a_panel(spark, tmp_path):
    header = ";".join(layout.PANEL_COLUMNS)
    for folder, name in (("01234567", "01234567"), ("01234567", "copia"), ("123", "123"), ("anonimizados", "x")):
        (tmp_path / folder).mkdir(exist_ok=True)
        line = ";".join("1" for _ in layout.PANEL_COLUMNS)
        (tmp_path / folder / f"{name}.csv").write_text(f"﻿{header}\n{line}\n", encoding="utf-8")
    found = discover_panels(spark, str(tmp_path))
    assert [r.path[-21:] for r in found.collect()] == ["01234567/01234567.csv"]


def test_missing_and_inventory(spark):
    folders = spark.createDataFrame([("01234567",), ("01234568",), ("anonimizados",)], "pasta string")
    files = spark.createDataFrame(
        [("/CSV/01234567/01234567.csv",), ("/CSV/01234568/01234567.csv",)], "path string"
    )
    assert rows(missing_sources(folders, files)) == [("01234568",)]
    names = spark.createDataFrame(
        [("/a/202006-9010-01234567.pdf",), ("/b/201912-9010-01234567.PDF",), ("/b/lixo.pdf",)], "path string"
    )
    got = {r.cnpj8: (r.arquivos, r.primeiro, r.ultimo) for r in file_inventory(names).collect()}
    assert got == {"01234567": (2, "201912", "202006"), None: (1, None, None)}


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0), (float("nan"), 2.0)], "a double, b double"
    )
    a, b = number(df, "a"), number(df, "b")
    got = df.select(safe_divide(a, b), percent_change(a, b)).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.5, 50.0), (0.0, 0.0)]
    ties = spark.createDataFrame([(0.0005,), (0.0015,), (2.5,), (1.0045,)], "x double")
    assert [r[0] for r in ties.select(round_to(F.col("x"), 3)).collect()] == [
        round(v * 1000) / 1000 for v in (0.0005, 0.0015, 2.5, 1.0045)
    ]
    texts = spark.createDataFrame([("1e3",), (" 2 ",), ("x",), ("5d",), (None,)], "t string")
    assert [r[0] for r in texts.select(number(texts, "t")).collect()] == [1000.0, 2.0, None, None, None]


def test_identifiers(spark):
    ids = {"12.345.678/0001-95": "12345678", "1027058000191": "01027058", "": "", "sem": "", None: ""}
    df = spark.createDataFrame([(i,) for i in ids], "t string").select(cnpj8_of(F.col("t")))
    assert [r[0] for r in df.collect()] == list(ids.values())
    n = spark.createDataFrame([(1027058000191.0,), (None,)], "d double").select(cnpj8_of(F.col("d"), "double"))
    assert [r[0] for r in n.collect()] == ["01027058", ""]
    h = spark.createDataFrame([(" 1234",), ("00001234",), ("123456789",)], "c string").select(hash_padded(F.col("c"), SALT))
    a, b, c = (r[0] for r in h.collect())
    assert a == b != c


def test_auditors(spark):
    names = {
        "KPMG Brasil": "Big 4", "Ernst  & Young LLP": "Big 4", "pwc": "Big 4", "Keynes": "Outros", "EYE": "Outros",
        "Auditores EY.": "Big 4", "": "Outros", None: "Outros",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select(A.auditor_category(F.col("n")))
    assert [r[0] for r in df.collect()] == list(names.values())


def test_cutoff_is_inclusive_and_monotone(spark):
    panel = panel_rows(spark, {"Ano": 2023, "Mes": 6}, {"Ano": 2023, "Mes": 7}, {"Ano": 2024, "Mes": 1}, {"Ano": None})
    counts = [A.semester_cutoff(panel, y, s).count() for y, s in ((2022, 2), (2023, 1), (2023, 2), (2024, 1))]
    assert counts == [1, 2, 3, 4]
    assert A.semester_cutoff(panel, 2023, 1, keep_undated=False).count() == 1
    summary = run_summary(panel_rows(spark, {"CNPJ8": "a", "Ano": 2030}, {"CNPJ8": "b"}, {"CNPJ8": "b"}), 2024, 1).first()
    assert tuple(summary) == (2, 1, 1, 3, 2)
    assert rows(A.cutoff_excluded(panel_rows(spark, {"CNPJ8": "a", "Ano": 2030}, {"CNPJ8": "b"}), 2024, 1)) == [("a", 1)]


def test_anonymisation(spark):
    s = A.Settings(salt=SALT, seed=7)
    panel = panel_rows(
        spark,
        *[{"CNPJ8": f"{i:08d}", "Semestre_Ref": f"2020-S{j}", "Contas__Obrigacoes_Liquidacao": float(i)} for i in range(40) for j in (1, 2)],
    )
    tables = anonymised_tables(panel, 2024, 1, s)
    data = tables.dataset
    assert set(data.columns) == {"inst_hash"} | set(layout.PANEL_COLUMNS) - set(layout.PRIVATE_COLUMNS)
    assert rows(data) == rows(anonymised_tables(panel.repartition(7), 2024, 1, s).dataset)
    both = data.join(tables.mapping, ["inst_hash", "Semestre_Ref"])
    assert both.count() == panel.count()
    for r in both.collect():
        assert 0.6 <= r.Fator_Escalonamento <= 1.4
        assert math.isclose(r.Contas__Ativo_Total / r.Fator_Escalonamento, 1.0, rel_tol=1e-5)
        assert 0.98 <= r.Contas__Lucro_Liquido / r.Fator_Escalonamento / 3.0 <= 1.021
    assert data.select("inst_hash").distinct().count() == 40
    assert len({r.Fator_Escalonamento for r in tables.mapping.collect()}) == 40
    assert rows(data) != rows(anonymised_tables(panel, 2024, 1, A.Settings(salt=SALT, seed=8)).dataset)
    assert tables.summary.first().salt_sha256 not in SALT


def test_new_entities_do_not_move_factors(spark):
    s = A.Settings(salt=SALT)
    small = A.hash_entities(panel_rows(spark, {"CNPJ8": "1"}), SALT)
    large = A.hash_entities(panel_rows(spark, {"CNPJ8": "1"}, {"CNPJ8": "2"}), SALT)
    assert set(rows(A.entity_factors(small, s))) < set(rows(A.entity_factors(large, s)))


def test_ratios_do_not_depend_on_scale(spark):
    s = A.Settings(salt=SALT)
    panel = A.hash_entities(panel_rows(spark, *[{"CNPJ8": str(i)} for i in range(20)]), SALT)
    ratio = [c for c in layout.RATIO_COLUMNS if c != "Indic__Margem_Servicos"]
    plain = A.recalculate_ratios(panel).select("inst_hash", *ratio)
    scaled = A.recalculate_ratios(A.scale_by_entity(panel, s)).select("inst_hash", *ratio)
    assert rows(plain) == rows(scaled)


def test_stored_factors(spark):
    s = A.Settings(salt=SALT)
    panel = A.hash_entities(panel_rows(spark, *[{"CNPJ8": str(i % 3)} for i in range(50)]), SALT)
    factors = A.entity_factors(panel, s)
    assert rows(A.scale_by_entity(panel, factors=factors), *layout.ACCOUNT_COLUMNS) == rows(
        A.scale_by_entity(panel, s), *layout.ACCOUNT_COLUMNS
    )
    lacking = factors.filter(F.col("inst_hash") != factors.agg(F.min("inst_hash")).first()[0])
    with pytest.raises(Exception, match="no factor for"):
        A.scale_by_entity(panel, factors=lacking).collect()


@pytest.mark.parametrize(
    "wrong", [{"salt": "curto"}, {"factor_min": 0.0}, {"factor_min": 2.0}, {"noise_min": 1.1}, {"digits": 11}]
)
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        A.Settings(**{"salt": SALT, **wrong})


def test_pseudonyms(spark):
    facts = spark.createDataFrame(
        [("00000001", "a", 100.0), ("00000001", "b", 50.0), ("00000002", "a", 100.0)], "cnpj string, id string, valor double"
    )
    out = pseudonymize(facts, "sal", "segredo")
    assert out.columns == ["inst_hash", "id", "valor"]
    mapping = {r.inst_hash: r.k_multiplier for r in pseudonym_mapping(facts, "sal", "segredo").collect()}
    assert len(mapping) == 2 and all(0.6 <= k <= 1.4 for k in mapping.values())
    assert all(r.valor == (100.0 if r.id == "a" else 50.0) * mapping[r.inst_hash] for r in out.collect())
    noisy = pseudonymize(facts, "sal", "segredo", noise=0.02)
    assert all(abs(a.valor / b.valor - 1) <= 0.02 for a, b in zip(noisy.orderBy("inst_hash", "id").collect(), out.orderBy("inst_hash", "id").collect(), strict=True))
    with pytest.raises(ValueError, match="valor"):
        pseudonymize(facts.drop("valor"), "sal", "segredo")


def test_history(spark):
    panel = spark.createDataFrame(
        [("h", 2024, 6, 1.5), ("h", 2023, 12, None), ("g", 2023, 12, 2.0)], "inst_hash string, Ano int, Mes int, v double"
    )
    got = {r.inst_hash: json.loads(r.payload) for r in history_payload(panel).collect()}
    assert got["h"] == [{"Ano": 2023, "Mes": 12, "v": None}, {"Ano": 2024, "Mes": 6, "v": 1.5}]
    twice = {r.inst_hash: (r.n, json.loads(r.payload)) for r in history_payload(panel.union(panel)).collect()}
    assert twice["h"][0] == 4 and [x["Ano"] for x in twice["h"][1]] == [2023, 2023, 2024, 2024]
    named = panel.select("inst_hash", F.concat_ws("-S", "Ano", F.col("Mes") / 6).alias("Semestre_Ref"), "v")
    assert [x["v"] for x in json.loads(history_payload(named).filter("inst_hash = 'h'").first().payload)] == [None, 1.5]


def test_history_parts_are_bounded(spark):
    rows = [("h", 2000 + i // 2, 6 + 6 * (i % 2), None if i == 3 else i / 3) for i in range(30)]
    rows += [("h", 2024, 12, float(i)) for i in range(120)] + [("h", None, None, 1.0), ("i", 2024, 6, None)]
    panel = spark.createDataFrame(rows, "inst_hash string, Ano int, Mes int, v double")
    got = sorted(history_payload(panel, rows=10).collect(), key=lambda r: (r.inst_hash, r.part))
    parts = [(r.inst_hash, r.n, json.loads(r.payload)) for r in got]
    assert [(r.inst_hash, r.part) for r in got] == [("h", i) for i in range(16)] + [("i", 0)]
    assert all(n == len(items) <= 10 for _, n, items in parts)
    back = [(h, i["Ano"], i["Mes"], i["v"]) for h, _, items in parts for i in items]
    assert back == sorted(rows, key=lambda r: (r[0], r[1] is None, r[1], r[2], r[3] is not None, r[3]))
