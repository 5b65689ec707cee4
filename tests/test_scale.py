"""What must not grow faster than the input: widths of exchanges, passes, and files."""

import gzip
import json
from random import Random

import pytest
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.bindings import inputs, panels
from ledgerloom.operators import contract, flatten, history
from ledgerloom.operators.history import history_payload
from ledgerloom.session import LISTING
from ledgerloom.sources import tables
from tests.compare import driver
from tests.test_plans import SF, physical


def test_lines_are_exchanged_as_they_are(spark):
    """No partial sums, which are several times as wide as a line, in the exchange of line items."""
    lines = physical(driver.queries()["scale_by_entity"](spark, SF)).splitlines()
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line)
    assert "HashAggregate" not in lines[at + 1]


def test_rows_of_short_histories_are_exchanged_once(spark):
    panel = spark.createDataFrame([("h", 2024, 6, 1.5), ("g", 2023, 12, 2.0)], "inst_hash string, Ano int, Mes int, v double")
    assert physical(history_payload(panel)).count("Exchange") == 1


def test_long_histories_next_to_short_ones(spark):
    """Entities on both sides of the bound of a list, one of them null, give what numbering gives for all."""
    n = history.ROWS
    sizes = {"a": n, "b": n + 1, "c": 1, None: 2 * n + 5, "e": 2 * n}
    rows = [(k, 2000 + i % 50, 6, float(i)) for k, size in sizes.items() for i in range(size)]
    panel = spark.createDataFrame(rows, "inst_hash string, Ano int, Mes int, v double")
    got = {(r.inst_hash, r.part): (r.n, r.payload) for r in history_payload(panel, rows=300).collect()}
    fields = F.struct("Ano", "Mes", "v").alias("__row")
    items = panel.select("inst_hash", F.lit(False).alias("a"), F.col("Ano").alias("b"), F.lit(False).alias("c"), F.col("Mes").alias("d"), fields)
    assert got == {(r.inst_hash, r.part): (r.n, r.payload) for r in history._long(items, "inst_hash", 300).collect()}


def _odd_accounts(random, depth):
    """Accounts within accounts with items, lists and members that are none."""
    found = []
    for i in range(random.randint(0, 2)):
        account = {"@nivel": f"{depth}.{i}", "@descricao": 'a "contas": b', "valoresIndividualizados": [{"@dtBase": "d", "@valor": depth}]}
        if depth < 20 and random.random() < 0.9:
            account["contas"] = _odd_accounts(random, depth + 1)
        elif random.random() < 0.5:
            account["contas"] = random.choice([None, "x", 5, {}, [], {"contas": [account.copy()]}])
        found += [account, random.choice(["nota", None, 7, [], {"contas": []}])][: random.randint(1, 2)]
    return found


def _levels_of(accounts):
    for a in accounts if isinstance(accounts, list) else []:
        if isinstance(a, dict):
            yield from (a["@nivel"] for _ in a.get("valoresIndividualizados", []))
            yield from _levels_of(a.get("contas"))


def test_nested_accounts_of_any_shape(spark):
    """Several levels are read at a time: no list of variants is made of each, and odd items are left out at every level."""
    random, docs = Random(5), []
    for n in range(200):
        top = {"@nivel": "0", "@descricao": "t", "valoresIndividualizados": [{"@dtBase": "d", "@valor": 1}], "contas": _odd_accounts(random, 1)}
        docs.append((n, {"@unidadeMedida": 1, "datasBaseReferencia": [{"@id": "d", "@data": "A122020"}], "BalancoPatrimonial": {"contas": [top]}}))
    texts = spark.createDataFrame([(n, json.dumps(d)) for n, d in docs], "n int, text string")
    facts = flatten.flatten_accounts(flatten.parse_documents(texts, nested=True), None, keep=["n"], nested=True)
    expected = sorted((n, level) for n, d in docs for level in _levels_of(d["BalancoPatrimonial"]["contas"]))
    assert max(len(level) for _, level in expected) > 3  # ten levels and more
    assert sorted((r.n, r.nivel) for r in facts.collect()) == expected
    assert "ArrayType(VariantType" not in facts._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_several_kinds_take_one_panel(spark, monkeypatch):
    """The panel that is split among files is stored first, so that its sums are made once."""
    made = []
    monkeypatch.setattr(panels, "materialise", lambda df, name: made.append(name) or df.localCheckpoint())
    assert panels.panel_scan_mixed(spark, SF).columns and made == ["panel-rows"]


def test_headers_of_institutions_are_read_once(spark, monkeypatch):
    """What keeps files from being read and their results share one pass for headers."""
    read, scan = [], tables.csv_headers
    monkeypatch.setattr(tables, "csv_headers", lambda *a, **k: read.append(a) or scan(*a, **k))
    assert panels.truth_reasons(spark, SF).columns and len(read) == 1


def test_the_first_broken_rule_settles_the_status(spark):
    """Statuses are those of the full list of violations, of which only the start is made."""
    variants = inputs.filing_variants(spark, SF).limit(500)
    rules = {"202412": ["A122024"]}
    quick, full = (contract.with_status(variants, rules, listed=listed) for listed in (False, True))
    told = lambda judged: sorted((r.doc_id, r.variant, r.status, r.mensagem) for r in judged.collect())
    assert told(quick) == told(full)
    assert len({(v, s) for _, v, s, _ in told(full)}) == len(inputs.FILING_VARIANTS)
    assert "violations" not in quick.columns
    # blocks are read with typed leaves only where the names and the header broke no rule
    leaves = next(line for line in physical(quick).splitlines() if "Generate" in line and "__l#" in line)
    assert "size(__first" in leaves


def test_filings_are_put_together_without_structs(spark):
    """Same texts as a nested struct turned into JSON gave; null and odd amounts included."""
    texts = inputs.filing_texts(spark, SF)
    assert "to_json" not in physical(texts)
    for row in texts.limit(300).collect():
        cut = row.text.endswith("]")
        doc = json.loads(row.text + "}}" if cut else row.text)
        assert json.dumps(doc, separators=(",", ":"), ensure_ascii=False)[: -2 if cut else None] == row.text
    value = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("-inf"),)], "v double")
    made = [r[0] for r in value.select(inputs._value("dt1", F.col("v"))).collect()]
    assert made == ['{"@dtBase":"dt1","@valor":1.0}', '{"@dtBase":"dt1"}', '{"@dtBase":"dt1","@valor":"NaN"}', '{"@dtBase":"dt1","@valor":"-Infinity"}']


def _tasks(spark, group, job):
    """What a job gives, and the most tasks that any of its stages had."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        got, tracker = job(), spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        return got, max(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tracker.getStageInfo(s))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_folder_per_institution_is_no_task_each(spark, tmp_path):
    """Folders are listed by a few tasks per core, and the session's own setting holds afterwards."""
    before, folders = spark.conf.get(LISTING), 150
    for i in range(folders):
        (tmp_path / f"inst={i:08}").mkdir()
        (tmp_path / f"inst={i:08}" / "part-0.csv").write_text(f"Semestre_Ref;CNPJ8\n2024-S1;{i:08}\n")
    found, most = _tasks(spark, "listing", lambda: tables.discover_panels(spark, str(tmp_path)).collect())
    assert {r.CNPJ8 for r in found} == {f"{i:08}" for i in range(folders)}
    assert most < folders
    assert spark.conf.get(LISTING) == before


def test_extractions_of_many_institutions_are_listed_by_few_tasks(spark, tmp_path):
    n = 150
    texts = spark.range(n).selectExpr("lpad(id, 8, '0') AS CNPJ8", "concat(id, '.json') AS file_name", "concat('[{\"a\": ', id, '}]') AS text")
    sinks.write_extractions(texts, str(tmp_path / "x"))
    found, most = _tasks(spark, "extractions", lambda: tables.stored_extractions(spark, str(tmp_path / "x")).select(
        "CNPJ8", "file_name", F.try_variant_get("record", "$.a", "int").alias("a")).collect())
    assert {tuple(r) for r in found} == {(f"{i:08}", f"{i}.json", i) for i in range(n)}
    assert most < n


def test_small_files_get_a_small_parser(spark, tmp_path):
    """The parser sets as many places up for each file as a record may have columns, so their number follows the files."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "small.csv").write_text("x;y\n1;2\n")
    assert tables._columns_within(spark, str(tmp_path / "a"), False) == tables.USUAL_COLUMNS
    n = tables.USUAL_COLUMNS + 5
    (tmp_path / "a" / "wide.csv").write_text("x" + ";" * (n - 1) + "\n3" + ";" * (n - 1) + "\n")
    got = tables.csv_typed_scan(spark, str(tmp_path / "a"), "x int", ";")
    assert sorted(r.x for r in got.collect()) == [1, 3]
    (tmp_path / "a" / "small.csv.gz").write_bytes(gzip.compress(b"x\n4\n"))
    assert tables._columns_within(spark, str(tmp_path / "a"), False) == tables.MOST_COLUMNS


def _forks():
    """Processes and threads started since the machine was."""
    return next(int(line.split()[1]) for line in open("/proc/stat") if line.startswith("processes"))


def test_a_file_per_institution_is_no_process_each(spark, tmp_path):
    n = 400
    panel = spark.range(n).selectExpr("'2024-S1' AS Semestre_Ref", "2024 AS Ano", "6 AS Mes", "lpad(id, 8, '0') AS CNPJ8")
    sinks.write_panel(panel, str(tmp_path / "warm"))
    before = _forks()
    sinks.write_panel(panel, str(tmp_path / "panel"))
    assert _forks() - before < n
    assert tables.discover_panels(spark, str(tmp_path / "panel")).select("CNPJ8").distinct().count() == n


def test_files_per_institution_are_those_of_sparks_writer(spark, tmp_path):
    """Odd names of folders, nulls, quotes, line breaks and numbers; what was there before is replaced."""
    texts = [' x "q"; y\nz ', "", None, "a;b", "\r\nq", "\\", "#c"]
    keys = ["00000001", "a/b=c:d", "é x%{}", None, "", "tab\t\\q'\"^"]
    rows = [(k, i, t, float("nan") if i == 3 else i / 3) for k in keys for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, 'inst string, Ano int, `﻿A;"b` string, `v.x` double')
    table = table.repartition(3, "inst").sortWithinPartitions("inst", "Ano")
    made, expected = tmp_path / "made", tmp_path / "expected"
    sinks.write_folders(table.limit(5), "inst", str(made), ";")
    sinks.write_folders(table, "inst", str(made), ";")
    sinks._csv_writer(table.write, ";").partitionBy("inst").csv(str(expected))
    files = lambda root: {(str(p.parent.relative_to(root)), p.name[:6]): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert files(made) == files(expected) and len(files(made)) == 6
    assert sorted(p.name for p in tmp_path.iterdir()) == ["expected", "made"]


def test_a_job_that_fails_leaves_the_files_that_were_there(spark, tmp_path):
    table = spark.createDataFrame([("1", "a")], "inst string, x string")
    sinks.write_folders(table, "inst", str(tmp_path / "t"), ";")
    with pytest.raises(Exception, match="stopped"):
        sinks.write_folders(table.withColumn("x", F.raise_error(F.lit("stopped"))), "inst", str(tmp_path / "t"), ";")
    assert [p.read_text() for p in tmp_path.rglob("part-*.csv")] == ["x\na\n"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_an_institution_is_one_file_however_many_there_are(spark, tmp_path):
    """Rows of an institution come from several tasks; parts small enough not to be split keep them in one file."""
    columns = "'2024-S1' AS Semestre_Ref", "2000 + id % 8 AS Ano", "6 AS Mes", "lpad(id div 8, 8, '0') AS CNPJ8", "repeat(uuid(), 20) AS x"
    panel = spark.range(16_000).repartition(8).selectExpr(*columns)
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(advised, "100k")
    try:
        sinks.write_panel(panel, str(tmp_path / "panel"))
    finally:
        spark.conf.unset(advised)
    files = [p.parent.name for p in (tmp_path / "panel").rglob("*.csv")]
    assert len(files) == len(set(files)) == 2_000


def test_files_are_not_listed_again_for_their_sizes(spark, tmp_path, monkeypatch):
    """Where headers are at hand, they tell how large files are."""
    sinks.write_panel(spark.sql("SELECT '2024-S1' AS Semestre_Ref, 2024 AS Ano, 6 AS Mes, '00000001' AS CNPJ8, 1.5 AS Contas__Lucro_Liquido"), str(tmp_path / "p"))
    headers = tables.institution_headers(spark, str(tmp_path / "p"))
    size = next((tmp_path / "p").rglob("*.csv")).stat().st_size
    assert [r.length for r in headers.collect()] == [size]
    monkeypatch.setattr(tables, "_sizes_within", None)
    assert tables.truth_scan(spark, str(tmp_path / "p"), headers).first()["Contas__Lucro_Liquido"] == 1.5
    assert tables.truth_files(spark, str(tmp_path / "p"), headers).first()["problema"] is None
