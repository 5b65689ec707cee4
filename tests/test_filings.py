import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.functions.periods import parse_cutoff, tag_to_iso
from ledgerloom.operators.flatten import allowed_dates, flatten_accounts, orphan_refs, parse_documents
from ledgerloom.operators.contract import with_status
from ledgerloom.operators.quality import balance_qc
from ledgerloom.operators.replacement import dedup_replacement, filing_keys, replaced_filings, resume_pending
from ledgerloom.plans import filings as plan
from ledgerloom.sources.documents import decode_documents, gunzip, read_files
from ledgerloom.sources.tables import csv_headers, csv_typed_scan, silver_scan
from tests.samples import account, documents, filing


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tags(spark):
    tags = {
        "A012020": "2020-12-31", "S062021": "2021-06-30", "S122021": "2021-12-31", "S032021": "2021-12-31",
        "T022024": "2024-02-29", "T122023": "2023-12-31", "I062022": "2022-06-30", "I092022": "2022-12-31",
        "X122022": None,
    }
    df = spark.createDataFrame([(t,) for t in tags], "t string").select("t", tag_to_iso(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == tags


def test_cutoff_text():
    assert parse_cutoff("2024-S1") == parse_cutoff("2024s1") == parse_cutoff("202406") == (2024, 1)
    assert parse_cutoff("202412") == (2024, 2)
    with pytest.raises(ValueError, match="cut-off"):
        parse_cutoff("2024")


def test_flatten_keeps_allowed_dates_and_scales(spark):
    parsed = parse_documents(documents(spark, filing()))
    assert rows(flatten_accounts(parsed), "periodo", "bloco", "escopo", "nivel", "descricao", "valor") == [
        ("2024-12-31", "BP", "IND", "1", "Conta 1", 10000.0),
        ("2024-12-31", "BP", "IND", "2", "Conta 2", 7500.0),
        ("2024-12-31", "DFC", "CON", "4", "Conta 4", 10000.0),
        ("2024-12-31", "DR", "IND", "3", "Conta 3", 10000.0),
    ]
    assert flatten_accounts(parsed, None).count() == 5


def test_repeated_reference_ids(spark):
    """An id is kept when any entry is allowed; its period comes from the last entry."""
    refs = [{"@id": "dt1", "@data": "A122024"}, {"@id": "dt1", "@data": "S062024"}]
    parsed = parse_documents(documents(spark, filing(datasBaseReferencia=refs)))
    assert rows(allowed_dates(parsed), "id", "periodo") == [("dt1", "2024-06-30")]
    assert {r.periodo for r in flatten_accounts(parsed).collect()} == {"2024-06-30"}


def test_orphans(spark):
    doc = filing(BalancoPatrimonial={"contas": [account("1", (("dt9", 4), ("dt1", 1)))]})
    assert rows(orphan_refs(parse_documents(documents(spark, doc))), "bloco", "nivel", "escopo", "dt_base", "valor") == [
        ("BP", "1", "IND", "dt9", 4.0)
    ]


def test_nested_accounts(spark):
    deep = account("1", contas=[account("1.1", contas=[account("1.1.1", scope="valoresConsolidados")]), account("1.2")])
    docs = documents(spark, filing(BalancoPatrimonial={"contas": [deep]}))
    facts = flatten_accounts(parse_documents(docs, nested=True), None, nested=True).filter("bloco = 'BP'")
    assert rows(facts, "nivel", "escopo") == [("1", "IND"), ("1.1", "IND"), ("1.1.1", "CON"), ("1.2", "IND")]
    assert rows(flatten_accounts(parse_documents(docs), None).filter("bloco = 'BP'"), "nivel") == [("1",)]


def test_accounts_nested_to_any_depth(spark):
    """Depths of 1 to 60 in one table, odd items, and texts that look like the key."""
    def chain(depth):
        below = {} if depth == 1 else {"contas": [None, "x", chain(depth - 1), {"@nivel": f"{depth}.9", "contas": {}}]}
        return account(str(depth), **{"@descricao": 'a "contas":[', **below})

    docs = documents(spark, *[filing(BalancoPatrimonial={"contas": [chain(d), chain(1)]}) for d in (1, 2, 3, 12, 60)])
    facts = flatten_accounts(parse_documents(docs, nested=True), None, keep=["path"], nested=True).filter("bloco = 'BP'")
    counts = sorted(r["count"] for r in facts.groupBy("path").count().collect())
    assert counts == [2, 3, 4, 13, 61]


def test_balance(spark):
    facts = spark.createDataFrame(
        [
            ("a", "p", "BP", "IND", "1", "", 10.0), ("a", "p", "BP", "IND", "1.1", "", 5.0),
            ("a", "p", "BP", "IND", "2", "", 10.0), ("a", "p", "BP", "CON", "2", "", 99.0),
            ("b", "p", "BP", "IND", "1", "", 0.1), ("b", "p", "BP", "IND", "1.1", "", 0.2),
            ("b", "p", "BP", "IND", "2", "", 0.3),
            ("c", "p", "BP", "IND", "1", "", 7.0), ("d", "p", "DR", "IND", "1", "", 7.0),
        ],
        "cnpj string, periodo string, bloco string, escopo string, nivel string, descricao string, valor double",
    )
    assert rows(balance_qc(facts), "cnpj", "diff") == [("a", 5.0)]
    assert rows(balance_qc(facts, root_only=True), "cnpj", "diff") == [("b", 0.2)]


def test_replacement(spark):
    names = [
        "202412-9011-01234567.json", "202412-9011-01234568.json", "01234567_9011_S_20241231.json",
        "notas.json", "202412-9011-99999999.json",
    ]
    docs = documents(
        spark,
        filing(), filing(at_tipoRemessa="S"), filing(), filing(), "{",
        names=names,
    )
    literal = filing_keys(docs)
    assert rows(literal, "cnpj_key", "base_key", "submission") == [
        ("01234567", "122024", "I"), ("01234567", "122024", "S"), ("01234567", "202412", "S"),
    ]
    kept = dedup_replacement(literal, order="path")
    assert rows(kept, "file_name") == sorted([(names[1],), (names[2],)])
    assert rows(dedup_replacement(kept, order="path"), "file_name") == rows(kept, "file_name")
    unified = dedup_replacement(filing_keys(docs, unified=True), order="path")
    assert rows(unified, "file_name") == [(names[1],)]


def test_resume(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    done = spark.createDataFrame([("b",), ("b",), ("z",)], "f string")
    assert rows(resume_pending(found, done, ["f"]), "f") == [("a",), ("c",)]
    assert resume_pending(found, done, ["f"], force=True).count() == 3


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    text = json.dumps(filing(BalancoPatrimonial={"contas": [account("1", **{"@descricao": "Provisão"})]}), ensure_ascii=False)
    stored = {
        "202412-9011-00000001.json": text.encode(),
        "202412-9011-00000002.json": gzip.compress(text.encode()) ,
        "202412-9011-00000003.json": b"\xef\xbb\xbf" + text.encode(),
        "202412-9011-00000004.json": text.encode("latin-1"),
        "202412-9011-00000005.json": b" \n\t" + text.encode() + b" resto",
        "202412-9011-00000006.json": gzip.compress(text.encode())[:-9],
        "202412-9011-00000007.json": gzip.compress(text.encode()[:100]) + gzip.compress(text.encode()[100:]),
        "202412-9011-00000008.json": b"{",
    }
    for name, content in stored.items():
        (folder / name).write_bytes(content)
    return folder


def test_tolerant_reading(spark, raw):
    decoded = decode_documents(read_files(spark, str(raw)))
    read = parse_documents(decoded).select(
        F.substring("file_name", 20, 1).cast("int").alias("n"),
        F.col("doc.BalancoPatrimonial.contas")[0]["@descricao"].alias("d"),
    )
    assert {r.n for r in read.collect() if r.d == "Provisão"} == {1, 2, 3, 4, 5, 7}


def test_job_end_to_end(spark, raw, tmp_path):
    for path in raw.iterdir():  # one institution per file
        n = int(path.name[12:20])
        content = path.read_bytes().replace(b"01234567", f"{n:08d}".encode())
        path.write_bytes(content)
    result = plan.run(spark, str(raw), str(tmp_path / "out"), table="filing_facts")
    log = {r.arquivo: r.status for r in result.status.collect()}
    assert log["202412-9011-00000001.json"] == "valid"
    assert "202412-9011-00000008.json" not in log  # unreadable dated files have no key and are not processed
    silver = silver_scan(spark, str(tmp_path / "out" / "silver"))
    assert {"00000001", "00000005"} <= {r.cnpj for r in silver.select("cnpj").collect()}
    stored = silver.count()
    assert spark.table("filing_facts").count() == stored == result.facts.count()
    assert (tmp_path / "out" / "runtime_log").is_dir()
    assert not (tmp_path / "out" / "bp_inconsistencias").exists()  # one-sided balances are not reported
    again = plan.run(spark, str(raw), str(tmp_path / "out"))
    assert again.facts.count() == stored
    spark.sql("DROP TABLE filing_facts")


def test_versions_are_chosen_without_exchanging_texts(spark, tmp_path):
    """With broadcasts off, exchanges hold keys, paths and facts, but neither texts nor parsed documents."""
    names = ["01234567_9011_I_20241231.json", "01234567_9011_S_20241231.json", "202412-9011-01234567.json", "x.json"]
    docs = documents(spark, *[filing() for _ in names], names=names)
    keyed = plan.with_version_keys(docs)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        replaced = replaced_filings(keyed, order="path")
        assert [r.path[-29:] for r in replaced.collect()] == [names[0]]
        facts = flatten_accounts(parse_documents(keyed), None, keep=["path"])
        kept = plan.without_replaced(facts, replaced)
        tree = kept._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [tree[i + 1] for i, line in enumerate(tree) if "Exchange hashpartitioning" in line]
        assert len(below) >= 3 and not any(f"{c}#" in line for line in below for c in ("text", "doc", "contas"))
        assert kept.count() == 10
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_gunzip_hands_out_what_it_has(spark):
    """A thousand members that grow a hundredfold, in one batch of the source."""
    made = spark.range(1000, numPartitions=1).select("id", F.lit(gzip.compress(b"0123456789" * 100_000)).alias("content"))
    got = made.select(F.length(gunzip(F.col("content"))).alias("n")).agg(F.sum("n"), F.count("n")).first()
    assert tuple(got) == (1_000_000_000, 1000)


def test_csv_keeps_leading_zeros_and_needs_its_columns(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame([("00012345", 1.5)], "cnpj string, valor double"), path, bom=True)
    schema = "cnpj string, valor double"
    assert rows(csv_typed_scan(spark, path, schema, required=("cnpj", "valor")), "cnpj", "valor") == [("00012345", 1.5)]
    with pytest.raises(ValueError, match="periodo"):
        csv_typed_scan(spark, path, schema, required=("cnpj", "periodo"))


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Permuted, missing and extra columns, a byte order mark, quotes, and an empty file."""
    (tmp_path / "a.csv").write_text("valor,cnpj,periodo\n10.5,00000001,2024-06-30\nx,00000002,2024-06-30\n")
    (tmp_path / "b.csv").write_text('\ufeffcnpj,novo,valor\n"00000003","a,b",7\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("outra\n1\n")
    schema = "cnpj string, periodo string, valor double"
    got = csv_typed_scan(spark, str(tmp_path), schema, required=("cnpj", "valor"), skip=True)
    assert rows(got, "cnpj", "periodo", "valor") == rows(
        spark.createDataFrame(
            [("00000001", "2024-06-30", 10.5), ("00000002", "2024-06-30", None), ("00000003", None, 7.0)], schema
        ),
        "cnpj", "periodo", "valor",
    )
    with pytest.raises(ValueError, match="cnpj"):
        csv_typed_scan(spark, str(tmp_path), schema, required=("cnpj", "valor"))
    files = {r.path[-5:]: r.missing for r in csv_headers(spark, str(tmp_path), required=("cnpj", "valor")).collect()}
    assert files == {"a.csv": [], "b.csv": [], "d.csv": ["cnpj", "valor"]}


def cells(df):
    return sorted(tuple(r) for r in df.na.fill("").collect())


def test_csv_records_are_not_lines(spark, tmp_path):
    """Line breaks, doubled quotes and separators in fields; the library's own files, and those of a data frame library."""
    schema = "id string, texto string, valor double"
    texts = ["line one\nline two", 'say "yes", twice', '"', "a;b,c", " blanks ", "crlf\r\nin it", "id", None, 'x"\n"y', "\\", '\\"']
    table = spark.createDataFrame([(str(i), t, i / 2) for i, t in enumerate(texts)], schema)
    for sep in (",", ";"):
        own, other = tmp_path / f"own{ord(sep)}", tmp_path / f"other{ord(sep)}"
        sinks.write_csv(table, str(own), sep, bom=True)
        other.mkdir()
        table.toPandas().to_csv(other / "x.csv", sep=sep, index=False, encoding="utf-8-sig")
        for path in (own, other):
            assert cells(csv_typed_scan(spark, str(path), schema, sep)) == cells(table)


def test_rows_like_headers_stay_and_headers_are_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"id","a, ""b""\nc",valor\nid,"a, ""b""\nc",valor\n1,x\n2,y,2,too,many\n')
    schema = 'id string, `a, "b"\nc` string, valor string'
    got = csv_typed_scan(spark, str(tmp_path), schema, required=("id", "valor"))
    assert cells(got) == [("1", "x", ""), ("2", "y", "2"), ("id", 'a, "b"\nc', "valor")]
    header = csv_headers(spark, str(tmp_path)).first()
    assert header.names == ["id", 'a, "b"\nc', "valor"] and header.records == 3


def test_a_thousand_forms_of_headers(spark, tmp_path):
    for i in range(1000):
        names = [f"n{i}", *[f"x{j}" for j in range(i % 40)], "id", "valor"]
        (tmp_path / f"{i}.csv").write_text(f"{','.join(names)}\n{','.join('' for _ in names[:-2])},{i},{i}.5\n")
    got = csv_typed_scan(spark, str(tmp_path), "id string, valor double", required=("id",))
    assert cells(got) == sorted((str(i), i + 0.5) for i in range(1000))


def test_contract_doubts_odd_numbers_and_escaped_keys(spark):
    for broken in ('"NaN"', '"Infinity"', "1e999"):
        text = json.dumps(filing()).replace('"@unidadeMedida": 1000', f'"@unidadeMedida": {broken}')
        assert text != json.dumps(filing())
        assert status_of(spark, text) == "invalid"
    escaped = json.dumps(filing()).replace('"@nivel": "', '"\\u0040nivel": "x', 1)
    assert escaped != json.dumps(filing())
    assert status_of(spark, escaped) == "invalid"


def status_of(spark, text):
    one = spark.createDataFrame([("202412-9011-00000001.json", text)], "file_name string, text string")
    return with_status(one).first().status


def test_balance_survives_a_huge_amount(spark):
    facts = spark.createDataFrame(
        [("1", "p", "BP", "IND", "1", 1e25), ("1", "p", "BP", "IND", "2", 1.0), ("2", "p", "BP", "IND", "1", 5.0),
         ("2", "p", "BP", "IND", "2", 3.0)],
        "cnpj string, periodo string, bloco string, escopo string, nivel string, valor double",
    )
    got = {r.cnpj: r["diff"] for r in balance_qc(facts).collect()}
    assert got == {"1": 1e25, "2": 2.0}
