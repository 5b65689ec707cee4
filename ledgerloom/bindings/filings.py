"""Queries over filings: names, reading, contract, fact table, balance check, versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.bindings import inputs as I
from ledgerloom.functions.identity import zero_pad
from ledgerloom.functions.periods import tag_to_iso
from ledgerloom.operators import contract, flatten, quality, replacement, summary
from ledgerloom.session import new_table_path
from ledgerloom.sources import documents as D
from ledgerloom.sources import tables as T

# --- SQL shared by several checks ------------------------------------------------------------------------------


def pad8(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"(CASE WHEN length({text}) < 8 THEN lpad({text}, 8, '0') ELSE {text} END)"


def pad19(key: str) -> str:
    return f"lpad(CAST({key} AS VARCHAR), 19, '0')"


_JUDGED = f"""
judged AS (
  SELECT o_orderkey AS doc_id, o_totalprice AS p, o_orderstatus AS s, o_orderpriority AS pr, o_orderdate AS d,
         {pad8('o_custkey')} AS cnpj,
         strftime(o_orderdate, '%Y%m') || '-9011-' || {pad8('o_custkey')} || '.json' AS file_name,
         CASE WHEN o_orderstatus = 'O' THEN 1000.0 ELSE 1.0 END AS unit,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'error'
              WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'invalid'
              WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'invalid'
              WHEN month(o_orderdate) > 9 THEN 'skip'
              ELSE 'valid' END AS status
  FROM orders)"""

_FACTS = f"""{_JUDGED},
facts AS (
  SELECT j.doc_id, j.cnpj,
         CASE v.dt WHEN 'dt1' THEN CAST(year(j.d) AS VARCHAR) || '-12-31'
                   ELSE strftime(last_day(j.d), '%Y-%m-%d') END AS periodo,
         v.bloco, v.escopo, v.nivel, v.descricao,
         (j.p * CASE WHEN v.nivel = '2' AND j.s <> 'F' THEN 0.5::DOUBLE ELSE v.share::DOUBLE END) * j.unit::DOUBLE AS valor
  FROM judged j, (VALUES
      ('BP', 'IND', '1', 'ATIVO', 'dt1', 1.0), ('BP', 'IND', '1', 'ATIVO', 'dt3', 0.5),
      ('BP', 'CON', '1', 'ATIVO', 'dt1', 2.0), ('BP', 'IND', '1.1', 'CIRCULANTE', 'dt1', 0.5),
      ('BP', 'IND', '2', 'PASSIVO', 'dt1', 1.0), ('BP', 'IND', '2.1', 'DEPOSITOS', 'dt1', 0.5),
      ('DR', 'IND', '3', 'RECEITA', 'dt3', 1.0), ('DFC', 'CON', '6.1', 'CAIXA', 'dt3', -1.0)
    ) AS v(bloco, escopo, nivel, descricao, dt, share)
  WHERE j.status = 'valid')"""


def _balance_sql(assets: str, liabilities: str) -> str:
    return f"""WITH {_FACTS}, sides AS (
      SELECT cnpj, periodo,
             CAST(abs(sum(CASE WHEN {assets} THEN CAST(valor AS DECIMAL(28, 6)) END)
                    - sum(CASE WHEN {liabilities} THEN CAST(valor AS DECIMAL(28, 6)) END)) AS DOUBLE) AS diff
      FROM facts WHERE bloco = 'BP' AND escopo = 'IND' GROUP BY cnpj, periodo)
    SELECT * FROM sides WHERE diff >= 0.01"""


# --- queries ---------------------------------------------------------------------------------------------------


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contract.with_status(I.filing_texts(spark, sf_dir), I.RULES, listed=False)
    return judged.filter(F.col("status") == "valid")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flatten_accounts(_valid(spark, sf_dir), I.RULES, keep=["doc_id"])


def parse_filing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, cnpj = F.col("o_orderpriority"), I.pad8(F.col("o_custkey"))
    month, day = I.month_of(F.col("o_orderdate")), F.date_format("o_orderdate", "yyyyMMdd")
    name = (
        F.when(priority == "1-URGENT", F.concat(cnpj, F.lit("_9011_I_"), day, F.lit(".json")))
        .when(priority == "2-HIGH", F.concat(cnpj, F.lit("_9011_S_"), day, F.lit(".json")))
        .when(priority == "5-LOW", F.concat(month, F.lit("_9011_"), cnpj, F.lit(".txt")))
        .otherwise(F.concat(month, F.lit("-9011-"), cnpj, F.lit(".json")))
    )
    files = I.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/raw/"), name).alias("path"))
    return summary.parse_filing_names(files).drop("path")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = D.decode_documents(I.encoded_documents(spark, sf_dir))
    parsed = decoded.withColumn("doc", F.from_json("text", "doc_id bigint, text string"))
    return parsed.select(
        "doc_id", F.col("doc.doc_id").alias("id_lido"), F.sha2("doc.text", 256).alias("sha256"),
        F.length("doc.text").cast("bigint").alias("n_chars"),
    )


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", D.fingerprint(F.col("text")).alias("sha256_16"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.with_status(I.filing_texts(spark, sf_dir), I.RULES, listed=False).select(
        "doc_id", F.col("file_name").alias("arquivo"), "status", "mensagem"
    )


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.schema_violations(I.filing_texts(spark, sf_dir), key="doc_id")


def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and broken rules of filings in which one thing is changed."""
    judged = contract.with_status(I.filing_variants(spark, sf_dir), {"202412": ["A122024"]})
    broken = F.explode_outer(F.array_distinct("violations"))
    return judged.select("doc_id", "variant", "status", "mensagem", broken.alias("v")).select(
        "doc_id", "variant", "status", "mensagem", "v.path", "v.rule"
    )


def _named_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with typed, dated and foreign names; some dated ones can't be read."""
    o = I.table(spark, sf_dir, "orders")
    priority, status, cnpj = F.col("o_orderpriority"), F.col("o_orderstatus"), I.pad8(F.col("o_custkey"))
    typed = F.concat(cnpj, F.lit("_9011_"), F.when(priority == "2-HIGH", "S").otherwise("I"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json"))
    dated = F.concat(I.month_of(F.col("o_orderdate")), F.lit("-9011-"), cnpj, F.lit(".json"))
    name = F.when(priority.isin("1-URGENT", "2-HIGH"), typed).when(priority == "5-LOW", F.concat(F.lit("copia de "), dated)).otherwise(dated)
    head = F.to_json(F.struct(cnpj.alias("@cnpj"), F.date_format("o_orderdate", "MMyyyy").alias("@dataBase")))
    text = F.when((priority == "3-MEDIUM") & (status == "P"), F.replace(head, F.lit('"'), F.lit("'"))).when(
        priority.isin("1-URGENT", "2-HIGH"), "não é lido"
    ).otherwise(head)
    return o.select("o_orderkey", name.alias("file_name"), text.alias("text"))


def filing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = replacement.filing_keys(_named_versions(spark, sf_dir))
    return keyed.select("o_orderkey", "cnpj_key", "base_key", "submission")


def filing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacement.filing_rejects(_named_versions(spark, sf_dir)).select("o_orderkey", "file_name", "motivo")


def allowed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.allowed_dates(_valid(spark, sf_dir), I.RULES, key="doc_id")


def resolve_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("l_linenumber") <= 2, "A").when(F.col("l_linenumber") == 3, "S").when(F.col("l_linenumber") == 4, "I")
        .when(F.col("l_linenumber") <= 6, "T").otherwise("X")
    )
    tag = F.concat(kind, F.date_format("l_shipdate", "MMyyyy"))
    lines = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", tag.alias("tag"))
    return lines.withColumn("periodo", tag_to_iso(F.col("tag")))


def orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.orphan_refs(_valid(spark, sf_dir), key="doc_id")


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["l_orderkey", "l_linenumber", "l_partkey"]
    parsed = flatten.parse_documents(I.nested_filing_texts(spark, sf_dir), nested=True)
    return flatten.flatten_accounts(parsed, None, keep=keep, nested=True)


def silver_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "silver")
    sinks.write_silver(I.line_facts(spark, sf_dir), path)
    return T.silver_scan(spark, path)


def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with free texts, written as CSV and read back."""
    path = new_table_path(spark, "csv")
    facts = I.table(spark, sf_dir, "orders").select(
        I.pad8(F.col("o_custkey")).alias("cnpj"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("periodo"),
        F.lit("BP").alias("bloco"),
        F.col("o_orderstatus").alias("escopo"),
        F.col("o_orderkey").cast("string").alias("nivel"),
        I.free_text(F.col("o_orderpriority")).alias("descricao"),
        F.col("o_totalprice").alias("valor"),
    )
    sinks.write_csv(facts, path)
    return T.csv_typed_scan(spark, path, required=("cnpj", "valor"))


def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as a catalog table."""
    name = f"facts_{uuid.uuid4().hex}"
    sinks.write_table(I.line_facts(spark, sf_dir), name)
    return spark.table(name)


def balance_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.balance_qc(_facts(spark, sf_dir))


def balance_qc_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.balance_qc(_facts(spark, sf_dir), root_only=True)


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        I.pad8(F.col("o_custkey")).alias("cnpj_key"),
        F.date_format("o_orderdate", "MMyyyy").alias("base_key"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "S").otherwise("I").alias("submission"),
        zero_pad(F.col("o_orderkey").cast("string"), 19).alias("path"),
    )


def dedup_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replacement.dedup_replacement(_versions(spark, sf_dir), order="path").drop("path")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders")
    done = orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    return replacement.resume_pending(orders.select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


def _source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    stem = F.concat(I.month_of(F.col("o_orderdate")), F.lit("-9010-"), I.pad8(F.col("o_custkey")))
    name = (
        F.when((priority == "4-NOT SPECIFIED") & (status == "P"), F.concat(F.lit("rascunho-"), stem, F.lit(".pdf")))
        .when(priority == "5-LOW", F.concat(stem, F.lit(".PDF")))
        .otherwise(F.concat(stem, F.lit(".pdf")))
    )
    return I.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/PDF/"), name).alias("path"))


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.file_inventory(_source_names(spark, sf_dir))


def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.source_listing(_source_names(spark, sf_dir), keep=("o_orderkey",))


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    cnpj = I.pad8(F.col("o_custkey"))
    status = F.col("o_orderstatus")
    path = (
        F.when(status == "F", F.concat_ws("/", F.lit("/CSV"), cnpj, F.concat(cnpj, F.lit(".csv"))))
        .when(status == "O", F.concat_ws("/", F.lit("/CSV"), cnpj, F.lit("rascunho.csv")))
        .otherwise(F.concat_ws("/", F.lit("/CSV/anonimizados"), F.concat(cnpj, F.lit(".csv"))))
    )
    folders = I.table(spark, sf_dir, "customer").select(I.pad8(F.col("c_custkey")).alias("pasta"))
    return summary.missing_sources(folders, I.table(spark, sf_dir, "orders").select(path.alias("path")))


QUERIES = {
    "parse_filing_names": parse_filing_names,
    "read_documents": read_documents,
    "fingerprint": fingerprint,
    "status_log": status_log,
    "schema_violations": schema_violations,
    "contract_rules": contract_rules,
    "filing_keys": filing_keys,
    "filing_rejects": filing_rejects,
    "allowed_dates": allowed_dates,
    "resolve_period": resolve_period,
    "flatten_accounts": _facts,
    "flatten_nested": flatten_nested,
    "orphan_refs": orphan_refs,
    "silver_scan": silver_scan,
    "csv_typed_scan": csv_typed_scan,
    "catalog_table": catalog_table,
    "balance_qc": balance_qc,
    "balance_qc_root": balance_qc_root,
    "dedup_replacement": dedup_replacement,
    "resume_pending": resume_pending,
    "file_inventory": file_inventory,
    "source_listing": source_listing,
    "missing_sources": missing_sources,
}

_NAMED = f"""
named AS (
  SELECT o_orderkey, {pad8('o_custkey')} AS cnpj8, o_orderdate AS d, o_orderpriority AS pr,
         o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' AS draft
  FROM orders)"""

def _variants_sql() -> str:
    def text(value: str | None) -> str:
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    rows = [
        f"({i}, {text(status)}, {text(message)}, {text(path)}, {text(rule)})"
        for i, (_, _, (status, message), broken) in enumerate(I.FILING_VARIANTS)
        for path, rule in broken or [(None, None)]
    ]
    return f"""
        SELECT o_orderkey AS doc_id, CAST(o_orderkey % {len(I.FILING_VARIANTS)} AS BIGINT) AS variant, v.status, v.mensagem, v.path, v.rule
        FROM orders JOIN (VALUES {', '.join(rows)}) AS v(variant, status, mensagem, path, rule)
          ON o_orderkey % {len(I.FILING_VARIANTS)} = v.variant"""


_TYPED = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_LOST = "o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P'"

ORACLES = {
    "contract_rules": _variants_sql(),
    "filing_keys": f"""
        SELECT o_orderkey, {pad8('o_custkey')} AS cnpj_key,
               CASE WHEN {_TYPED} THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%m%Y') END AS base_key,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'S' ELSE 'I' END AS submission
        FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT ({_LOST})""",
    "filing_rejects": f"""
        SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'copia de ' ELSE '' END
                 || strftime(o_orderdate, '%Y%m') || '-9011-' || {pad8('o_custkey')} || '.json' AS file_name,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'nome fora do padrão' ELSE 'JSON ilegível' END AS motivo
        FROM orders WHERE o_orderpriority = '5-LOW' OR ({_LOST})""",
    "parse_filing_names": f"""
        SELECT o_orderkey,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'typed'
                    WHEN o_orderpriority <> '5-LOW' THEN 'dated' END AS style,
               CASE WHEN o_orderpriority <> '5-LOW' THEN {pad8('o_custkey')} END AS cnpj,
               CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y%m') END AS base,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'I' WHEN '2-HIGH' THEN 'S' END AS submission
        FROM orders""",
    "read_documents": """
        SELECT doc_id, doc_id AS id_lido, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars
        FROM documents""",
    "fingerprint": "SELECT doc_id, substr(sha256(text), 1, 16) AS sha256_16 FROM documents",
    "status_log": f"""WITH {_JUDGED}
        SELECT doc_id, file_name AS arquivo, status,
               CASE WHEN status = 'error' THEN 'JSON ilegível'
                    WHEN status = 'skip' THEN 'prefixo sem regra'
                    WHEN status = 'valid' THEN ''
                    WHEN pr = '5-LOW' AND s = 'O' THEN 'Não é 9011'
                    ELSE 'Violou schema' END AS mensagem
        FROM judged""",
    "schema_violations": """
        SELECT o_orderkey AS doc_id, v.path, v.rule
        FROM orders JOIN (VALUES
            ('3-MEDIUM', 'P', '@unidadeMedida', 'value'),
            ('4-NOT SPECIFIED', 'O', 'observacao', 'additionalProperties'),
            ('4-NOT SPECIFIED', 'F', 'BalancoPatrimonial.contas[]', '@nivel'),
            ('4-NOT SPECIFIED', 'P', 'DemonstracaoDosFluxosDeCaixa', 'required'),
            ('5-LOW', 'P', 'DemonstracaoDoResultado', 'oneOf')
          ) AS v(pr, s, path, rule) ON o_orderpriority = v.pr AND o_orderstatus = v.s""",
    "allowed_dates": f"""WITH {_JUDGED}
        SELECT doc_id, 'dt1' AS id, CAST(year(d) AS VARCHAR) || '-12-31' AS periodo FROM judged WHERE status = 'valid'
        UNION ALL
        SELECT doc_id, 'dt3', strftime(last_day(d), '%Y-%m-%d') FROM judged WHERE status = 'valid'""",
    "resolve_period": """
        WITH kinds AS (
          SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate AS d,
                 substr('AASITTX', l_linenumber, 1) AS kind FROM lineitem)
        SELECT l_orderkey, l_partkey, l_linenumber, kind || strftime(d, '%m%Y') AS tag,
               CASE WHEN kind = 'A' THEN strftime(d, '%Y') || '-12-31'
                    WHEN kind IN ('S', 'I') AND month(d) = 6 THEN strftime(d, '%Y') || '-06-30'
                    WHEN kind IN ('S', 'I') THEN strftime(d, '%Y') || '-12-31'
                    WHEN kind = 'T' THEN strftime(last_day(d), '%Y-%m-%d') END AS periodo
        FROM kinds""",
    "flatten_accounts": f"WITH {_FACTS} SELECT * FROM facts",
    "flatten_nested": f"""
        WITH levels AS (
          SELECT k, '1' || repeat('.1', CAST(k AS INTEGER) - 1) AS nivel, pow(0.5::DOUBLE, k - 1) AS share
          FROM range(1, {I.DEEPEST + 1}) AS r(k)
          UNION ALL SELECT 2, '1.2', -1.0::DOUBLE)
        SELECT l_orderkey, l_linenumber, l_partkey, {pad8('l_suppkey')} AS cnpj,
               strftime(l_shipdate, '%Y') || '-12-31' AS periodo, 'BP' AS bloco, 'IND' AS escopo,
               nivel, 'NIVEL ' || nivel AS descricao, l_extendedprice * share AS valor
        FROM lineitem JOIN levels ON k <= l_partkey % {I.DEEPEST} + 1""",
    "orphan_refs": f"""WITH {_JUDGED}
        SELECT doc_id, 'BP' AS bloco, '2.1' AS nivel, 'IND' AS escopo, 'dt9' AS dt_base, p AS valor
        FROM judged WHERE status = 'valid' AND pr = '2-HIGH'""",
    "silver_scan": f"""
        SELECT {pad8('l_linenumber')} AS cnpj, strftime(l_shipdate, '%Y') || '-12-31' AS periodo,
               CASE WHEN l_linestatus = 'O' THEN 'BP' ELSE 'DR' END AS bloco,
               CASE WHEN l_returnflag = 'N' THEN 'CON' ELSE 'IND' END AS escopo,
               '1.' || l_suppkey AS nivel, 'CONTA ' || l_returnflag AS descricao, l_extendedprice AS valor
        FROM lineitem""",
    "csv_typed_scan": f"""
        SELECT {pad8('o_custkey')} AS cnpj, strftime(o_orderdate, '%Y-%m-%d') AS periodo, 'BP' AS bloco,
               o_orderstatus AS escopo, CAST(o_orderkey AS VARCHAR) AS nivel, {I.free_text_sql('o_orderpriority')} AS descricao,
               o_totalprice AS valor
        FROM orders""",
    "balance_qc": _balance_sql("nivel LIKE '1%'", "nivel LIKE '2%'"),
    "balance_qc_root": _balance_sql("nivel = '1'", "nivel = '2'"),
    "dedup_replacement": f"""
        WITH ranked AS (
          SELECT o_orderkey, {pad8('o_custkey')} AS cnpj_key, strftime(o_orderdate, '%m%Y') AS base_key,
                 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'S' ELSE 'I' END AS submission,
                 row_number() OVER (
                   PARTITION BY o_custkey, strftime(o_orderdate, '%m%Y')
                   ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, o_orderkey) AS rn
          FROM orders)
        SELECT o_orderkey, cnpj_key, base_key, submission FROM ranked WHERE rn = 1""",
    "resume_pending": """
        SELECT o_orderkey, o_orderstatus FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey = o.o_orderkey AND d.o_orderstatus = 'F')""",
    "file_inventory": f"""WITH {_NAMED}
        SELECT CASE WHEN NOT draft THEN cnpj8 END AS cnpj8, count(*) AS arquivos,
               min(CASE WHEN NOT draft THEN strftime(d, '%Y%m') END) AS primeiro,
               max(CASE WHEN NOT draft THEN strftime(d, '%Y%m') END) AS ultimo
        FROM named GROUP BY 1""",
    "source_listing": f"""WITH {_NAMED}
        SELECT o_orderkey, cnpj8, CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes,
               year(d) || CASE WHEN month(d) <= 6 THEN '-S1' ELSE '-S2' END AS semestre_label,
               strftime(d, '%Y%m') || '-9010-' || cnpj8 || CASE WHEN pr = '5-LOW' THEN '.PDF' ELSE '.pdf' END AS arquivo
        FROM named WHERE NOT draft""",
    "missing_sources": f"""
        SELECT {pad8('c_custkey')} AS pasta FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
}

ORACLES["catalog_table"] = ORACLES["silver_scan"]
