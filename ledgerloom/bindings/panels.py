"""Queries over extraction records and the panel: flattening, drift, anonymisation, pseudonyms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerloom import layout, sinks
from ledgerloom.bindings import inputs as I
from ledgerloom.bindings.filings import pad8
from ledgerloom.functions import variants as V
from ledgerloom.functions.identity import cnpj8_of
from ledgerloom.operators import anonymize as A
from ledgerloom.operators import history, pseudonymize, scorecard, sections, summary
from ledgerloom.plans.anonymisation import anonymised_tables, run_pseudonyms
from ledgerloom.plans.panel import panel_from_extractions
from ledgerloom.session import materialise, new_table_path
from ledgerloom.sources import tables as T

# --- SQL shared by several checks ------------------------------------------------------------------------------

_S = I.SETTINGS
ONE = "00000001"


def unit_draw(*key: str) -> str:
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(CAST(CAST('0x' || substr(sha256({joined}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def uniform(low: float, high: float, *key: str) -> str:
    return f"({low!r}::DOUBLE + {unit_draw(*key)} * {high - low!r}::DOUBLE)"


def entity_hash(cnpj8: str) -> str:
    return f"sha256('{I.SALT}::' || {cnpj8})"


def factor(inst_hash: str) -> str:
    return uniform(_S.factor_min, _S.factor_max, f"'{I.SALT}'", str(_S.seed), inst_hash)


def noise(inst_hash: str, period: str, column: str) -> str:
    return uniform(_S.noise_min, _S.noise_max, f"'{I.SALT}'", str(_S.seed + 1), inst_hash, period, f"'{column}'")


def divide(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0.0::DOUBLE), 0.0::DOUBLE)"


def rounded(x: str, digits: int) -> str:
    return f"round_even({x}, {digits})"


def _ratio_sql(prefix: str = "") -> dict[str, str]:
    def c(name: str) -> str:
        return f"{prefix}Contas__{name}"

    return {
        "Indic__Liquidez_Imediata": divide(c("Caixa_Equivalentes"), c("Obrigacoes_Liquidacao")),
        "Indic__Indice_Capitalizacao": divide(c("Patrimonio_Liquido"), c("Ativo_Total")),
        "Indic__ROE": divide(c("Lucro_Liquido"), c("Patrimonio_Liquido")),
        "Indic__Margem_Servicos": f"{c('Receita_Servicos')} - {c('Despesa_Processamento')}",
        "Indic__Indice_Eficiencia": divide(
            c("Despesa_Operacional_Total"), f"({c('Receita_Servicos')} + {c('Resultado_Financeiro')})"
        ),
    }


def _ratios_rounded() -> str:
    return ", ".join(
        f"{rounded(e, 2 if n == 'Indic__Margem_Servicos' else _S.digits)} AS {n}" for n, e in _ratio_sql().items()
    )


_PANEL = f"""
lines AS (
  SELECT l_orderkey, sum(x) AS ext, sum(x * y) AS disc, sum(x * t) AS tax, sum(q) AS qty,
         sum(CASE WHEN l_linestatus = 'O' THEN q END) AS qty_open,
         sum(CASE WHEN l_returnflag = 'N' THEN x END) AS ext_n,
         sum(CASE WHEN l_returnflag = 'R' THEN x END) AS ext_r,
         sum(CASE WHEN l_returnflag = 'A' THEN x END) AS ext_a,
         sum(CASE WHEN l_linestatus = 'O' THEN x * y END) AS disc_open,
         sum(CASE WHEN l_linestatus <> 'O' THEN x * y END) AS disc_closed, count(*) AS n
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18, 2)) AS x, CAST(l_discount AS DECIMAL(18, 2)) AS y,
               CAST(l_tax AS DECIMAL(18, 2)) AS t, CAST(l_quantity AS DECIMAL(18, 2)) AS q FROM lineitem)
  GROUP BY l_orderkey),
sums AS (
  SELECT {pad8('o_custkey')} AS CNPJ8, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS Ano,
         CAST(CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END AS INTEGER) AS Mes,
         coalesce(sum(ext), 0)::DOUBLE AS Contas__Ativo_Total,
         coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 0)::DOUBLE AS Contas__Patrimonio_Liquido,
         coalesce(sum(disc), 0)::DOUBLE - coalesce(sum(tax), 0)::DOUBLE AS Contas__Lucro_Liquido,
         coalesce(sum(qty), 0)::DOUBLE AS Contas__Caixa_Equivalentes,
         coalesce(sum(qty_open), 0)::DOUBLE AS Contas__Obrigacoes_Liquidacao,
         coalesce(sum(ext_n), 0)::DOUBLE AS Contas__Receita_Servicos,
         coalesce(sum(disc), 0)::DOUBLE AS Contas__Despesa_Processamento,
         coalesce(sum(tax), 0)::DOUBLE AS Contas__Resultado_Financeiro,
         coalesce(sum(ext_r), 0)::DOUBLE AS Contas__Despesa_Operacional_Total,
         coalesce(sum(ext_a), 0)::DOUBLE AS Contas__Provisao_Perdas,
         coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18, 2)) END), 0)::DOUBLE
           AS Contas__Fluxo_Caixa_Operacional,
         coalesce(sum(n), 0)::DOUBLE AS Contas__Ativo_Intangivel,
         coalesce(sum(disc_open), 0)::DOUBLE AS Contas__Ativo_Partes_Relacionadas,
         coalesce(sum(disc_closed), 0)::DOUBLE AS Contas__Passivo_Partes_Relacionadas,
         count(*)::DOUBLE AS Contas__Provisao_Contingencias,
         0.0::DOUBLE AS Contas__Ativo_Fiscal_Diferido,
         min(o_orderpriority) AS pr, max(o_orderstatus) AS st
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
  GROUP BY o_custkey, year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END),
panel AS (
  SELECT Ano || CASE WHEN Mes = 6 THEN '-S1' ELSE '-S2' END AS Semestre_Ref, Ano, Mes,
         Ano || lpad(CAST(Mes AS VARCHAR), 2, '0') AS YYYYMM, CNPJ8,
         Ano || lpad(CAST(Mes AS VARCHAR), 2, '0') || '-9010-' || CNPJ8 || '.pdf' AS Arquivo_PDF,
         'Cliente ' || o_custkey AS Ident__Razao_Social, CNPJ8 || '000191' AS Ident__CNPJ,
         CASE pr WHEN '1-URGENT' THEN 'KPMG Brasil' WHEN '2-HIGH' THEN 'Ernst & Young S/S'
                 WHEN '3-MEDIUM' THEN 'Keynes Auditores' WHEN '4-NOT SPECIFIED' THEN 'deloitte touche' END
           AS Ident__Auditor_Independente,
         CASE WHEN st = 'P' THEN 'Com Ressalva' ELSE 'Sem Ressalva' END AS Ident__Opiniao_Auditor,
         'Não' AS Ident__Enfase_Auditor, 'Não' AS Ident__Eventos_Subsequentes_Adversos,
         {', '.join(layout.ACCOUNT_COLUMNS)},
         {', '.join(f'{e} AS {n}' for n, e in _ratio_sql().items())}
  FROM sums)"""


def _ordinal(cutoff: tuple[int, int]) -> str:
    return f"Ano * 10 + CASE WHEN Mes <= 6 THEN 1 ELSE 2 END <= {cutoff[0] * 10 + cutoff[1]}"


_SCALED = f"""{_PANEL},
hashed AS (SELECT *, {entity_hash('CNPJ8')} AS inst_hash FROM panel),
factored AS (SELECT *, {factor('inst_hash')} AS fator FROM hashed),
scaled AS (
  SELECT * REPLACE ({', '.join(f'{c} * fator AS {c}' for c in layout.ACCOUNT_COLUMNS)}) FROM factored)"""

_CATEGORY = (
    "CASE WHEN regexp_matches({0}, '(?i)\\b(PwC|PricewaterhouseCoopers|KPMG|Ernst\\s*&\\s*Young|EY|Deloitte|DTT)\\b') "
    "THEN 'Big 4' ELSE 'Outros' END"
)

_TRANSFORMED = f"""{_SCALED},
noisy AS (
  SELECT * REPLACE (
    {', '.join(f"{c} * {noise('inst_hash', 'Semestre_Ref', c)} AS {c}" for c in layout.NOISE_COLUMNS)},
    {_CATEGORY.format('Ident__Auditor_Independente')} AS Ident__Auditor_Independente)
  FROM scaled WHERE {_ordinal(I.CUTOFF)}),
renamed AS (
  SELECT * EXCLUDE ({', '.join(layout.RATIO_COLUMNS)}),
         {', '.join(f'{c} AS orig_{c}' for c in layout.RATIO_COLUMNS)} FROM noisy),
transformed AS (SELECT *, {_ratios_rounded()} FROM renamed)"""


def _change(column: str) -> str:
    return rounded(
        f"coalesce(({column} / nullif(orig_{column}, 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE, 0.0::DOUBLE)", 4
    )


# --- queries ---------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_record(I.extraction_texts(spark, sf_dir))


def _whole_record(records: DataFrame, *keep: str) -> DataFrame:
    """All fields that occur in records, those without a panel column included."""
    record = F.col("record")
    foreign = [
        F.try_variant_get(record, "$.Contas_Base.Campo_Novo", "bigint").alias("Campo_Novo"),
        F.try_variant_get(record, "$.Notas.x", "bigint").alias("Notas_x"),
    ]
    return records.select(*keep, *sections.section_columns(record), *foreign)


def read_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).withColumn("usable", F.col("record").isNotNull())
    return _whole_record(records, "event_id", "file_name", "readable", "usable")


def flatten_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.flatten_sections(_records(spark, sf_dir).filter("readable"), keep=("event_id",))


def unwrap_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they were parsed, lists of one or more included, taken out of their lists."""
    parsed = I.extraction_texts(spark, sf_dir).select("event_id", F.try_parse_json("text").alias("json"))
    return _whole_record(parsed.select("event_id", V.unwrap_single(F.col("json")).alias("record")), "event_id")


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.schema_drift(_records(spark, sf_dir), key="event_id")


def panel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "panel")
    sinks.write_csv(I.panel(spark, sf_dir), path, ";", bom=True)
    return T.panel_scan(spark, path)


def _with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a remark of several lines."""
    return I.panel(spark, sf_dir).withColumn("Ident__Enfase_Auditor", I.free_text(F.col("CNPJ8")))


def panel_scan_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels with permuted, missing and foreign columns in one folder, next to files that are no panels."""
    folder = new_table_path(spark, "mixed")
    panel = materialise(_with_notes(spark, sf_dir), "panel-rows")
    halves = F.col("Mes") <= 6
    shuffled = panel.filter(halves).select("Ano", "Mes", *reversed([c for c in panel.columns if c not in ("Ano", "Mes")]))
    sinks.write_csv(shuffled, f"{folder}/a", ";", bom=True)
    lacking = panel.filter(~halves).drop("Ident__Auditor_Independente").withColumn('Nova "Coluna"; 2', F.lit("x;y\nz"))
    sinks.write_csv(lacking, f"{folder}/b", ";")
    sinks.write_csv(I.table(spark, sf_dir, "region"), f"{folder}/c", ";")
    return T.panel_scan(spark, f"{folder}/*")


def panel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel written per institution and found again."""
    path = new_table_path(spark, "panels")
    sinks.write_panel(_with_notes(spark, sf_dir), path)
    return T.discover_panels(spark, path).drop("path", "ordem")


def mapping_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping whose columns are in another order, with one more column."""
    path = new_table_path(spark, "mapping")
    key = F.col("c_custkey")
    mapping = I.table(spark, sf_dir, "customer").select(
        F.lit("x\n;y").alias("Outra"),
        F.col("c_acctbal").alias("Fator_Escalonamento"),
        I.free_text(F.col("c_name")).alias("Ident__Razao_Social"),
        I.pad8(key).alias("inst_hash"),
        F.lit("2024-S1").alias("Semestre_Ref"),
        F.concat(I.pad8(key), F.lit("000191")).alias("Ident__CNPJ"),
        *[F.lit(None).cast("double").alias(c) for c in ("Var_%_ROE", "Var_%_Eficiencia", "Var_%_Liquidez", "Var_%_Capitalizacao")],
    )
    sinks.write_csv(mapping, path, ";", bom=True)
    return T.mapping_scan(spark, path)


def extraction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records written per institution and read back."""
    path = new_table_path(spark, "extractions")
    texts = I.extraction_texts(spark, sf_dir)
    sinks.write_extractions(texts.withColumn("CNPJ8", F.substring("file_name", 13, 8)), path)
    return _whole_record(T.stored_extractions(spark, path), "CNPJ8", "file_name", "readable")


def one_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from_extractions(_records(spark, sf_dir), only=ONE)


def semester_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.semester_cutoff(I.panel(spark, sf_dir), *I.CUTOFF)


def cutoff_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cutoff_excluded(I.panel(spark, sf_dir), *I.EARLY_CUTOFF)


def hash_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = I.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("CNPJ8"))
    return A.hash_entities(keys, I.SALT).select("c_custkey", "inst_hash")


def entity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = I.table(spark, sf_dir, "orders").select(I.pad8(F.col("o_custkey")).alias("CNPJ8"))
    return A.entity_factors(A.hash_entities(keys, I.SALT), _S)


def cell_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.hash_entities(
        I.table(spark, sf_dir, "orders").select("o_orderkey", I.pad8(F.col("o_custkey")).alias("CNPJ8"), "o_orderpriority"),
        I.SALT,
    )
    return cells.select(
        "o_orderkey",
        *[
            A.cell_noise(F.col("inst_hash"), F.col("o_orderpriority"), c, _S).alias(c)
            for c in layout.NOISE_COLUMNS
        ],
    )


def scale_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = A.scale_by_entity(A.hash_entities(I.panel(spark, sf_dir), I.SALT), _S)
    return scaled.select("inst_hash", "Semestre_Ref", *layout.ACCOUNT_COLUMNS)


def scale_by_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stored factors of an earlier run: a lookup join."""
    hashed = A.hash_entities(I.panel(spark, sf_dir), I.SALT)
    scaled = A.scale_by_entity(hashed, factors=entity_factors(spark, sf_dir))
    return scaled.select("inst_hash", "Semestre_Ref", *layout.ACCOUNT_COLUMNS)


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recalculate_ratios(I.panel(spark, sf_dir), _S.digits).select(
        "CNPJ8", "Semestre_Ref", *layout.RATIO_COLUMNS
    )


def auditor_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.auditor_distribution(I.panel(spark, sf_dir))


def anonymized_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.anonymized_panel(A.transform_panel(I.panel(spark, sf_dir), *I.CUTOFF, _S))


def audit_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_mapping(A.transform_panel(I.panel(spark, sf_dir), *I.CUTOFF, _S))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_summary(I.panel(spark, sf_dir), *I.EARLY_CUTOFF)


def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _records(spark, sf_dir).select(F.substring("file_name", 13, 8).alias("cnpj8"), "readable")
    return summary.processing_stats(results)


def next_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.next_period(I.panel(spark, sf_dir))


def _public_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole panel under hashes, less identities."""
    return A.hash_entities(I.panel(spark, sf_dir), I.SALT).drop(*layout.PRIVATE_COLUMNS)


def _typed_rows(panel: DataFrame, texts: DataFrame, payload: Column, *keep: str) -> DataFrame:
    """The rows within JSON texts, with all their columns."""
    rows = F.posexplode(F.from_json(payload, ArrayType(panel.drop("inst_hash").schema)))
    return texts.select(*keep, rows.alias("pos", "row")).select(*keep, "pos", "row.*")


def history_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with all columns of the panel but identities, read back from their texts."""
    panel = _public_panel(spark, sf_dir)
    return _typed_rows(panel, history.history_payload(panel), F.col("payload"), "inst_hash", "part", "n")


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in parts of three rows."""
    panel = _public_panel(spark, sf_dir)
    return _typed_rows(panel, history.history_payload(panel, rows=3), F.col("payload"), "inst_hash", "part", "n")


def user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the history in each message, and the rows of the history."""
    panel = _public_panel(spark, sf_dir)
    messages = history.user_message(history.history_payload(panel))
    start = F.locate("[", F.col("mensagem"))
    parts = messages.select(
        "inst_hash", F.substr("mensagem", F.lit(1), start - 1).alias("inicio"), F.substr("mensagem", start).alias("payload")
    )
    return _typed_rows(panel, parts, F.col("payload"), "inst_hash", "inicio")


def pseudonymize_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize.pseudonymize(_plain_facts(spark, sf_dir), I.SALT, I.SECRET)


def pseudonym_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of the job written as CSV; the first read back."""
    path = new_table_path(spark, "pseudonyms")
    run_pseudonyms(_plain_facts(spark, sf_dir), f"{path}/out", f"{path}/private", I.SALT, I.SECRET)
    return T.csv_typed_scan(spark, f"{path}/out", "inst_hash string, id bigint, valor double")


def pseudonym_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The private mapping of the job, read back."""
    path = new_table_path(spark, "pseudonyms")
    run_pseudonyms(_plain_facts(spark, sf_dir), f"{path}/out", f"{path}/private", I.SALT, I.SECRET)
    return T.csv_typed_scan(spark, f"{path}/private", "inst_hash string, cnpj string, k_multiplier double")


def anonymisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymised_tables(I.panel(spark, sf_dir), *I.EARLY_CUTOFF, _S).summary


def _institution_files(spark: SparkSession, sf_dir: str) -> str:
    """CSVs of institutions, of which some have none, others lack a column, hold no number, or can't be read."""
    path = new_table_path(spark, "institutions")
    kind, net = F.col("CNPJ8").cast("int") % 7, "Contas__Lucro_Liquido"
    panel = materialise(I.panel(spark, sf_dir), "panel-rows")
    texts = panel.withColumn(net, F.when(kind == 5, "sem valor").otherwise(F.col(net).cast("string")))
    sinks.write_panel(texts.filter(kind.isin(0, 5, 6)), f"{path}/a")
    sinks.write_panel(panel.filter(kind == 1).drop("Semestre_Ref"), f"{path}/b")
    sinks.write_panel(panel.filter(kind == 2).drop(net), f"{path}/c")
    broken = panel.filter(kind == 4).select(F.concat("Semestre_Ref", F.lit(";1;2")).alias("Semestre_Ref;x"), F.col("CNPJ8").alias("inst"))
    sinks.write_folders(broken.repartition("inst").sortWithinPartitions("inst"), "inst", f"{path}/d", ",")
    return path


def truth_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one semester by institution from its CSV, or the reason why there is none."""
    path, cnpj = _institution_files(spark, sf_dir), I.pad8(F.col("c_custkey"))
    institutions = I.table(spark, sf_dir, "customer").select(cnpj.alias("inst_hash"), cnpj.alias("CNPJ8"))
    target = F.lit(f"{I.CUTOFF[0]}-S{I.CUTOFF[1]}")
    headers = T.institution_headers(spark, path)
    return scorecard.ground_truth(
        institutions, T.truth_scan(spark, path, headers), target, T.truth_files(spark, path, headers)
    )


def panel_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in the institutions' CSVs; the fingerprint is checked for its form."""
    found = T.panel_inputs(spark, _institution_files(spark, sf_dir))
    good = F.col("legivel") & (F.size("missing") == 0)
    return found.groupBy("CNPJ8").agg(
        F.sum("records").alias("registros"), F.bool_and(good).alias("lido"),
        F.bool_and(F.col("sha256_16").rlike("^[0-9a-f]{16}$")).alias("impresso"),
    )


def pseudonymize_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize.pseudonymize(_plain_facts(spark, sf_dir), I.SALT, I.SECRET, noise=0.02, noise_key=["id"])


def pseudonym_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize.pseudonym_mapping(_plain_facts(spark, sf_dir), I.SALT, I.SECRET)


def _plain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), I.pad8(F.col("o_custkey")).alias("cnpj"), F.col("o_totalprice").alias("valor")
    )


def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    digits = F.concat(I.pad8(key), F.lit("000191"))
    text = (
        F.when(
            segment == "HOUSEHOLD",
            F.concat_ws(
                "",
                F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3), F.lit("."), F.substring(digits, 6, 3),
                F.lit("/0001-91"),
            ),
        )
        .when(segment == "MACHINERY", F.concat(key.cast("string"), F.lit("000191")))
        .when(segment == "BUILDING", "sem CNPJ")
        .when(segment != "AUTOMOBILE", digits)
    )
    number = (key * 1_000_000 + 191).cast("double")
    return I.table(spark, sf_dir, "customer").select(
        "c_custkey", cnpj8_of(text).alias("de_texto"), cnpj8_of(number, "double").alias("de_numero")
    )


QUERIES = {
    "read_extractions": read_extractions,
    "flatten_sections": flatten_sections,
    "unwrap_singleton": unwrap_singleton,
    "schema_drift": schema_drift,
    "panel_scan": panel_scan,
    "panel_scan_mixed": panel_scan_mixed,
    "panel_store": panel_store,
    "mapping_scan": mapping_scan,
    "extraction_store": extraction_store,
    "one_institution": one_institution,
    "semester_cutoff": semester_cutoff,
    "cutoff_excluded": cutoff_excluded,
    "hash_entities": hash_entities,
    "entity_factors": entity_factors,
    "cell_noise": cell_noise,
    "scale_by_entity": scale_by_entity,
    "scale_by_mapping": scale_by_mapping,
    "ratios": ratios,
    "auditor_category": auditor_category,
    "anonymized_panel": anonymized_panel,
    "audit_mapping": audit_mapping,
    "run_summary": run_summary,
    "processing_stats": processing_stats,
    "next_period": next_period,
    "history_payload": history_payload,
    "history_rows": history_rows,
    "user_message": user_message,
    "pseudonymize_v1": pseudonymize_v1,
    "pseudonym_csv": pseudonym_csv,
    "pseudonym_store": pseudonym_store,
    "anonymisation_summary": anonymisation_summary,
    "truth_reasons": truth_reasons,
    "panel_inputs": panel_inputs,
    "pseudonymize_noise": pseudonymize_noise,
    "pseudonym_mapping": pseudonym_mapping,
    "normalize_ids": normalize_ids,
}

_RECORDS = f"""
records AS (
  SELECT event_id, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         strftime(ts, '%Y%m') AS yyyymm, CAST(year(ts) AS INTEGER) AS ano, CAST(month(ts) AS INTEGER) AS mes,
         {pad8('user_id')} AS cnpj8,
         NOT (event_type = 'error' AND value < 20) AS readable,
         NOT (event_type = 'error' AND value < 20) AND NOT (event_type = 'signup' AND value < 10)
           AND NOT (event_type = 'click' AND value < 5) AS usable
  FROM events)"""


def _section_fields_sql() -> dict[str, str]:
    fields = {
        "Ident__Razao_Social": "'Inst ' || user_id",
        "Ident__CNPJ": "cnpj8 || '000191'",
        "Ident__Auditor_Independente": "CASE WHEN k < 50 THEN 'KPMG Auditores' ELSE 'Auditores Locais' END",
        "Ident__Opiniao_Auditor": "'Sem Ressalva'",
        "Ident__Enfase_Auditor": "'Não'",
        "Ident__Eventos_Subsequentes_Adversos": "kind",
    }
    for j, name in enumerate(layout.ACCOUNT_COLUMNS, 1):
        fields[name] = f"value + {float(j)}::DOUBLE"
    fields["Contas__Ativo_Fiscal_Diferido"] = "CASE WHEN kind <> 'view' THEN value + 16.0::DOUBLE END"
    for j, name in enumerate(layout.RATIO_COLUMNS, 1):
        fields[name] = f"CASE WHEN kind <> 'error' THEN CAST(k * {j} AS DOUBLE) END"
    return {name: f"CASE WHEN usable THEN {e} END" for name, e in fields.items()}


def _cells_sql(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in fields.items())


def _flatten_sections_sql(only: str = "TRUE", key: str = "event_id, ") -> str:
    return f"""WITH {_RECORDS}
        SELECT {key}ano || CASE WHEN mes <= 6 THEN '-S1' ELSE '-S2' END AS Semestre_Ref, ano AS Ano, mes AS Mes,
               yyyymm AS YYYYMM, cnpj8 AS CNPJ8, yyyymm || '-9010-' || cnpj8 || '.pdf' AS Arquivo_PDF,
               {_cells_sql(_section_fields_sql())}
        FROM records WHERE readable AND {only}"""


def _whole_record_sql(keep: str) -> str:
    foreign = {
        "Campo_Novo": "CASE WHEN usable AND kind = 'purchase' THEN k END",
        "Notas_x": "CASE WHEN usable AND kind = 'signup' THEN k END",
    }
    return f"WITH {_RECORDS} SELECT {keep}, {_cells_sql(_section_fields_sql() | foreign)} FROM records"


def _drift_sql() -> str:
    missing = ", ".join(f"('error', 'missing', 'Indicadores', '{f}')" for f in layout.SECTION_FIELDS["Indicadores"])
    return f"""WITH {_RECORDS}
        SELECT event_id, v.tipo, v.secao, v.campo FROM records JOIN (VALUES
            {missing}, ('view', 'missing', 'Contas_Base', 'Ativo_Fiscal_Diferido'),
            ('purchase', 'unmapped', 'Contas_Base', 'Campo_Novo'), ('signup', 'unmapped', 'Notas', 'x')
          ) AS v(kind, tipo, secao, campo) USING (kind)
        WHERE usable"""


def _history_sql(rows: int, head: str) -> str:
    return f"""WITH {_PANEL},
        numbered AS (
          SELECT {entity_hash('CNPJ8')} AS inst_hash, *,
                 row_number() OVER (PARTITION BY CNPJ8 ORDER BY Ano, Mes) - 1 AS place FROM panel)
        SELECT inst_hash, {head}, CAST(place % {rows} AS INTEGER) AS pos,
               {', '.join(c for c in layout.PANEL_COLUMNS if c not in layout.PRIVATE_COLUMNS)}
        FROM numbered"""


def _part_sql(rows: int) -> str:
    return _history_sql(rows, f"place // {rows} AS part, count(*) OVER (PARTITION BY inst_hash, place // {rows}) AS n")


_PSEUDO_FACTOR = uniform(0.60, 1.40, f"'{I.SECRET}'", "'k'", f"sha256('{I.SALT}' || {pad8('o_custkey')})")

ORACLES = {
    "read_extractions": _whole_record_sql("event_id, yyyymm || '-9010-' || cnpj8 || '.json' AS file_name, readable, usable"),
    "flatten_sections": _flatten_sections_sql(),
    "unwrap_singleton": _whole_record_sql("event_id"),
    "schema_drift": _drift_sql(),
    "panel_scan": f"WITH {_PANEL} SELECT * FROM panel",
    "panel_scan_mixed": f"""WITH {_PANEL}
        SELECT * REPLACE (CASE WHEN Mes <= 6 THEN Ident__Auditor_Independente END AS Ident__Auditor_Independente,
                          {I.free_text_sql('CNPJ8')} AS Ident__Enfase_Auditor) FROM panel""",
    "panel_store": f"""WITH {_PANEL} SELECT * REPLACE ({I.free_text_sql('CNPJ8')} AS Ident__Enfase_Auditor) FROM panel""",
    "mapping_scan": f"""
        SELECT {pad8('c_custkey')} AS inst_hash, '2024-S1' AS Semestre_Ref, {pad8('c_custkey')} || '000191' AS Ident__CNPJ,
               {I.free_text_sql('c_name')} AS Ident__Razao_Social, CAST(c_acctbal AS DOUBLE) AS Fator_Escalonamento,
               CAST(NULL AS DOUBLE) AS "Var_%_ROE", CAST(NULL AS DOUBLE) AS "Var_%_Eficiencia",
               CAST(NULL AS DOUBLE) AS "Var_%_Liquidez", CAST(NULL AS DOUBLE) AS "Var_%_Capitalizacao"
        FROM customer""",
    "extraction_store": _whole_record_sql("cnpj8 AS CNPJ8, yyyymm || '-9010-' || cnpj8 || '.json' AS file_name, readable"),
    "one_institution": _flatten_sections_sql(f"cnpj8 = '{ONE}'", ""),
    "semester_cutoff": f"WITH {_PANEL} SELECT * FROM panel WHERE {_ordinal(I.CUTOFF)}",
    "cutoff_excluded": f"""WITH {_PANEL}
        SELECT CNPJ8, count(*) AS linhas FROM panel p
        WHERE NOT EXISTS (SELECT 1 FROM panel q WHERE q.CNPJ8 = p.CNPJ8 AND q.{_ordinal(I.EARLY_CUTOFF)})
        GROUP BY CNPJ8""",
    "hash_entities": f"SELECT c_custkey, {entity_hash(pad8('c_custkey'))} AS inst_hash FROM customer",
    "entity_factors": f"""
        WITH h AS (SELECT DISTINCT {entity_hash(pad8('o_custkey'))} AS inst_hash FROM orders)
        SELECT inst_hash, {factor('inst_hash')} AS fator FROM h""",
    "cell_noise": f"""
        WITH h AS (SELECT o_orderkey, o_orderpriority, {entity_hash(pad8('o_custkey'))} AS inst_hash FROM orders)
        SELECT o_orderkey, {', '.join(f"{noise('inst_hash', 'o_orderpriority', c)} AS {c}" for c in layout.NOISE_COLUMNS)}
        FROM h""",
    "scale_by_entity": f"""WITH {_SCALED}
        SELECT inst_hash, Semestre_Ref, {', '.join(layout.ACCOUNT_COLUMNS)} FROM scaled""",
    "scale_by_mapping": f"""WITH {_SCALED}
        SELECT inst_hash, Semestre_Ref, {', '.join(layout.ACCOUNT_COLUMNS)} FROM scaled""",
    "ratios": f"WITH {_PANEL} SELECT CNPJ8, Semestre_Ref, {_ratios_rounded()} FROM panel",
    "auditor_category": f"""WITH {_PANEL}
        SELECT {_CATEGORY.format('Ident__Auditor_Independente')} AS categoria, count(*) AS linhas FROM panel GROUP BY 1""",
    "anonymized_panel": f"""WITH {_TRANSFORMED}
        SELECT {', '.join(['inst_hash'] + [c for c in layout.PANEL_COLUMNS if c not in layout.PRIVATE_COLUMNS])}
        FROM transformed""",
    "audit_mapping": f"""WITH {_TRANSFORMED}
        SELECT inst_hash, Semestre_Ref, Ident__CNPJ, Ident__Razao_Social, {rounded('fator', 6)} AS Fator_Escalonamento,
               {_change('Indic__ROE')} AS "Var_%_ROE", {_change('Indic__Indice_Eficiencia')} AS "Var_%_Eficiencia",
               {_change('Indic__Liquidez_Imediata')} AS "Var_%_Liquidez",
               {_change('Indic__Indice_Capitalizacao')} AS "Var_%_Capitalizacao"
        FROM transformed""",
    "run_summary": f"""WITH {_PANEL},
        kept AS (SELECT * FROM panel WHERE {_ordinal(I.EARLY_CUTOFF)})
        SELECT (SELECT count(DISTINCT CNPJ8) FROM panel) AS instituicoes_encontradas,
               (SELECT count(DISTINCT CNPJ8) FROM kept) AS instituicoes_incluidas,
               (SELECT count(DISTINCT CNPJ8) FROM panel) - (SELECT count(DISTINCT CNPJ8) FROM kept)
                 AS instituicoes_sem_dados,
               (SELECT count(*) FROM panel) AS linhas_antes_corte, (SELECT count(*) FROM kept) AS linhas_apos_corte""",
    "processing_stats": f"""WITH {_RECORDS},
        e AS (SELECT cnpj8, count(*) AS n, sum(CASE WHEN readable THEN 1 ELSE 0 END) AS m FROM records GROUP BY cnpj8)
        SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS processados, CAST(sum(n - m) AS BIGINT) AS falhas,
               count(*) FILTER (WHERE n = m) AS instituicoes_ok, count(*) FILTER (WHERE n <> m) AS instituicoes_com_falhas
        FROM e""",
    "next_period": f"""WITH {_PANEL},
        last_one AS (SELECT Ano, Mes FROM panel ORDER BY Ano DESC, Mes DESC LIMIT 1)
        SELECT CASE WHEN Mes <= 6 THEN Ano || '-S2' ELSE (Ano + 1) || '-S1' END AS semestre_alvo FROM last_one""",
    "history_payload": _part_sql(history.ROWS),
    "history_rows": _part_sql(3),
    "user_message": _history_sql(
        history.ROWS, f"'inst_hash: ' || inst_hash || chr(10) || chr(10) || '{history.HEADING}' || chr(10) AS inicio"
    ),
    "pseudonymize_v1": f"""
        SELECT sha256('{I.SALT}' || {pad8('o_custkey')}) AS inst_hash, o_orderkey AS id,
               o_totalprice * {_PSEUDO_FACTOR} AS valor FROM orders""",
    "pseudonym_csv": f"""
        SELECT sha256('{I.SALT}' || {pad8('o_custkey')}) AS inst_hash, o_orderkey AS id,
               o_totalprice * {_PSEUDO_FACTOR} AS valor FROM orders""",
    "pseudonym_store": f"""
        SELECT DISTINCT sha256('{I.SALT}' || {pad8('o_custkey')}) AS inst_hash, {pad8('o_custkey')} AS cnpj,
               {_PSEUDO_FACTOR} AS k_multiplier FROM orders""",
    "anonymisation_summary": f"""WITH {_PANEL},
        kept AS (SELECT * FROM panel WHERE {_ordinal(I.EARLY_CUTOFF)})
        SELECT (SELECT count(DISTINCT CNPJ8) FROM panel) AS instituicoes_encontradas,
               (SELECT count(DISTINCT CNPJ8) FROM kept) AS instituicoes_incluidas,
               (SELECT count(DISTINCT CNPJ8) FROM panel) - (SELECT count(DISTINCT CNPJ8) FROM kept)
                 AS instituicoes_sem_dados,
               (SELECT count(*) FROM panel) AS linhas_antes_corte, (SELECT count(*) FROM kept) AS linhas_apos_corte,
               '{I.EARLY_CUTOFF[0]}-S{I.EARLY_CUTOFF[1]}' AS corte, {_S.seed} AS seed,
               substr(sha256('{I.SALT}'), 1, 16) AS salt_sha256, {_S.factor_min}::DOUBLE AS fator_min,
               {_S.factor_max}::DOUBLE AS fator_max, {_S.noise_min}::DOUBLE AS ruido_min, {_S.noise_max}::DOUBLE AS ruido_max,
               {_S.digits} AS casas_decimais""",
    "truth_reasons": f"""WITH {_PANEL},
        asked AS (SELECT {pad8('c_custkey')} AS CNPJ8, c_custkey % 7 AS kind FROM customer),
        looked AS (
          SELECT a.*, EXISTS (SELECT 1 FROM panel p WHERE p.CNPJ8 = a.CNPJ8) AND kind <> 3 AS there,
                 r.CNPJ8 IS NOT NULL AS hit, r.Contas__Lucro_Liquido AS v
          FROM asked a LEFT JOIN panel r ON r.CNPJ8 = a.CNPJ8 AND r.Semestre_Ref = '{I.CUTOFF[0]}-S{I.CUTOFF[1]}')
        SELECT CNPJ8 AS inst_hash, CNPJ8, '{I.CUTOFF[0]}-S{I.CUTOFF[1]}' AS Semestre_Alvo,
               CASE WHEN NOT there THEN 'N/A (arquivo ' || CNPJ8 || '.csv não encontrado)'
                    WHEN kind = 4 THEN 'N/A (erro ao ler CSV)' WHEN kind = 1 THEN 'N/A (CSV sem coluna Semestre_Ref)'
                    WHEN NOT hit THEN 'N/A ({I.CUTOFF[0]}-S{I.CUTOFF[1]} ainda não disponível)'
                    WHEN kind = 2 THEN 'N/A (CSV sem coluna Contas__Lucro_Liquido)'
                    WHEN kind = 5 THEN 'N/A ({I.CUTOFF[0]}-S{I.CUTOFF[1]} com valor inválido)'
                    WHEN v > 0 THEN 'Lucro' WHEN v < 0 THEN 'Prejuízo' ELSE 'Neutro (zero)' END AS Real_Resultado,
               CASE WHEN there AND hit AND kind IN (0, 6) THEN v END AS Real_Lucro_Liquido
        FROM looked""",
    "panel_inputs": f"""WITH {_PANEL}
        SELECT CNPJ8, count(*) AS registros, CAST(CNPJ8 AS BIGINT) % 7 NOT IN (1, 4) AS lido, TRUE AS impresso
        FROM panel WHERE CAST(CNPJ8 AS BIGINT) % 7 <> 3 GROUP BY CNPJ8""",
    "pseudonymize_noise": f"""
        SELECT sha256('{I.SALT}' || {pad8('o_custkey')}) AS inst_hash, o_orderkey AS id,
               o_totalprice * {_PSEUDO_FACTOR}
                 * (1.0::DOUBLE + {uniform(-0.02, 0.02, f"'{I.SECRET}'", "'n'", 'o_orderkey')}) AS valor
        FROM orders""",
    "pseudonym_mapping": f"""
        SELECT DISTINCT sha256('{I.SALT}' || {pad8('o_custkey')}) AS inst_hash, {pad8('o_custkey')} AS cnpj,
               {_PSEUDO_FACTOR} AS k_multiplier FROM orders""",
    "normalize_ids": f"""
        SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN '' ELSE {pad8('c_custkey')} END AS de_texto,
               {pad8('c_custkey')} AS de_numero
        FROM customer""",
}
