"""Filing-shaped inputs that Spark derives, row by row or by aggregation, from the given tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import layout
from ledgerloom.functions.identity import zero_pad
from ledgerloom.functions.periods import semester_label
from ledgerloom.functions.ratios import round_to, safe_divide
from ledgerloom.operators.anonymize import Settings, entity_factor

SALT = "sal-de-exemplo-0123456789"
SECRET = "segredo-de-exemplo"
SETTINGS = Settings(salt=SALT, seed=42)
CUTOFF = (1998, 1)
EARLY_CUTOFF = (1995, 1)

# months January to September have a rule: the year and the month itself
RULES = {
    f"{year}{month:02d}": [f"A12{year}", f"T{month:02d}{year}"] for year in range(1992, 2012) for month in range(1, 10)
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of documents that one task should make, and how many a stored byte of a row becomes.
TASK_BYTES, GROWTH = 32 << 20, 64


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows become documents, dealt out by its first column.

    A row of a table makes a document of many times its size, so splits that suit the table are too coarse for the
    documents; rows are therefore dealt out while they are still narrow, to as many tasks as the documents will ask for
    and at least one per core. Their number is given, since adaptive execution would measure the narrow rows.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size * GROWTH // TASK_BYTES))
    return rows.repartition(tasks, F.col(columns[0]))


def pad8(key: Column) -> Column:
    return zero_pad(key.cast("string"), 8)


def free_text(value: Column) -> Column:
    """Text with a line break, quotes, separators and blanks at its ends, as auditors write it."""
    return F.concat(F.lit(' Nota "'), value, F.lit('"; linha um,\nlinha ""dois"" '))


def free_text_sql(value: str) -> str:
    return f"""(' Nota "' || {value} || '"; linha um,' || chr(10) || 'linha ""dois"" ')"""


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")


# --- filings: one document per order -----------------------------------------------------------------------


def _number(value: Column) -> Column:
    """A double as JSON has it; what is no number is quoted."""
    text = value.cast("string")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def _member(name: str, text: Column, quote: str = "") -> Column:
    """A member after others; a null one is left out."""
    return F.coalesce(F.concat(F.lit(f',"{name}":{quote}'), text, F.lit(quote)), F.lit(""))


def _value(date_id: str, amount: Column) -> Column:
    return F.concat(F.lit(f'{{"@dtBase":"{date_id}"'), _member("@valor", _number(amount)), F.lit("}"))


def _account(
    ident: str, level: str | Column, text: str, parent: str, ind: list[Column] | None = None, con: list[Column] | None = None
) -> Column:
    """An account; of its lists of values those that are given. Values after the first bring their comma."""
    lists = {"valoresIndividualizados": ind, "valoresConsolidados": con}
    return F.concat(
        F.lit(f'{{"@id":"{ident}","@nivel":"'), F.lit(level) if isinstance(level, str) else level,
        F.lit(f'","@descricao":"{text}","@contaPai":"{parent}"'),
        *[part for name, values in lists.items() if values for part in (F.lit(f',"{name}":['), *values, F.lit("]"))],
        F.lit("}"),
    )


def _after(*values: Column) -> list[Column]:
    """Values with commas between them."""
    return [part for i, value in enumerate(values) for part in ([F.lit(",")] if i else []) + [value]]


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, file_name, text). Order priority and status decide what is wrong with a document."""
    o = spread_table(
        spark, sf_dir, "orders",
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    )
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    year, month = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM")
    cnpj = pad8(F.col("o_custkey"))

    def case(p: str, s: str) -> Column:
        return (priority == p) & (status == s)

    # texts are put together, which costs a fraction of what to_json of a nested struct does
    results = F.concat(
        F.lit('{"contas":['),
        _account("r1", "3", "RECEITA", "", ind=_after(_value("dt2", price * 0.125), _value("dt3", price))),
        F.lit("]}"),
    )
    tags = {
        "dt1": F.concat(F.lit("A12"), year),
        "dt2": F.concat(F.lit("S06"), year),
        "dt3": F.concat(F.lit("T"), month, year),
        "dt4": F.concat(F.lit("I12"), (F.year("o_orderdate") - 1).cast("string")),
    }
    references = [F.concat(F.lit(f'{{"@id":"{i}"'), _member("@data", tag, '"'), F.lit("}")) for i, tag in tags.items()]
    accounts = [
        _account(
            "1", "1", "ATIVO", "",
            ind=_after(_value("dt1", price), _value("dt3", price * 0.5)),
            con=[_value("dt1", price * 2.0)],
        ),
        _account(
            "1.1", F.when(case("4-NOT SPECIFIED", "F"), "1..1").otherwise("1.1"), "  CIRCULANTE ", "1",
            ind=_after(_value("dt1", price * 0.5), _value("dt2", price * 0.25)),
        ),
        _account("2", "2", "PASSIVO", "", ind=[_value("dt1", F.when(status == "F", price).otherwise(price * 0.5))]),
        _account(
            "2.1", "2.1", "DEPOSITOS", "2",
            ind=[
                _value("dt1", price * 0.5),
                F.when(priority == "2-HIGH", F.concat(F.lit(","), _value("dt9", price))).otherwise(""),
            ],
        ),
        _account("2.2", "2.2", "OUTROS", "2"),
    ]
    cash = F.concat(F.lit('{"contas":['), _account("c1", "6.1", "CAIXA", "", con=[_value("dt3", -price)]), F.lit("]}"))
    text = F.concat(
        F.lit("{"),
        F.coalesce(F.concat(F.lit('"@cnpj":"'), cnpj, F.lit('",')), F.lit("")),
        F.when(case("5-LOW", "O"), '"@codigoDocumento":"9311"').otherwise('"@codigoDocumento":"9011"'),
        F.when(priority == "2-HIGH", ',"@tipoRemessa":"S"').otherwise(',"@tipoRemessa":"I"'),
        _member("@dataBase", F.concat(month, year), '"'),
        F.lit(',"@unidadeMedida":'), F.when(case("3-MEDIUM", "P"), "1.5").when(status == "O", "1000.0").otherwise("1.0"),
        F.lit(',"datasBaseReferencia":['), *_after(*references), F.lit("]"),
        F.lit(',"BalancoPatrimonial":{"contas":['), *_after(*accounts), F.lit("]}"),
        _member("DemonstracaoDoResultado", results),
        _member("DemonstracaoDeSobrasOuPerdas", F.when(case("5-LOW", "P"), results)),
        F.lit(',"DemonstracaoDoResultadoAbrangente":{}'),
        _member("DemonstracaoDosFluxosDeCaixa", F.when(~case("4-NOT SPECIFIED", "P"), cash)),
        F.lit(',"DemonstracaoDasMutacoesDoPatrimonioLiquido":{"contas":['),
        _account("m1", "7", "CAPITAL", "", ind=[_value("dt4", price * 0.5)]),
        # the last two characters of some are lost
        F.when(case("5-LOW", "F"), "]").when(case("4-NOT SPECIFIED", "O"), ']},"observacao":"x"}').otherwise("]}}"),
    )
    name = F.concat(month_of(F.col("o_orderdate")), F.lit("-9011-"), cnpj, F.lit(".json"))
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("/raw/"), zero_pad(F.col("o_orderkey").cast("string"), 19), F.lit("/"), name).alias("path"),
        name.alias("file_name"),
        text.alias("text"),
    )


_ACCOUNT_TEXT = '{"@id":"%s","@nivel":"%s","@descricao":"CONTA","@contaPai":""%s}'
_VALUE_TEXT = ',"valoresIndividualizados":[{"@dtBase":"dt1","@valor":10}]'
SAMPLE_FILING = (
    '{"@cnpj":"01234567","@codigoDocumento":"9011","@tipoRemessa":"I","@dataBase":"122024","@unidadeMedida":1000,'
    '"datasBaseReferencia":[{"@id":"dt1","@data":"A122024"}],'
    f'"BalancoPatrimonial":{{"contas":[{_ACCOUNT_TEXT % ("a", "1", _VALUE_TEXT)},{_ACCOUNT_TEXT % ("b", "2", "")}]}},'
    f'"DemonstracaoDoResultado":{{"contas":[{_ACCOUNT_TEXT % ("c", "3", "")}]}},'
    '"DemonstracaoDoResultadoAbrangente":{},'
    f'"DemonstracaoDosFluxosDeCaixa":{{"contas":[{_ACCOUNT_TEXT % ("d", "4", "")}]}},'
    f'"DemonstracaoDasMutacoesDoPatrimonioLiquido":{{"contas":[{_ACCOUNT_TEXT % ("e", "5", "")}]}}}}'
)
_BP, _DR, _REF = "BalancoPatrimonial", "DemonstracaoDoResultado", "datasBaseReferencia"
_OK, _BAD, _OTHER, _NOT_JSON = ("valid", ""), ("invalid", "Violou schema"), ("invalid", "Não é 9011"), ("error", "JSON ilegível")

#: What is changed in the sample filing, what it becomes, the status, and the broken rules.
FILING_VARIANTS: list[tuple[str, str, tuple[str, str], list[tuple[str, str]]]] = [
    ("@none", "", _OK, []),
    ('"@unidadeMedida":1000', '"@unidadeMedida" : 1e3', _OK, []),
    ('"@cnpj":', '"@cnpj":5,"@cnpj":', _OK, []),
    ('"@nivel":"1"', '"@nivel":false,"@nivel":"1"', _OK, []),
    ('"@valor":10', '"@valor":"x","@valor":10', _OK, []),
    ('"@valor":10}', '"@valor":10,"nota":"x"}', _OK, []),
    ('"', "'", _NOT_JSON, []),
    ("CONTA", "CON\tTA", _NOT_JSON, []),
    ("01234567", '0123"4567', _NOT_JSON, []),
    ('"9011"', "9011", _OTHER, [("@codigoDocumento", "value")]),
    ('"9011"', '"9311"', _OTHER, []),
    ('"@unidadeMedida":1000', '"@unidadeMedida":NaN', _BAD, [("@unidadeMedida", "value")]),
    ('"@unidadeMedida":1000', '"@unidadeMedida":"1000"', _BAD, [("@unidadeMedida", "value")]),
    ('"@dataBase":"122024",', "", _BAD, [("@dataBase", "required")]),
    ("122024", "132024", _BAD, [("@dataBase", "value"), (f"{_REF}[]", "@data")]),
    ("01234567", "1234567", _BAD, [("@cnpj", "value")]),
    ('"I"', '"X"', _BAD, [("@tipoRemessa", "value")]),
    ('{"@cnpj"', '{"extra":{"a":1},"@cnpj"', _BAD, [("extra", "additionalProperties")]),
    (f'"{_BP}"', '"Outro"', _BAD, [(_BP, "required"), ("Outro", "additionalProperties")]),
    (f'"{_DR}":', '"DemonstracaoX":', _BAD, [(_DR, "oneOf"), ("DemonstracaoX", "additionalProperties")]),
    ('[{"@id":"dt1","@data":"A122024"}]', "[]", _BAD, [(_REF, "minItems")]),
    ('[{"@id":"dt1","@data":"A122024"}]', '"dt1"', _BAD, [(_REF, "type")]),
    ('{"@id":"dt1","@data":"A122024"}', '{"@id":"dt1","@data":"A122024"},{"@data":"A122024","@id":"dt1"}', _BAD, [(_REF, "uniqueItems")]),
    ('"@data":"A122024"', '"@data":"A122024","x":1', _BAD, [(f"{_REF}[]", "additionalProperties")]),
    ('"@id":"dt1",', "", _BAD, [(f"{_REF}[]", "required")]),
    ('"@nivel":"1"', '"@nivel":"1..2"', _BAD, [(f"{_BP}.contas[]", "@nivel")]),
    ('"@nivel":"1",', "", _BAD, [(f"{_BP}.contas[].@nivel", "required")]),
    ('"@id":"a"', '"@id":"a b"', _BAD, [(f"{_BP}.contas[]", "@id")]),
    ('"@valor":10', '"@valor":"10"', _BAD, [(f"{_BP}.contas[].valoresIndividualizados[]", "@valor")]),
    ('"@dtBase":"dt1",', "", _BAD, [(f"{_BP}.contas[].valoresIndividualizados[]", "required")]),
    ('[{"@dtBase":"dt1","@valor":10}]', "[]", _BAD, [(f"{_BP}.contas[].valoresIndividualizados", "minItems")]),
    ('{"@dtBase":"dt1","@valor":10}', '{"@dtBase":"dt1","@valor":10},{"@dtBase":"dt1","@valor":10.0}', _BAD,
     [(f"{_BP}.contas[].valoresIndividualizados", "uniqueItems")]),
    ('"DemonstracaoDoResultadoAbrangente":{}', '"DemonstracaoDoResultadoAbrangente":null', _BAD,
     [("DemonstracaoDoResultadoAbrangente", "type")]),
    ('"DemonstracaoDoResultadoAbrangente":{}', '"DemonstracaoDoResultadoAbrangente":{"x":[]}', _BAD,
     [("DemonstracaoDoResultadoAbrangente.x", "additionalProperties")]),
    (f'"{_BP}":', f'"{_BP}":{{}},"{_BP}":', _OK, []),
    (f'"{_BP}":{{"contas":', f'"{_BP}":{{"linhas":', _BAD, [(f"{_BP}.contas", "required"), (f"{_BP}.linhas", "additionalProperties")]),
]


def filing_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, variant, file_name, text): per order a filing in which one thing is changed; its CNPJ and values are the
    order's unless they are what is changed."""
    o = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    variant = F.col("o_orderkey") % len(FILING_VARIANTS)
    find, put = (F.array(*[F.lit(v[i]) for v in FILING_VARIANTS]) for i in (0, 1))
    text = F.replace(F.lit(SAMPLE_FILING), F.get(find, F.col("variant").cast("int")), F.get(put, F.col("variant").cast("int")))
    own = F.replace(text, F.lit('"01234567"'), F.concat(F.lit('"'), pad8(F.col("o_custkey")), F.lit('"')))
    return o.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", variant.alias("variant")).select(
        "doc_id", "variant", F.concat(F.lit("202412-9011-"), pad8(F.col("o_custkey")), F.lit(".json")).alias("file_name"), own.alias("text")
    )


DEEPEST = 12


def nested_filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, file_name, text) per line item, with accounts in accounts, 1 to 12 levels deep.

    The second level has an account beside the one that goes on, and an item that is no account.
    """
    li = spread_table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
    )
    price, year = F.col("l_extendedprice"), F.date_format("l_shipdate", "yyyy")
    depth = F.col("l_partkey") % DEEPEST + 1

    def account(level: str, amount: Column, below: Column) -> Column:
        head = f'{{"@id":"{level}","@nivel":"{level}","@descricao":"NIVEL {level}","@contaPai":"",'
        value = F.concat(F.lit('"valoresIndividualizados":[{"@dtBase":"dt1","@valor":'), amount.cast("string"), F.lit("}]"))
        return F.concat(F.lit(head), value, below, F.lit("}"))

    inner = F.lit("")
    for k in range(DEEPEST, 0, -1):
        items = account("1" + ".1" * (k - 1), price * 0.5 ** (k - 1), inner)
        if k == 2:
            items = F.concat(F.lit('"nota",'), account("1.2", -price, F.lit("")), F.lit(","), items)
        inner = F.when(depth >= k, F.concat(F.lit(',"contas":['), items, F.lit("]"))).otherwise("")
    dates = F.concat(F.lit('"datasBaseReferencia":[{"@id":"dt1","@data":"A12'), year, F.lit('"}]'))
    text = F.concat(
        F.lit('{"@cnpj":"'), pad8(F.col("l_suppkey")), F.lit('","@codigoDocumento":"9011","@unidadeMedida":1,'), dates,
        F.lit(',"BalancoPatrimonial":{'), F.substr(inner, F.lit(2)), F.lit("}}"),
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(month_of(F.col("l_shipdate")), F.lit("-9011-"), pad8(F.col("l_suppkey")), F.lit(".json")).alias("file_name"),
        text.alias("text"),
    )


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows straight from line items; the institution is the line number, so partitions stay few."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        pad8(F.col("l_linenumber")).alias("cnpj"),
        F.concat(F.date_format("l_shipdate", "yyyy"), F.lit("-12-31")).alias("periodo"),
        F.when(F.col("l_linestatus") == "O", "BP").otherwise("DR").alias("bloco"),
        F.when(F.col("l_returnflag") == "N", "CON").otherwise("IND").alias("escopo"),
        F.concat(F.lit("1."), F.col("l_suppkey").cast("string")).alias("nivel"),
        F.concat_ws(" ", F.lit("CONTA"), "l_returnflag").alias("descricao"),
        F.col("l_extendedprice").alias("valor"),
    )


# --- stored documents as bytes -------------------------------------------------------------------------------


def gzip_bytes(content: Column) -> Column:
    def compress(batch: pd.Series) -> pd.Series:
        return batch.map(lambda c: None if c is None else gzip.compress(c, mtime=0))

    return F.pandas_udf(compress, T.BinaryType())(content)


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, content): texts in JSON, stored as Latin-1, with BOM, gzipped, or with bytes around them."""
    d = spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    json = F.to_json(F.struct("doc_id", "text"))
    utf8 = json.cast("binary")
    fits = json.rlike(r"(?s)^[\x00-\xff]*$")
    latin = F.encode(F.when(fits, json), "ISO-8859-1")
    content = (
        F.when(F.col("lang") == "fr", F.coalesce(latin, utf8))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(F.col("lang") == "es", gzip_bytes(F.when(F.col("lang") == "es", utf8)))
        .otherwise(F.concat(F.lit("\n  ").cast("binary"), utf8, F.lit(" fim").cast("binary")))
    )
    return d.select("doc_id", "lang", content.alias("content"))


# --- extraction records: one per event -------------------------------------------------------------------------


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def extraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, file_name, text): records of three sections in the shapes that occur in storage."""
    e = spread_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    kind, value, k = F.col("event_type"), F.col("value"), _props_k()
    ident = F.struct(
        F.concat(F.lit("Inst "), F.col("user_id").cast("string")).alias("Razao_Social"),
        F.concat(pad8(F.col("user_id")), F.lit("000191")).alias("CNPJ"),
        F.when(k < 50, "KPMG Auditores").otherwise("Auditores Locais").alias("Auditor_Independente"),
        F.lit("Sem Ressalva").alias("Opiniao_Auditor"),
        F.lit("Não").alias("Enfase_Auditor"),
        kind.alias("Eventos_Subsequentes_Adversos"),
    )
    names = layout.SECTION_FIELDS["Contas_Base"]
    accounts = [(value + float(j)).alias(n) for j, n in enumerate(names[:-1], 1)]
    accounts.append(F.when(kind != "view", value + float(len(names))).alias(names[-1]))
    accounts.append(F.when(kind == "purchase", k).alias("Campo_Novo"))
    ratios = F.struct(*[(k * j).alias(n) for j, n in enumerate(layout.SECTION_FIELDS["Indicadores"], 1)])
    record = F.to_json(
        F.struct(
            ident.alias("Identificacao"),
            F.struct(*accounts).alias("Contas_Base"),
            F.when(kind != "error", ratios).alias("Indicadores"),
            F.when(kind == "signup", F.struct(k.alias("x"))).alias("Notas"),
        )
    )
    text = (
        F.when(kind == "view", F.concat(F.lit("["), record, F.lit("]")))
        .when((kind == "signup") & (value < 10), F.concat(F.lit("["), record, F.lit(","), record, F.lit("]")))
        .when((kind == "error") & (value < 20), F.substr(record, F.lit(1), F.length(record) - 1))
        .when((kind == "click") & (value < 5), F.lit('"texto"'))
        .otherwise(record)
    )
    return e.select(
        "event_id",
        F.concat(month_of(F.col("ts")), F.lit("-9010-"), pad8(F.col("user_id")), F.lit(".json")).alias("file_name"),
        text.alias("text"),
    )


# --- panel: customers by semester ------------------------------------------------------------------------------


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """33-column panel. Line items are summed per order first, so the join and the last sum see one row per order.

    The few lines of an order may lie anywhere in the table, where partial sums hardly make fewer rows but each of them
    several times as wide. Lines are therefore exchanged as they are, in short types, and summed where they arrive.
    """
    dec = "decimal(18,2)"
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    kinds = {"N": 1, "R": 2, "A": 3}
    narrow = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        *[F.col(c).cast(dec).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")],
        (status == "O").alias("open"),
        F.when(flag == "N", kinds["N"]).when(flag == "R", kinds["R"]).when(flag == "A", kinds["A"]).cast("byte").alias("kind"),
    )
    price, discount, tax, quantity = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    open_line, kind = F.col("open"), F.col("kind")

    def total(column: Column, when: Column | None = None) -> Column:
        return F.sum(column if when is None else F.when(when, column))

    lines = (
        narrow.repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            total(price).alias("ext"),
            total(price * discount).alias("disc"),
            total(price * tax).alias("tax"),
            total(quantity).alias("qty"),
            total(quantity, open_line).alias("qty_open"),
            total(price, kind == kinds["N"]).alias("ext_n"),
            total(price, kind == kinds["R"]).alias("ext_r"),
            total(price, kind == kinds["A"]).alias("ext_a"),
            total(price * discount, open_line).alias("disc_open"),
            total(price * discount, ~open_line).alias("disc_closed"),
            F.count("*").alias("lines"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        # numbers in place of texts keep the aggregate below a hash aggregate
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_totalprice").cast(dec).alias("price"),
        F.year("o_orderdate").alias("Ano"),
        F.when(F.month("o_orderdate") <= 6, 6).otherwise(12).alias("Mes"),
    )

    def as_double(column: Column) -> Column:
        return F.coalesce(column, F.lit(0)).cast("double")

    summed = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey", "Ano", "Mes")
        .agg(
            as_double(F.sum("ext")).alias("Contas__Ativo_Total"),
            as_double(F.sum("price")).alias("Contas__Patrimonio_Liquido"),
            (as_double(F.sum("disc")) - as_double(F.sum("tax"))).alias("Contas__Lucro_Liquido"),
            as_double(F.sum("qty")).alias("Contas__Caixa_Equivalentes"),
            as_double(F.sum("qty_open")).alias("Contas__Obrigacoes_Liquidacao"),
            as_double(F.sum("ext_n")).alias("Contas__Receita_Servicos"),
            as_double(F.sum("disc")).alias("Contas__Despesa_Processamento"),
            as_double(F.sum("tax")).alias("Contas__Resultado_Financeiro"),
            as_double(F.sum("ext_r")).alias("Contas__Despesa_Operacional_Total"),
            as_double(F.sum("ext_a")).alias("Contas__Provisao_Perdas"),
            as_double(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("price")))).alias(
                "Contas__Fluxo_Caixa_Operacional"
            ),
            as_double(F.sum("lines")).alias("Contas__Ativo_Intangivel"),
            as_double(F.sum("disc_open")).alias("Contas__Ativo_Partes_Relacionadas"),
            as_double(F.sum("disc_closed")).alias("Contas__Passivo_Partes_Relacionadas"),
            as_double(F.count("*")).alias("Contas__Provisao_Contingencias"),
            F.lit(0.0).alias("Contas__Ativo_Fiscal_Diferido"),
            F.min("priority").alias("p"),
            F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("s"),
        )
    )
    cnpj8 = pad8(F.col("o_custkey"))
    yyyymm = F.concat(F.col("Ano").cast("string"), F.lpad(F.col("Mes").cast("string"), 2, "0"))
    p = F.col("p")
    contextual = summed.withColumns(
        {
            "Semestre_Ref": semester_label(F.col("Ano"), F.col("Mes")),
            "YYYYMM": yyyymm,
            "CNPJ8": cnpj8,
            "Arquivo_PDF": F.concat(yyyymm, F.lit("-9010-"), cnpj8, F.lit(".pdf")),
            "Ident__Razao_Social": F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string")),
            "Ident__CNPJ": F.concat(cnpj8, F.lit("000191")),
            "Ident__Auditor_Independente": F.when(p == 1, "KPMG Brasil")
            .when(p == 2, "Ernst & Young S/S")
            .when(p == 3, "Keynes Auditores")
            .when(p == 4, "deloitte touche"),
            "Ident__Opiniao_Auditor": F.when(F.col("s") == 1, "Com Ressalva").otherwise("Sem Ressalva"),
            "Ident__Enfase_Auditor": F.lit("Não"),
            "Ident__Eventos_Subsequentes_Adversos": F.lit("Não"),
            "Indic__Liquidez_Imediata": safe_divide(
                F.col("Contas__Caixa_Equivalentes"), F.col("Contas__Obrigacoes_Liquidacao")
            ),
            "Indic__Indice_Capitalizacao": safe_divide(
                F.col("Contas__Patrimonio_Liquido"), F.col("Contas__Ativo_Total")
            ),
            "Indic__ROE": safe_divide(F.col("Contas__Lucro_Liquido"), F.col("Contas__Patrimonio_Liquido")),
            "Indic__Margem_Servicos": F.col("Contas__Receita_Servicos") - F.col("Contas__Despesa_Processamento"),
            "Indic__Indice_Eficiencia": safe_divide(
                F.col("Contas__Despesa_Operacional_Total"),
                F.col("Contas__Receita_Servicos") + F.col("Contas__Resultado_Financeiro"),
            ),
        }
    )
    return contextual.select(*layout.PANEL_COLUMNS)


# --- forecasts: one response per event -------------------------------------------------------------------------


MODELS = [
    f"{kind}_{model}"
    for kind in ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
    for model in ("alpha-1.5", "beta", "gamma")
    if (kind, model) != ("ERROR", "alpha-1.5")  # cheap error events are all unusable
]


def _cents(value: Column) -> Column:
    return F.rint(value * 100.0).cast("bigint")


def range_text() -> Column:
    """Range in the notation of the event type, from the value in cents."""
    n = _cents(F.col("value"))

    def dotted(x: Column) -> Column:
        return F.translate(F.format_number(x, 0), ",", ".")

    def text(x: Column) -> Column:
        return x.cast("string")

    return (
        F.when(
            F.col("event_type") == "click",
            F.concat(F.lit("Entre "), dotted(n * 1000), F.lit(" e "), dotted(n * 2000)),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(
                F.lit("Entre R$ "), text(F.expr("cast(rint(value * 100.0) as bigint) div 10")), F.lit(","),
                text(n % 10), F.lit("M e R$ "), text(n), F.lit("M"),
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("entre -"), dotted(n * 1000), F.lit(" e "), dotted(n * 2000)),
        )
        .when(
            F.col("event_type") == "signup",
            F.concat(text(n * 1000), F.lit(" a "), text(n * 2000)),
        )
        .when(F.col("value") < 100, F.concat(F.lit("cerca de "), F.format_string("%.2f", F.col("value"))))
        .otherwise("sem estimativa")
    )


def forecast_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns with the parts of a forecast."""
    k = F.col("k")
    hashed = F.sha2(F.concat(F.lit(SALT + "::"), pad8(F.col("user_id"))), 256)
    kind, value = F.col("event_type"), F.col("value")
    model = F.when(value < 20, "alpha-1.5").when(value < 60, "beta").otherwise("gamma")
    ending = F.when((kind == "error") & (k < 10), ".error.json").otherwise(".json")
    name = F.when((kind == "signup") & (k < 5), F.concat(F.lit("nota_"), F.col("event_id").cast("string"), F.lit(".json")))
    return (
        spread_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
        .select("event_id", "ts", "user_id", "event_type", "value", _props_k().alias("k"))
        .withColumns({"inst_hash": hashed, "model": model})
        .withColumns(
            {
                "path": F.concat(
                    F.lit("/json/"), zero_pad(F.col("event_id").cast("string"), 19), F.lit("/"),
                    F.coalesce(name, F.concat("inst_hash", F.lit("_"), kind, F.lit("-"), "model", ending)),
                ),
                "outcome": F.when(k >= 95, "").when(k >= 40, "Lucro").otherwise("Prejuízo"),
                "viability": F.when(k < 50, "Saudável").when(k < 80, "Atenção").when(k < 90, "Alto Risco").otherwise(""),
                "faixa": F.when(k < 90, range_text()),
            }
        )
    )


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, path, text and the event columns): responses as models write them."""
    e = forecast_events(spark, sf_dir)
    value, kind = F.col("value"), F.col("event_type")
    projection = F.struct(F.col("faixa").alias("faixa_estimada_valor"))
    target = F.lit("2024-S1")
    nested = F.struct(
        target.alias("semestre_alvo"),
        F.col("outcome").alias("resultado_final_esperado"),
        F.col("viability").alias("viabilidade_operacional"),
        projection.alias("projecao_resultado_absoluto"),
    )
    half = F.struct(target.alias("semestre_alvo"), F.lit("").alias("resultado_final_esperado"))
    at_root = F.struct(
        F.col("outcome").alias("resultado_final_esperado"),
        F.col("viability").alias("viabilidade_operacional"),
        projection.alias("projecao_resultado_absoluto"),
    )
    json = (
        F.when(value < 30, F.to_json(F.struct(nested.alias("predicao_proximo_semestre"))))
        .when(value < 80, F.to_json(nested))
        .otherwise(F.to_json(F.struct(half.alias("predicao_proximo_semestre"), "outcome_fields.*")))
    )
    e = e.withColumn("outcome_fields", at_root)
    text = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("Aqui está o JSON solicitado:\n"), json))
        .when(kind == "purchase", F.concat(F.lit("["), json, F.lit("]")))
        .when((kind == "error") & (value < 15), F.substr(json, F.lit(1), F.lit(20)))
        .when((kind == "error") & (value < 25), F.lit("[1, 2]"))
        .otherwise(json)
    )
    return e.withColumn("text", text).drop("outcome_fields")


def _user_semesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    late = F.dayofmonth("ts") > 15
    return (
        e.groupBy("user_id", late.alias("late"))
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
            F.count("*").alias("n"),
            F.max("value").alias("top"),
        )
        .withColumns(
            {
                "CNPJ8": pad8(F.col("user_id")),
                "Ano": F.when(F.col("late"), 2024).otherwise(2023),
                "Mes": F.when(F.col("late"), 6).otherwise(12),
            }
        )
        .withColumn("Semestre_Ref", semester_label(F.col("Ano"), F.col("Mes")))
        .withColumn("YYYYMM", F.when(F.col("late"), "202406").otherwise("202312"))
    )


def user_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows per user and semester; late rows may lack the CNPJ."""
    u = _user_semesters(spark, sf_dir)
    hashed = F.sha2(F.concat(F.lit(SALT + "::"), F.col("CNPJ8")), 256)
    cnpj = F.when(F.col("late") & (F.col("top") > 250), None).when(F.col("late") & (F.col("top") > 200), "").otherwise(
        F.concat("CNPJ8", F.lit("000191"))
    )
    return u.select(
        hashed.alias("inst_hash"),
        "Semestre_Ref",
        cnpj.alias("Ident__CNPJ"),
        F.concat(F.lit("Inst "), F.col("user_id").cast("string"), F.lit(" "), "Semestre_Ref").alias("Ident__Razao_Social"),
    ).withColumn("Fator_Escalonamento", round_to(entity_factor(F.col("inst_hash"), SETTINGS), 6))


def user_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the forecasts were made from: everything up to 2023-S2."""
    return _user_semesters(spark, sf_dir).filter(~F.col("late")).select("Ano", "Mes")


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual results of users with some volume; the result is unknown after an outlier."""
    net = (F.col("total") - F.col("n") * 50).cast("double")
    return (
        _user_semesters(spark, sf_dir)
        .filter(F.col("total") > 1300)
        .select(
            "CNPJ8", "Semestre_Ref", "YYYYMM",
            F.when(F.col("top") <= 300, net).alias("Contas__Lucro_Liquido"),
        )
    )
