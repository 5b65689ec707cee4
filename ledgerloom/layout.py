"""Fixed names and values of the data contracts (inputs, outputs, messages)."""

from __future__ import annotations

# --- Fixed values: statement blocks read into the fact table, with their short codes ---------------------
STATEMENT_CODES = {
    "BalancoPatrimonial": "BP",
    "DemonstracaoDoResultado": "DR",
    "DemonstracaoDoResultadoAbrangente": "DRA",
    "DemonstracaoDosFluxosDeCaixa": "DFC",
    "DemonstracaoDasMutacoesDoPatrimonioLiquido": "DMPL",
}

# --- Fixed values: filing contract -----------------------------------------------------------------------
DOCUMENT_CODE = "9011"
DOCUMENT_CODES = ["9011", "9311", "9031", "9331", "9061"]
SUBMISSION_TYPES = ["I", "S"]
HEADER_KEYS = [
    "@cnpj",
    "@codigoDocumento",
    "@tipoRemessa",
    "@dataBase",
    "@unidadeMedida",
    "datasBaseReferencia",
]
REQUIRED_BLOCKS = [
    "BalancoPatrimonial",
    "DemonstracaoDoResultadoAbrangente",
    "DemonstracaoDosFluxosDeCaixa",
    "DemonstracaoDasMutacoesDoPatrimonioLiquido",
]
INCOME_BLOCKS = ["DemonstracaoDoResultado", "DemonstracaoDeSobrasOuPerdas"]  # exactly one of the two
# block -> must it carry `contas`?
BLOCK_NEEDS_ACCOUNTS = {
    "BalancoPatrimonial": True,
    "BalancoPatrimonialConsolidado": True,
    "DemonstracaoDoResultado": False,
    "DemonstracaoDoResultadoConsolidada": True,
    "DemonstracaoDeSobrasOuPerdas": True,
    "DemonstracaoDeSobrasOuPerdasConsolidada": True,
    "DemonstracaoDoResultadoAbrangente": False,
    "DemonstracaoDoResultadoAbrangenteConsolidada": False,
    "DemonstracaoDosFluxosDeCaixa": False,
    "DemonstracaoDosFluxosDeCaixaConsolidada": False,
    "DemonstracaoDasMutacoesDoPatrimonioLiquido": False,
    "DemonstracaoDasMutacoesDoPatrimonioLiquidoConsolidada": False,
    "DemonstracaoDosRecursosDeConsorcioConsolidada": True,
    "DemonstracaoDeVariacoesNasDisponibilidadesDeGruposConsolidada": True,
}
ACCOUNT_KEYS = ["@id", "@nivel", "@descricao", "@contaPai"]
VALUE_KEYS = ["valoresIndividualizados", "valoresConsolidados"]
IDENTIFIER_PATTERN = r"^[a-zA-Z0-9._-]+$"
LEVEL_PATTERN = r"^[0-9]+([.][0-9]+)*$"
CNPJ_PATTERN = r"^[0-9]{8}$"
BASE_DATE_PATTERN = r"^(0[1-9]|1[0-2])[0-9]{4}$"
TAG_PATTERN = r"^(A|S|T|I)(0[1-9]|1[0-2])[0-9]{4}$"

# --- Fixed values: period tags accepted per file-name prefix ---------------------------------------------
DEFAULT_RULES = {
    "202112": ["A122020"],
    "202212": ["A122021"],
    "202312": ["A122022"],
    "202412": ["A122023", "A122024"],
}

# --- Fixed values: file names ----------------------------------------------------------------------------
FILING_NAME_TYPED = r"^(\d{8})_9011_([IS])_(\d{8})\.json$"
FILING_NAME_DATED = r"^(\d{6})-9011-(\d{8})\.json$"
SOURCE_NAME = r"(?i)^(\d{6})-(\d{4})-(\d{8})\.pdf$"
PREDICTION_NAME = r"(?i)^([a-f0-9]{64})_([a-z]+)-(.+)\.json$"
FORBIDDEN_IN_NAMES = r'[/\\:*?"<>|]'

# --- Fixed values: status texts --------------------------------------------------------------------------
UNREADABLE = "JSON ilegível"
WRONG_TYPE = "Não é 9011"
BROKEN_CONTRACT = "Violou schema"
NO_RULE = "prefixo sem regra"

# --- Fixed values: fact table ----------------------------------------------------------------------------
FACT_COLUMNS = ["cnpj", "periodo", "bloco", "escopo", "nivel", "descricao", "valor"]
FACT_SCHEMA = (
    "cnpj string, periodo string, bloco string, escopo string, nivel string, descricao string, valor double"
)

# --- Fixed values: panel columns, in output order --------------------------------------------------------
CONTEXT_COLUMNS = ["Semestre_Ref", "Ano", "Mes", "YYYYMM", "CNPJ8", "Arquivo_PDF"]
SECTION_FIELDS = {
    "Identificacao": [
        "Razao_Social",
        "CNPJ",
        "Auditor_Independente",
        "Opiniao_Auditor",
        "Enfase_Auditor",
        "Eventos_Subsequentes_Adversos",
    ],
    "Contas_Base": [
        "Ativo_Total",
        "Patrimonio_Liquido",
        "Lucro_Liquido",
        "Caixa_Equivalentes",
        "Obrigacoes_Liquidacao",
        "Receita_Servicos",
        "Despesa_Processamento",
        "Resultado_Financeiro",
        "Despesa_Operacional_Total",
        "Provisao_Perdas",
        "Fluxo_Caixa_Operacional",
        "Ativo_Intangivel",
        "Ativo_Partes_Relacionadas",
        "Passivo_Partes_Relacionadas",
        "Provisao_Contingencias",
        "Ativo_Fiscal_Diferido",
    ],
    "Indicadores": [
        "Liquidez_Imediata",
        "Indice_Capitalizacao",
        "ROE",
        "Margem_Servicos",
        "Indice_Eficiencia",
    ],
}
SECTION_PREFIX = {"Identificacao": "Ident__", "Contas_Base": "Contas__", "Indicadores": "Indic__"}
IDENT_COLUMNS = ["Ident__" + f for f in SECTION_FIELDS["Identificacao"]]
ACCOUNT_COLUMNS = ["Contas__" + f for f in SECTION_FIELDS["Contas_Base"]]
RATIO_COLUMNS = ["Indic__" + f for f in SECTION_FIELDS["Indicadores"]]
PANEL_COLUMNS = CONTEXT_COLUMNS + IDENT_COLUMNS + ACCOUNT_COLUMNS + RATIO_COLUMNS
PANEL_SCHEMA = ", ".join(
    [f"{c} {'int' if c in ('Ano', 'Mes') else 'string'}" for c in CONTEXT_COLUMNS]
    + [f"{c} string" for c in IDENT_COLUMNS]
    + [f"{c} double" for c in ACCOUNT_COLUMNS + RATIO_COLUMNS]
)

# --- Fixed values: anonymisation -------------------------------------------------------------------------
NOISE_COLUMNS = [
    "Contas__Lucro_Liquido",
    "Contas__Receita_Servicos",
    "Contas__Despesa_Processamento",
    "Contas__Resultado_Financeiro",
    "Contas__Despesa_Operacional_Total",
    "Contas__Provisao_Perdas",
]
PRIVATE_COLUMNS = ["Ident__CNPJ", "CNPJ8", "Ident__Razao_Social", "Arquivo_PDF"]
LARGE_AUDITOR_PATTERN = (
    r"(?iU)\b(PwC|PricewaterhouseCoopers|KPMG|Ernst\s*&\s*Young|EY|Deloitte|DTT)\b"
)
LARGE_AUDITOR = "Big 4"
OTHER_AUDITOR = "Outros"

MAPPING_SCHEMA = (
    "inst_hash string, Semestre_Ref string, Ident__CNPJ string, Ident__Razao_Social string, "
    "Fator_Escalonamento double, `Var_%_ROE` double, `Var_%_Eficiencia` double, "
    "`Var_%_Liquidez` double, `Var_%_Capitalizacao` double"
)

# --- Fixed values: forecasts -----------------------------------------------------------------------------
UNAVAILABLE = "INDISPONÍVEL"
HIT, MISS, NOT_ASSESSABLE = "✓ Acertou", "✗ Errou", "—"
PROFIT, LOSS, NEUTRAL = "Lucro", "Prejuízo", "Neutro (zero)"
NO_RANGE = "N/A (LLM não informou faixa)"

# --- Fixed values: blank characters removed around texts -------------------------------------------------
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
