"""Guarded arithmetic and the five panel ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(df: DataFrame, name: str) -> Column:
    """Column as double; anything that is not a number is null. Typed columns skip the text check."""
    column = F.col(f"`{name}`")
    if is_text_column(df, name):
        return F.when(column.rlike(_NUMBER_TEXT), column.try_cast("double"))
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def is_text_column(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString().startswith(("string", "varchar", "char"))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0 or missing, or the numerator is missing."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0.0)), F.lit(0.0))


def round_to(value: Column, digits: int) -> Column:
    """Half-even on the scaled binary value."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def percent_change(new: Column, old: Column) -> Column:
    """((new / old) - 1) * 100, and 0 without a base of comparison."""
    return F.coalesce((new / F.nullif(old, F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0), F.lit(0.0))


def panel_ratios(account: dict[str, Column], digits: int) -> dict[str, Column]:
    """The five ratios from account columns keyed by their panel name."""
    zero = F.lit(0.0)

    def filled(name: str) -> Column:
        return F.coalesce(account[name], zero)

    return {
        "Indic__Liquidez_Imediata": round_to(
            safe_divide(account["Contas__Caixa_Equivalentes"], account["Contas__Obrigacoes_Liquidacao"]), digits
        ),
        "Indic__Indice_Capitalizacao": round_to(
            safe_divide(account["Contas__Patrimonio_Liquido"], account["Contas__Ativo_Total"]), digits
        ),
        "Indic__ROE": round_to(
            safe_divide(account["Contas__Lucro_Liquido"], account["Contas__Patrimonio_Liquido"]), digits
        ),
        "Indic__Margem_Servicos": round_to(
            filled("Contas__Receita_Servicos") - filled("Contas__Despesa_Processamento"), 2
        ),
        "Indic__Indice_Eficiencia": round_to(
            safe_divide(
                account["Contas__Despesa_Operacional_Total"],
                filled("Contas__Receita_Servicos") + filled("Contas__Resultado_Financeiro"),
            ),
            digits,
        ),
    }
