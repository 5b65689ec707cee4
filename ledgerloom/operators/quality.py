"""Balance check on the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = "decimal(28,6)"  # exact sums: the result does not depend on the order of the rows; amounts below 1e22


def balance_qc(facts: DataFrame, root_only: bool = False, tolerance: float = 0.01) -> DataFrame:
    """Institutions and periods whose individual balance sheet differs between assets and liabilities.

    Levels that start with 1 are assets, with 2 liabilities and equity; parents and children are summed alike.
    `root_only` compares the two top levels alone. A key with only one side is not reported. One aggregate with
    map-side partial sums covers both sides. Sums are exact; a key with an amount of 1e22 or more, or without a finite
    one, is summed in double precision instead, so that no single value stops the job.
    """
    level = F.col("nivel")

    exact = F.col("valor").try_cast(_EXACT)

    def side(digit: str) -> Column:
        match = (level == digit) if root_only else level.startswith(digit)
        fits = F.count_if(match & F.col("valor").isNotNull() & exact.isNull()) == 0
        total = F.try_sum(F.when(match, exact))
        return F.when(fits & total.isNotNull(), total.cast("double")).otherwise(F.sum(F.when(match, F.col("valor")))), fits, total

    (one, one_fits, one_exact), (two, two_fits, two_exact) = side("1"), side("2")
    apart = F.when(one_fits & two_fits, F.coalesce((one_exact - two_exact).cast("double"), one - two)).otherwise(one - two)
    return (
        facts.filter((F.col("bloco") == "BP") & (F.col("escopo") == "IND"))
        .groupBy("cnpj", "periodo")
        .agg(F.abs(apart).alias("diff"))
        .filter(F.col("diff") >= tolerance)
    )
