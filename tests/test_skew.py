"""A third of all rows under one key: the same results, whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.anonymize import scale_by_entity
from ledgerloom.operators.forecasts import deanonymize_range
from ledgerloom.operators.joins import lookup_join
from ledgerloom.operators.quality import balance_qc
from ledgerloom.operators.replacement import dedup_replacement
from ledgerloom.operators.scorecard import ground_truth, latest_identity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def hot(spark, n=30_000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def splitting(spark):
    """Adaptive execution that takes small partitions for large ones, and never broadcasts."""
    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    yield
    for key in SPLIT:
        spark.conf.unset(key)


def ran(df) -> str:
    """The final plan of the result as a whole."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_spreads_a_hot_key(spark, splitting, tmp_path):
    """Lookups made by an aggregate, by distinct, or read from a table."""
    big = hot(spark, 90_000).repartition(8)
    summed = big.groupBy("k").agg(F.max("id").alias("v"))
    summed.write.parquet(str(tmp_path / "lookup"))
    for i, lookup in enumerate((summed, big.select("k").distinct().withColumn("v", F.col("k")), spark.read.parquet(str(tmp_path / "lookup")))):
        joined = lookup_join(big, lookup, ["k"])
        joined.write.parquet(str(tmp_path / f"out{i}"))
        parts = spark.read.parquet(str(tmp_path / f"out{i}")).groupBy(F.input_file_name()).count().collect()
        assert max(r["count"] for r in parts) < 15_000  # the hot key has 30,000
        assert "skew=true" in ran(joined)
    assert rows(lookup_join(big, summed, ["k"]).select("id", "v")) == rows(big.join(summed.cache(), "k").select("id", "v"))


def test_callers_of_lookup_join_spread_a_hot_key(spark, splitting):
    text = F.concat(F.lit("Entre 1,5M e 2M "), F.col("id").cast("string"))
    name = F.when(F.col("k") == 0, "h").otherwise(F.col("k").cast("string"))
    many = hot(spark, 90_000).select(name.alias("inst_hash"), name.alias("CNPJ8"), text.alias("faixa_bruta"), "id").repartition(8)
    mapping = many.select("inst_hash", "CNPJ8").distinct().select(
        "inst_hash", F.lit("2024-S1").alias("Semestre_Ref"), F.col("CNPJ8").alias("Ident__CNPJ"),
        F.lit("x").alias("Ident__Razao_Social"), F.lit(2.0).alias("Fator_Escalonamento"),
    )
    assert "skew=true" in ran(deanonymize_range(many, latest_identity(mapping)))
    factors = many.select("inst_hash").distinct().withColumn("fator", F.lit(1.5))
    assert "skew=true" in ran(scale_by_entity(many.withColumn("Contas__Ativo_Total", F.lit(1.0)), factors=factors))
    panel = many.select("CNPJ8", F.lit("2024-S1").alias("Semestre_Ref"), F.lit("202406").alias("YYYYMM"), F.col("id").cast("double").alias("Contas__Lucro_Liquido"))
    assert "skew=true" in ran(ground_truth(many.select("inst_hash", "CNPJ8", "id"), panel, F.lit("2024-S1")))
    filings = many.select(
        F.col("CNPJ8").alias("cnpj_key"), F.lit("122024").alias("base_key"), F.lit("I").alias("submission"),
        F.format_string("%08d", "id").alias("file_name"), F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    assert "skew=true" in ran(dedup_replacement(filings))


def test_dedup_of_a_hot_key(spark):
    filings = hot(spark).select(
        F.col("k").cast("string").alias("cnpj_key"), F.lit("122024").alias("base_key"),
        F.when(F.col("id") == 2997, "S").otherwise("I").alias("submission"), F.format_string("%08d", "id").alias("file_name"),
    )
    kept = dedup_replacement(filings)
    assert kept.count() == filings.select("cnpj_key").distinct().count()
    assert kept.filter("cnpj_key = '0'").first().file_name == "00002997"
    assert rows(kept) == rows(dedup_replacement(filings.repartition(3)))


def test_balance_of_a_hot_institution(spark):
    facts = hot(spark).select(
        F.col("k").cast("string").alias("cnpj"), F.lit("2024-12-31").alias("periodo"), F.lit("BP").alias("bloco"),
        F.lit("IND").alias("escopo"), F.when(F.col("id") % 2 == 0, "1").otherwise("2").alias("nivel"),
        (F.col("id") * 0.01).alias("valor"),
    )
    assert rows(balance_qc(facts)) == rows(balance_qc(facts.repartition(13)))
