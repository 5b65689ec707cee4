"""What the physical plans must and must not contain."""

import pytest

from tests.compare import driver

SF = "/root/testdata/sf0.001"
OWN = [name for name in driver.queries() if not name.startswith("op") and name != "pipeline"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", OWN)
def test_no_cross_join_no_row_python(spark, name):
    plan = physical(driver.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups", "Window"):
        assert operator not in plan, operator
    if name != "read_documents":
        assert "Python" not in plan


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("hash_entities", 0),
        ("cell_noise", 0),
        ("pseudonymize_v1", 0),
        ("resolve_period", 0),
        ("parse_filing_names", 0),
        ("balance_qc", 2),  # one of them deals out the orders that documents are made of
        ("entity_factors", 1),
        ("anonymized_panel", 3),  # all of them build the panel itself
        ("audit_mapping", 3),
    ],
)
def test_shuffles(spark, name, shuffles):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        plan = physical(driver.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == shuffles


def test_documents_are_parsed_once_per_purpose(spark):
    """A filter on the status must not bring a second parse with it."""
    plan = driver.queries()["flatten_accounts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(_corrupt_record") == 1
    assert plan.count("from_json(StructField(@cnpj,VariantType") == 1


def test_scans_read_only_what_they_need(spark):
    plan = physical(driver.queries()["cutoff_excluded"](spark, SF))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    plan = physical(driver.queries()["semester_cutoff"](spark, SF).select("CNPJ8", "Contas__Ativo_Total"))
    assert "l_discount" not in plan and "o_totalprice" not in plan


def test_cutoff_reaches_the_orders(spark):
    """The semester filter is applied to orders before they are joined and summed."""
    lines = physical(driver.queries()["anonymized_panel"](spark, SF)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet [o_orderkey" in line)
    assert "Filter" in lines[scan - 1]
