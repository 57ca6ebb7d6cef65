import pytest
from oracle import connect, same

from tracelake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_calibration_is_applied_to_every_trace(spark):
    got = catalog.queries()["I2_apply_terms"](spark, SF)
    traces = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert traces > 3 and got.where("re is not null and im is not null").groupBy("trace_id").count().where("count = 32").count() == traces
