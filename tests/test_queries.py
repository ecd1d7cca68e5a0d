import pytest

from pyspark.sql import functions as F

from thriftlens import queries
from thriftlens.operators import registry


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(agrees, name):
    agrees(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["advice_extract", "advice_prompts", "ranked_findings", "report_text", "session_report", "top3_findings"])
def test_a_query_fails_where_a_detector_fails(spark, tables, monkeypatch, name):
    """Not with fewer rows, nor with totals of fewer findings."""
    real = registry.get_detector("heartbeat_waste")
    bad = F.when(F.col("session_id").endswith("0"), F.expr("cast(raise_error('no') as bigint)")).otherwise(F.col("tokens_wasted"))
    monkeypatch.setitem(registry._registry, "heartbeat_waste", lambda t: real(t).withColumn("tokens_wasted", bad))
    with pytest.raises(registry.DetectorError, match="heartbeat_waste"):
        queries.QUERIES[name](spark, tables).collect()
