import duckdb
import pytest

import __spark_entry__ as entry
import check
from filing_helpers import SF
from ledgerlight.plans import oracle_queries, queries as registered

UNCHECKED = {"ml_anomaly", "ml_clusters", "ml_priority", "ml_summary", "ml_top", "points_ml",
             "freq_ml_priority", "freq_cluster"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_but_the_models_has_a_twin():
    assert set(registered.queries()) - set(oracle_queries.oracle_sql()) == UNCHECKED
    assert set(registered.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle_queries.oracle_sql()))
def test_matches_sql(spark, con, name):
    text, fine = check.compare(spark, con, SF, name, registered.queries()[name],
                               oracle_queries.oracle_sql()[name])
    assert fine, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["sector_indicators", "high_risk", "suspicious_liquidity",
                                  "account_balance_stats", "company_vs_sector",
                                  "benchmark_dynamic", "universal_accounts"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
