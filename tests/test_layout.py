import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import ledger as L
from ledgerlight.operators.ordering import numbered
from ledgerlight.plans import queries as registered
from ledgerlight.schemas import REGISTRY, VARIATIONS
from ledgerlight.sources import layout
from ledgerlight.sources.orders import RAW, OrderFilings


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def laid_out(table, tmp_path):
    companies = [f"{i:014d}" for i in range(40)]
    registry = table(REGISTRY, [{"cnpj": c, "ano_referencia": 202300 + m, "nm_razao_social": f"n{c}"}
                                for c in companies for m in (6, 12)])
    variations = table(VARIATIONS, [
        {"cnpj": c, "cd_conta": str(k), "ano_referencia": 2023, "variacao_percentual": k,
         "classificacao_variacao": "Variação Extrema", "score_risco_variacao": k % 3}
        for c in companies for k in range(5)])
    saved = [layout.write_by_company(df, f"{n}_{uuid.uuid4().hex}", f"{tmp_path}/{n}", 8)
             for n, df in (("variations", variations), ("registry", registry))]
    yield variations, registry, *saved
    for df in saved:
        for name in {r.tableName for r in df.sparkSession.sql("SHOW TABLES").collect()}:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def test_company_join_needs_no_exchange(no_broadcast, laid_out):
    variations, registry, by_company, registry_by_company = laid_out
    plain = L.variation_anomalies(variations, registry, limit=None)
    found = L.variation_anomalies(by_company, registry_by_company, limit=None)
    assert sorted(map(str, plain.collect())) == sorted(map(str, found.collect())) and found.count() == 400
    # nothing between the scans and the join; the list is sorted after it
    joined = by_company.join(registry_by_company, "cnpj")
    assert "Exchange" in plan(variations.join(registry, "cnpj"))
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)


def test_one_company_reads_one_bucket(spark, laid_out):
    _, _, by_company, _ = laid_out
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64",
                "spark.sql.files.minPartitionNum": "1"}  # a small piece of a file for each task
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        one = by_company.where(F.col("cnpj") == f"{7:014d}")
        sizes = [d.select(F.input_file_name()).rdd.getNumPartitions() for d in (one, by_company)]
        assert one.count() == 5 and sizes[0] * 4 < sizes[1]
        assert by_company.where("cnpj = 'absent'").count() == 0
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_bucket_count():
    assert [layout.bucket_count(n, 10) for n in (0, 1, 10, 11, 20, 21, 1000)] == [1, 1, 1, 2, 2, 4, 128]


def order():
    return [F.desc_nulls_first("a"), F.asc_nulls_last("b")]


def places(rows):
    def key(r):
        return (r[0] is not None, -(r[0] or 0)), (r[1] is None, r[1] or "")
    return sorted(rows, key=key)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_equal_a_sort(spark, parts):
    random.seed(parts)
    rows = [(random.choice([None, 1, 2, 3, 40]), random.choice([None, "x", "y", str(i)])) for i in range(500)]
    rows += [(2, "hot")] * 400  # equal rows take places beside each other
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    found = numbered(df, order(), parts=parts).orderBy("posicao").collect()
    assert [r.posicao for r in found] == list(range(1, len(rows) + 1))
    assert [(r.a, r.b) for r in found] == places(rows)


def test_places_of_no_rows(spark):
    assert numbered(spark.createDataFrame([], "a int, b string"), order()).collect() == []


def test_places_need_no_task_for_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    text = plan(numbered(df, order(), parts=4))
    # the one window without a key runs over a row for each range
    assert text.count("SinglePartition") == 1 and text.index("SinglePartition") > text.index("Window")


def test_memory_of_a_bucket_is_bounded():
    """A task sorts a whole bucket: 24 million rows in 8 of them took gigabytes."""
    assert 24_000_000 / layout.bucket_count(24_000_000) <= 500_000


@pytest.mark.parametrize("build", ["_source_fallback", "_sector_benchmark", "_bucketed_variations"])
def test_lines_are_added_up_once(spark, monkeypatch, tmp_path, build):
    """Not once to see or count and again for each list."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    lines = [(order, 1 + k, 1, k, 1.0, 100.0 + 5000 * (order % 3) + k, 0.1, 0.0, "R" if k else "N", "F", None)
             for order in range(40) for k in range(3)]
    made = {
        "region": [(0, "R")], "nation": [(0, "N", 0)], "part": [(1 + k, "p", "b", "t", 1, 1.0) for k in range(3)],
        "customer": [(c, f"c{c}", 0, 6000.0, "MACHINERY") for c in range(4)],
        "orders": [(o, o % 4, "FOP"[o % 3], 300.0, datetime.datetime(1997 + o % 3, 5, 1), "1-URGENT") for o in range(40)],
        "lineitem": lines,
    }

    class Counted(OrderFilings):
        def raw(self, name):
            rows = spark.createDataFrame(made[name], RAW[name])
            if name == "lineitem":
                rows = rows.withColumn("l_extendedprice", counted.asNondeterministic()("l_extendedprice"))
            return rows

    monkeypatch.setattr(registered.sinks, "shared_folder", lambda _: str(tmp_path))
    try:
        assert getattr(registered, build)(Counted(spark, "")).collect()
    finally:
        for r in spark.sql("SHOW TABLES").collect():
            spark.sql(f"DROP TABLE IF EXISTS {r.tableName}")
    assert seen.value == len(lines)
