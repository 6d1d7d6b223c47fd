import math
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlight.functions import numeric as N, periods, rules as R
from ledgerlight.functions.joins import (
    attach_to_best, best_rows_per, fan_out_left_join, join_group_stats,
)
from ledgerlight.functions.quantiles import exact_quantile

SLOW = settings(max_examples=8, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df, column):
    return [r[column] for r in df.collect()]


def test_period_truncates(spark):
    df = spark.createDataFrame([(202401,), (202412,), (202460,), (0,), (None,)], "p int")
    got = df.select(periods.year_of("p").alias("y"), periods.period_in_year("p", 2024).alias("r"),
                    periods.months_of("p", 2024).alias("m")).collect()
    assert [tuple(r) for r in got] == [
        (2024, True, True), (2024, True, True), (2024, True, False), (0, False, False),
        (None, None, None),
    ]


def test_score_thresholds(spark):
    rows = [(0.5, 0.7, -10.0), (1.0, 0.9, 0.0), (None, 0.8, None), (0.49, 0.91, -10.1),
            (None, None, None)]
    df = spark.createDataFrame(rows, "l double, d double, m double")
    score = R.financial_score(F.col("l"), F.col("d"), F.col("m"))
    got = [tuple(r) for r in df.select(score, R.risk_class(score)).collect()]
    assert got == [(3, "Médio"), (2, "Baixo"), (2, "Baixo"), (9, "Muito Alto"), (0, "Baixo")]


def test_priority(spark):
    rows = [(7.0, "100000000"), (7.0, "99999999.99"), (5.0, "100000000"), (5.0, "1"), (3.0, "1"),
            (2.9, None)]
    df = spark.createDataFrame(rows, "s double, a string").withColumn(
        "a", F.col("a").cast("decimal(18,2)"))
    assert values(df.select(R.audit_priority(F.col("s"), F.col("a")).alias("p")), "p") == [
        1, 2, 2, 3, 4, 5]


def test_ml_bins_are_right_closed(spark):
    scores = [0.0, 0.01, 5.0, 5.01, 8.0, 11.0, 100.0, 100.01, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert values(df.select(R.ml_priority(F.col("s")).alias("p")), "p") == [
        None, "Baixa", "Baixa", "Média", "Média", "Alta", "Crítica", None, None]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(5.0, 0.0), (None, 2.0), (6.0, -2.0)], "a double, b double")
    got = df.select(N.ratio(F.col("a"), F.col("b")), N.deviation_percent(F.col("a"), F.col("b")),
                    N.dispersion_percent(F.lit(1.0), F.lit(3.0), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, 0.0), (None, None, 100.0),
                                       (-3.0, 400.0, 100.0)]


def test_text_to_number(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,), ("",)], "t string")
    assert values(df.select(N.to_number(F.col("t")).alias("n")), "n") == [1.0, 2.5, 0.0, 0.0, 0.0]


@SLOW
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-1, 3), st.floats(-50, 50)), min_size=1,
                max_size=30))
def test_score_range_and_monotony(spark, rows):
    df = spark.createDataFrame(rows, "l double, d double, m double")
    l, d, m = F.col("l"), F.col("d"), F.col("m")
    for r in df.select(R.financial_score(l, d, m), R.financial_score(l - 1, d + 1, m - 1)).collect():
        assert 0 <= r[0] <= r[1] <= 9


@SLOW
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=20))
def test_rescale_stays_in_bounds(spark, rows):
    df = spark.createDataFrame(rows, "v double, m double")
    v, m = F.col("v"), F.col("m")
    low, high = F.least(v, m, F.lit(0.0)), F.greatest(v, m, F.lit(2.0))
    for r in df.select(N.rescale(v, low, high), N.rescale(m, low, high)).collect():
        assert -1e-9 <= r[0] <= 100 + 1e-9 and -1e-9 <= r[1] <= 100 + 1e-9


def brute_quantile(pairs, q):
    flat = sorted(v for v, w in pairs for _ in range(w))
    rank = q * (len(flat) - 1)
    low = math.floor(rank)
    high = min(low + 1, len(flat) - 1)
    return flat[low] + (rank - low) * (flat[high] - flat[low])


def test_exact_quantile_matches_sorting(spark):
    random.seed(1)
    cases = [
        [(random.random(), random.randint(1, 5)) for _ in range(400)],
        [(0.5, 1000)] + [(random.random(), 1) for _ in range(50)],  # one value holds most weight
        [(random.choice([0.1, 0.2, 1e12]), 1) for _ in range(99)],
        [(3.0, 1)],
    ]
    for pairs in cases:
        df = spark.createDataFrame(pairs, "v double, w long")
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            got = exact_quantile(df, "v", "w", q)
            assert math.isclose(got, brute_quantile(pairs, q), rel_tol=1e-12), (q, len(pairs))
    assert exact_quantile(spark.createDataFrame([], "v double, w long"), "v", "w", 0.5) is None


def test_attach_equals_left_join_then_limit(spark):
    random.seed(2)
    rows = [(random.choice(["a", "b", "c", "x", None]), random.randint(0, 6), i)
            for i in range(60)] + [("a", 6, 1), ("a", 6, 1)]
    # "a" holds most of the details, "x" none; null keys match nothing
    details = [("a", i) for i in range(40)] + [("b", 1), ("b", None), ("c", 2), (None, 9)]
    left = spark.createDataFrame(rows, "k string, s int, i int")
    right = spark.createDataFrame(details, "k string, d int")
    order = [F.desc("s"), F.asc("i"), F.asc_nulls_last("k")]
    extra = [F.asc_nulls_last("d")]
    for limit in (1, 7, 50, 500, 5000):
        plain = left.join(right, "k", "left").select(left.k, "s", "i", "d").orderBy(
            *order, *extra).limit(limit)
        got = attach_to_best(left, right, ["k"], order, limit, extra).select("k", "s", "i", "d")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()], limit


def test_attach_runs_the_cut_once(spark):
    left = spark.range(1000).select(F.col("id").cast("string").alias("k"), "id")
    left = left.join(left.groupBy("k").count(), "k")
    right = spark.range(5000).select((F.col("id") % 700).cast("string").alias("k"),
                                     F.col("id").alias("d"))
    df = attach_to_best(left, right, ["k"], [F.desc("id")], 10, [F.asc("d")])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_group_stats_with_a_hot_group(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        "id")
    stats = rows.groupBy("g").agg(F.avg("id").alias("m"))
    got = join_group_stats(rows, stats, ["g"], "id")
    want = rows.join(stats, "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_best_rows_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "g string, v int")
    got = best_rows_per(df, ["g"], [F.desc("v")], 2).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("a", 3), ("b", 9)]


def test_fan_out_join_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", 1), ("hot", 2), ("b", 3), ("none", 4), (None, 5)],
                                 "k string, i int")
    details = spark.range(300).select(
        F.when(F.col("id") < 200, "hot").otherwise("b").alias("k"), F.col("id").alias("d"))
    want = sorted(map(str, rows.join(details, "k", "left").select("k", "i", "d").collect()))
    for part_rows in (1, 30, 150, 100_000):
        got = fan_out_left_join(rows, details, "k", part_rows=part_rows)
        assert sorted(map(str, got.select("k", "i", "d").collect())) == want
    empty = fan_out_left_join(rows, details.where("false"), "k")
    assert empty.count() == 5


def test_fan_out_join_deals_a_key_however_small_its_share(spark):
    rows = spark.range(3).select(F.col("id").alias("k"))
    details = spark.range(50_000).select(
        F.when(F.col("id") < 40, 1).otherwise(F.col("id") + 10).alias("k"), F.col("id").alias("d"))
    joined = fan_out_left_join(rows, details, "k", part_rows=10)
    assert joined.count() == 42
    # the small key's rows arrive in four parts
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_attach_to_best_without_and_with_a_long_limit(spark):
    rows = spark.createDataFrame([(k, v) for v, k in enumerate("abcdabcd")], "k string, v int")
    details = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, d int")
    want = rows.join(details, "k", "left").orderBy(F.desc("v"), "k", "d").collect()
    order = [F.desc("v"), F.asc("k")]
    for limit in (None, 200_000):
        assert attach_to_best(rows, details, ["k"], order, limit, [F.asc("d")]).collect() == want
    short = attach_to_best(rows, details, ["k"], order, 3, [F.asc("d")])
    assert short.collect() == want[:3]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    assert values(df.select(N.is_finite(F.col("v")).alias("f")), "f") == [
        True, False, False, False]


def test_group_cuts_reach_the_map_side(spark):
    from ledgerlight.operators.companies import latest_rows

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("unused"))
    for cut in (latest_rows(df, ["g"], ["id"], []), best_rows_per(df, ["g"], [F.asc("id")], 1000)):
        plan = cut.select("g")._jdf.queryExecution().executedPlan().toString()
        before = plan[plan.index("Exchange hashpartitioning"):]
        assert "WindowGroupLimit" in before


def test_grouped_quantiles_against_numpy(spark):
    import numpy as np

    from ledgerlight.functions.quantiles import grouped_quantiles
    random = np.random.default_rng(2)
    groups = {"a": random.normal(size=5000), "b": np.array([3.0]), "c": np.repeat([1.0, 2.0, 1e300], 700),
              "d": random.integers(-5, 6, 999).astype(float), "e": 1e-12 * random.normal(size=400) + 7}
    rows = [(g, float(v)) for g, some in groups.items() for v in some] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = grouped_quantiles(df, "k", "v", shares)
    assert set(found) == set(groups)
    spark_own = {r[0]: r[1] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares)))).collect()}
    for g, values in groups.items():
        assert np.allclose(found[g], np.quantile(values, shares), rtol=1e-12)
        assert found[g] == list(spark_own[g])
    assert grouped_quantiles(df.where("k = 'none'"), "k", "v", [0.5]) == {}


def test_equal_details_of_a_hot_key_spread_evenly(spark):
    from ledgerlight.functions.joins import dealt_details, fan_out_left_join
    details = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(1).alias("x"))
    details = details.unionByName(spark.createDataFrame([("cold", 2), ("cold", 3), (None, 4)], "k string, x int"))
    parts = {r[0]: r[1] for r in dealt_details(details, ["k"], 1000).where("_hot").groupBy("_part").agg(
        F.sum("_copies")).collect()}
    assert parts == {p: 1000 for p in range(20)}
    rows = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3), (None, 4)], "k string, y int")
    found = fan_out_left_join(rows, details, "k", 1000)
    want = rows.join(details, "k", "left")
    assert found.columns == want.columns
    assert sorted(map(repr, found.groupBy(*found.columns).count().collect())) == sorted(
        map(repr, want.groupBy(*want.columns).count().collect()))


def test_long_lists_are_not_ranked_in_one_task(spark, monkeypatch):
    from ledgerlight.functions import joins
    rows = spark.range(50).select("id", (F.col("id") % 7).alias("k"))
    details = spark.range(30).select((F.col("id") % 5).alias("k"), F.col("id").alias("d"))
    args = (rows, details, ["k"], [F.desc("k"), F.asc("id")], 40, [F.asc("d")])
    short = joins.attach_to_best(*args).collect()
    monkeypatch.setattr(joins, "SHORT", 10)
    long = joins.attach_to_best(*args)
    assert [tuple(r) for r in long.select(*short[0].asDict()).collect()] == [tuple(r) for r in short]
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
