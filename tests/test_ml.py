import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlight.operators import boxes, forest, ml, model_store
from ledgerlight.plans import queries as registered


def company_rows(spark, n=300, outliers=5, copies=0):
    random.seed(7)
    rows = [(f"{i:014d}", 2024, 202412, *[random.gauss(5, 1) for _ in ml.FEATURES])
            for i in range(n)]
    rows += [(f"{n + i:014d}", 2024, 202412, *[40.0 + i] * len(ml.FEATURES))
             for i in range(outliers)]
    rows += [(f"{9000 + i:014d}", 2024, 202412, *[5.0] * len(ml.FEATURES)) for i in range(copies)]
    columns = ", ".join(f"{c} double" for c in ml.FEATURES)
    return spark.createDataFrame(
        rows, f"cnpj string, ano_referencia int, periodo_cadastro int, {columns}"
    ).withColumns({c: F.lit("x") for c in ("nm_razao_social", "setor", "cd_uf")})


@pytest.fixture(scope="module")
def rows(spark):
    return company_rows(spark).cache()


@pytest.fixture(scope="module")
def model(rows):
    return ml.fit_priority_model(rows)


def test_planted_outliers_rank_first(rows, model):
    top = model.anomalies.label(rows).orderBy(F.desc("score_anomalia")).limit(5).collect()
    assert {int(r.cnpj) for r in top} == {300, 301, 302, 303, 304}


def test_share_of_anomalies(rows, model):
    share = model.anomalies.label(rows).where("anomalia = -1").count() / 305
    assert 0.08 <= share <= 0.1 + 1 / 305


def test_same_labels_after_repartition(rows, model):
    again = ml.fit_anomaly_model(rows.repartition(7, F.rand(3)))
    assert again.cut == model.anomalies.cut
    first = model.anomalies.label(rows).select("cnpj", "score_anomalia", "anomalia")
    second = again.label(rows).select("cnpj", "score_anomalia", "anomalia")
    assert first.exceptAll(second).isEmpty()


def test_many_equal_rows_stay_in_the_sample(spark):
    """A third of the rows are one point; its weight keeps it in the trees and it is normal."""
    rows = company_rows(spark, n=2000, outliers=5, copies=1000)
    labelled = ml.fit_anomaly_model(rows).label(rows)
    copies = labelled.where("cnpj >= '00000000009000' and anomalia = -1").count()
    assert copies == 0
    outliers = labelled.where("cnpj >= '00000000002000' and cnpj < '00000000009000'")
    assert outliers.where("anomalia = -1").count() == 5


def test_copies_follow_the_binomial():
    u = (np.arange(200_000) + 0.5) / 200_000
    copies = forest._copies(u, np.full(len(u), 50), 0.1)
    assert abs(copies.mean() - 5) < 0.01 and abs(copies.var() - 4.5) < 0.02
    assert (forest._copies(u[:5], np.full(5, 3), 1.0) == 3).all()
    assert forest._copies(np.array([0.999999999]), np.array([1]), 0.5)[0] == 1


def test_mean_depth():
    got = forest._mean_depth([1, 2, 256])
    assert got[0] == 0 and got[1] == 1 and abs(got[2] - 10.244) < 1e-3


def test_scaled_features(rows):
    scaled = ml.ml_scaled(rows)
    for c in ml.SCALED:
        mean, deviation = scaled.agg(F.avg(c), F.stddev_pop(c)).first()
        assert abs(mean) < 1e-9 and abs(deviation - 1) < 1e-9
    flat = ml.ml_scaled(rows.withColumn("liquidez", F.lit(2.0)))
    assert flat.where("liquidez_padronizado != 0").isEmpty()


def test_clusters_are_no_worse_than_single_runs(rows):
    with ml._training_points(rows) as (points, scaler, _):
        centres = ml.fit_clusters(points, scaler, "peso")
        vectors = VectorAssembler(inputCols=ml.SCALED, outputCol="features").transform(
            points.select(*scaler.columns())).cache()
        x = np.array([r.features.toArray() for r in vectors.collect()])
        cost = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2).min(1).sum()
        for seed in (42, 43, 44):
            single = KMeans(k=4, seed=seed, maxIter=100).fit(vectors).summary.trainingCost
            assert cost <= single * (1 + 1e-6) + 1e-6
        vectors.unpersist()


def test_clusters_do_not_follow_the_partitioning(spark, rows):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffle in ((1, 1), (3, 2), (7, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
            model = ml.fit_cluster_model(rows.repartition(parts))
            found.append([tuple(r) for r in model.label(rows).select(
                "cnpj", "ano_referencia", "cluster").orderBy("cnpj", "ano_referencia").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_fewer_points_than_clusters(rows):
    flat = rows.select(*[F.lit(1.0).alias(c) if c in ml.FEATURES else F.col(c) for c in rows.columns])
    model = ml.fit_cluster_model(flat)
    assert model.label(flat).select("cluster").distinct().count() == 1


def test_priorities(rows, model):
    got = ml.prioritise(rows, model)
    wrong = got.where(
        (F.col("score_ml_total") != F.col("score_risco_total") + F.col("score_ml_anomalia"))
        | ~F.col("score_ml_anomalia").isin(0, 5) | ~F.col("cluster_ml").between(0, 3))
    assert wrong.isEmpty() and got.count() == 305
    summary = ml.ml_summary(got).first()
    assert summary.clusters <= 4 and summary.anomalias >= 5
    assert ml.ml_top(got).count() == 50


def test_missing_feature_gets_the_defaults(rows, model):
    holes = rows.limit(3).withColumn("liquidez", F.lit(None).cast("double"))
    for r in ml.prioritise(holes, model).collect():
        assert (r.score_ml_anomalia, r.cluster_ml) == (0, -1)
    assert ml.ml_features(holes).isEmpty()


def test_too_few_rows(rows):
    with pytest.raises(ml.NotEnoughRows):
        ml.fit_priority_model(rows.limit(9))


def _plain_total(x):
    """Sums over points in memory, as a pass returns them."""
    def total(centres, over=None, masked=None, settled=None):
        best, far = ml._nearest(centres, x)
        counted = np.ones(best.shape, bool)
        if masked is not None:
            counted = over.near[masked]
        elif settled is not None:
            counted = ml._margin(centres, x) > settled
        runs, k, dims = centres.shape
        weights, held = np.zeros((runs, k)), np.zeros((runs, k, dims))
        for r in range(runs):
            for c in range(k):
                own = counted[r] & (best[r] == c)
                weights[r, c], held[r, c] = own.sum(), x[own].sum(0)
        return weights, held, (far * counted).sum(1)
    return total


class _Open:
    def __init__(self, near):
        self.near = near

    def persist(self, level):
        return self

    def unpersist(self):
        return self


def test_settled_points_change_nothing():
    random = np.random.default_rng(3)
    x = np.concatenate([random.normal(m, 1.0, (300, 3)) for m in (0, 2, 5)])
    read = []

    def open_points(centres, margin):
        near = ml._margin(centres, x) <= margin
        read.append(near.any(0).mean())
        return _Open(near)

    starts = x[random.integers(0, len(x), (4, 4))]
    found = ml.settle(starts, _plain_total(x), open_points)
    for start, end in zip(starts, found):
        here = start
        while True:
            best = ((x[:, None] - here[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([np.round(x[best == c].mean(0), 9) if (best == c).any() else here[c] for c in range(4)])
            if np.allclose(moved, here, atol=1e-9):
                break
            here = moved
        assert np.allclose(here, end, atol=1e-8)
    assert len(read) > 1 and min(read) < 0.5  # later phases leave most points unread


def test_alternating_sums_end():
    calls = []

    def total(centres, over=None, masked=None, settled=None):
        calls.append(1)
        assert len(calls) < 100
        side = 1.0 if len(calls) % 2 else 2.0
        return np.ones(centres.shape[:2]), np.full(centres.shape, side), np.zeros(len(centres))

    ml.settle(np.zeros((2, 3, 2)), total, lambda centres, margin: _Open(None))


def test_boxes_score_as_the_forest(spark, rows, model):
    fitted = model.anomalies.forest
    found = boxes.leaf_boxes(spark, fitted, ml.FEATURES)
    assert found.count() <= 25_600
    odd = rows.unionByName(rows.limit(3)).unionByName(rows.limit(1).withColumn("liquidez", F.lit(None).cast("double")))
    odd = odd.unionByName(rows.limit(1).withColumn("liquidez", F.lit(float("nan")))).unionByName(
        rows.limit(1).withColumn("receita_milhoes", F.lit(float("-inf"))))
    key = ["cnpj", *ml.FEATURES]
    want = model.anomalies.label(odd).select(*key, "score_anomalia").collect()
    got = boxes.score_by_boxes(odd.select(*key), found, ml.FEATURES, len(fitted.feature)).collect()
    assert len(got) == len(want) == 311

    def listed(scored):
        return sorted((str(tuple(r)[:-1]), r.score_anomalia) for r in scored)

    for (a, x), (b, y) in zip(listed(want), listed(got)):
        assert a == b and (x is y is None or x == pytest.approx(y, abs=1e-9))


def test_boxes_part_the_space(spark, model):
    """Every point stands in one box of each tree, also where splits lie outside a node's own box."""
    fitted = model.anomalies.forest
    rng = np.random.default_rng(5)
    points = rng.normal(5, 20, (40, len(ml.FEATURES)))
    rows = [r.asDict() for r in boxes.leaf_boxes(spark, fitted, ml.FEATURES).where("tree < 5").collect()]
    for x in points:
        inside = [b["tree"] for b in rows if all(
            (b[f"low_{c}"] is None or v >= b[f"low_{c}"]) and (b[f"high_{c}"] is None or v < b[f"high_{c}"])
            for c, v in zip(ml.FEATURES, x))]
        assert sorted(inside) == [0, 1, 2, 3, 4]


def test_saved_models_come_back_whole(spark, rows, model, tmp_path):
    folder = str(tmp_path / "models")
    model_store.save_model(spark, model, folder, 3)
    again = model_store.load_model(spark, folder, 3)
    first, second = (ml.prioritise(rows, m) for m in (model, again))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
    assert again.anomalies.cut == model.anomalies.cut
    labelled = [m.anomalies.label(rows).select("cnpj", "score_anomalia") for m in (model, again)]
    assert labelled[0].exceptAll(labelled[1]).isEmpty()
    with pytest.raises(Exception):  # a version is written once
        model_store.save_model(spark, model, folder, 3)
    with pytest.raises(Exception):
        model_store.load_model(spark, folder, 4)


def test_tasks_of_a_pass_follow_the_points():
    assert [ml.pass_tasks(n, 12) for n in (0, 1, 4_000, 22_366, 1_000_000, 8_000_000)] == [1, 1, 1, 6, 12, 40]


def test_passes_are_dealt_by_the_points(spark, rows, monkeypatch):
    """Not by the shuffle partitions: a pass over a few points is one task."""
    found, passes = [], ml._passes

    def noted(points, dims):
        found.append(points.rdd.getNumPartitions())
        return passes(points, dims)

    monkeypatch.setattr(ml, "_passes", noted)
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        ml.fit_cluster_model(rows)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == [1]


def test_equal_rows_walk_the_trees_once():
    walked = []

    class Counting(forest.Forest):
        def score_array(self, x):
            walked.append(len(x))
            return super().score_array(x)

    given = registered.given_forest()
    counting = Counting(*(getattr(given, name) for name in given.__dataclass_fields__))
    x = np.random.default_rng(2).normal(2, 5, (50, len(ml.FEATURES)))
    x[3, 2], x[4, 5] = np.nan, -np.inf
    repeated = np.repeat(x, 7, axis=0)
    assert (counting.score_distinct(repeated) == given.score_array(repeated)).all() and walked == [50]
    assert len(counting.score_distinct(x[:0])) == 0


@pytest.mark.parametrize("build", ["_prioritised", "_cluster_labels", "_ml_anomaly", "_ml_clusters", "_ml_scaled"])
def test_rows_of_a_model_are_computed_once(spark, rows, monkeypatch, tmp_path, build):
    """Not for the fit and then for the labels again: below the rows lie joins of all order tables."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    computed = rows.withColumn("liquidez", counted.asNondeterministic()("liquidez"))
    monkeypatch.setattr(registered, "_ml_rows", lambda t: computed)
    monkeypatch.setattr(registered.sinks, "shared_folder", lambda _: str(tmp_path))
    assert len(getattr(registered, build)(SimpleNamespace()).collect()) == 305
    assert seen.value == 305
