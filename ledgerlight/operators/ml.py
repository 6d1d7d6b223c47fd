"""Anomaly detection, clustering and the combined audit priority."""

import sys
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import rules as R
from ledgerlight.functions.joins import best_rows
from ledgerlight.functions.quantiles import exact_quantile
from ledgerlight.operators.forest import Forest, fit_forest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have it

FEATURES = ["score_risco_total", "score_equacao_contabil", "score_neaf", "ativo_milhoes",
            "receita_milhoes", "liquidez", "endividamento", "margem_liquida"]
MIN_ROWS = 10
CONTAMINATION = 0.1
CLUSTERS = 4
STARTS = 10
SEED = 42


class NotEnoughRows(ValueError):
    """Fewer complete rows than a model can be trained on."""


def ml_features(rows: DataFrame) -> DataFrame:
    """Rows with all eight features, keyed by company, year and registry period."""
    return rows.select("cnpj", "ano_referencia", "periodo_cadastro", *FEATURES).dropna(
        subset=FEATURES
    )


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations; a constant feature is only centred."""

    mean: Sequence[float]
    deviation: Sequence[float]

    def columns(self) -> list[Column]:
        return [
            ((F.col(c).cast("double") - m) / (d or 1.0)).alias(f"{c}_padronizado")
            for c, m, d in zip(FEATURES, self.mean, self.deviation)
        ]


SCALED = [f"{c}_padronizado" for c in FEATURES]


def fit_scaler(points: DataFrame, weight: str) -> tuple[Scaler, int, int]:
    """Scaler, row count and point count of points that stand for ``weight`` rows each."""
    w = F.col(weight)
    first = points.agg(
        F.sum(w).alias("n"), F.count("*").alias("points"),
        *[F.sum(F.col(c) * w).alias(c) for c in FEATURES],
    ).first()
    n = first.n or 0
    if n < MIN_ROWS:
        raise NotEnoughRows(f"{n} complete rows, at least {MIN_ROWS} needed")
    mean = [first[c] / n for c in FEATURES]
    second = points.agg(
        *[F.sum(F.pow(F.col(c) - m, F.lit(2.0)) * w).alias(c) for c, m in zip(FEATURES, mean)]
    ).first()
    return Scaler(mean, [(second[c] / n) ** 0.5 for c in FEATURES]), n, first.points


def _nearest(centres: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every point for every run, and the squared distance to it."""
    far = ((x[None, :, None, :] - centres[:, None, :, :]) ** 2).sum(-1)
    best = far.argmin(-1)
    return best, np.take_along_axis(far, best[..., None], -1)[..., 0]


#: Points that a task of a pass has at least, and that it may have before there are more tasks than cores.
TASK_POINTS = 4_000
FULL_TASK_POINTS = 200_000


def pass_tasks(points: int, cores: int) -> int:
    """Tasks of one pass. Starting a task takes longer than reading a few thousand points, and every
    task of every pass reports to the driver, so their number follows the points alone."""
    return max(1, -(-points // FULL_TASK_POINTS), min(cores, -(-points // TASK_POINTS)))


def _passes(points: DataFrame, dims: int):
    """Two passes over (v0, v1, ..., weight, key): draw a start, and sum up by nearest centre.

    Both handle all runs at once, reduce inside each task and return a few rows a task. A pass is
    one stage: the driver adds up what the tasks return, in the order of the partitions.
    """
    start = ", ".join(f"v{d} double" for d in range(dims))

    def columns(batch):
        x = np.column_stack([batch.column(d).to_numpy() for d in range(dims)])
        return x, batch.column(dims).to_numpy(), batch.column(dims + 1).to_numpy().view(np.uint64)

    def draw(centres: np.ndarray | None, runs: int, seed: int):
        """For each run the point first in a race, won with odds of weight times squared distance
        to the centres so far. A point's luck is a hash of it, the run and the step."""
        step = 0 if centres is None else centres.shape[1]

        def run(batches):
            for batch in batches:
                x, weight, key = columns(batch)
                if not len(x):
                    continue
                far = np.ones((runs, len(x))) if centres is None else _nearest(centres, x)[1]
                rows = []
                for r in range(runs):
                    luck = key ^ np.uint64((seed * 1_000_003 + r * 1_009 + step + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        luck = (luck ^ (luck >> np.uint64(shift))) * np.uint64(factor)
                    luck = ((luck >> np.uint64(11)).astype(float) + 0.5) / 2**53
                    with np.errstate(divide="ignore"):
                        time = -np.log(luck) / (weight * far[r])
                    k = np.lexsort((key, time))[0]
                    rows.append((r, float(time[k]), int(key[k].view(np.int64)), *map(float, x[k])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)],
                    ["run", "time", "key", *(f"v{d}" for d in range(dims))])

        rows = points.mapInArrow(run, f"run long, time double, key long, {start}").groupBy("run").agg(
            F.min(F.struct("time", "key", *[f"v{d}" for d in range(dims)])).alias("best")).collect()
        found = {r.run: [r.best[f"v{d}"] for d in range(dims)] for r in rows}
        new = np.array([found[r] for r in range(runs)])[:, None, :]
        return new if centres is None else np.concatenate([centres, new], 1)

    def total(centres: np.ndarray, over: DataFrame = points, masked=None, settled: float | None = None):
        """Weights and coordinate sums of each run's clusters, and each run's cost.

        ``over`` may hold some of the points with a mask of the runs they are open in; only those
        count. With ``settled``, only points with a greater margin count (see ``open_points``).
        """
        runs, k, _ = centres.shape

        def run(batches):
            weights, held, cost = np.zeros((runs, k)), np.zeros((runs, k, dims)), np.zeros((runs, k))
            for batch in batches:
                x, weight, _ = columns(batch)
                if not len(x):
                    continue
                best, far = _nearest(centres, x)
                counted = np.ones((runs, len(x)), bool)
                if masked is not None:
                    mask = batch.column(dims + 2).to_numpy()
                    counted = np.array([(mask >> r & 1).astype(bool) for r in masked])
                elif settled is not None:
                    counted = _margin(centres, x) > settled
                for r in range(runs):
                    w = weight * counted[r]
                    weights[r] += np.bincount(best[r], w, k)
                    cost[r] += np.bincount(best[r], w * far[r], k)
                    for d in range(dims):
                        held[r, :, d] += np.bincount(best[r], w * x[:, d], k)
            flat = np.concatenate([weights.ravel(), cost.ravel(), held.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["sums"])

        flat = np.zeros(runs * k * (dims + 2))
        for row in over.mapInArrow(run, "sums array<double>").collect():
            flat += row.sums
        weights, cost, held = np.split(flat, [runs * k, 2 * runs * k])
        weights, cost, held = weights.reshape(runs, k), cost.reshape(runs, k).sum(1), held.reshape(runs, k, dims)
        return weights, held, cost

    def open_points(centres: np.ndarray, margin: float):
        """The points whose two nearest centres differ by no more than ``margin`` in some run, with
        a bit for each such run."""
        def run(batches):
            for batch in batches:
                x, _, _ = columns(batch)
                if not len(x):
                    continue
                near = _margin(centres, x) <= margin
                mask = (near.astype(np.int64) << np.arange(len(centres))[:, None]).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(mask)], [*batch.schema.names, "mask"]).filter(pa.array(mask != 0))

        return points.mapInArrow(run, f"{start}, weight double, key long, mask long")

    return draw, total, open_points


def _margin(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every run and point, how much nearer the nearest centre is than the next."""
    if centres.shape[1] < 2:
        return np.full((len(centres), len(x)), np.inf)
    far = np.sqrt(((x[None, :, None, :] - centres[:, None, :, :]) ** 2).sum(-1))
    two = np.partition(far, 1, axis=-1)
    return two[..., 1] - two[..., 0]


#: How many times the last movement of the centres a phase of ``settle`` allows for.
SLACK = 4.0
#: How many times slower the centres must have become for a new phase before that is used up.
SLOWER = 8.0


def settle(centres: np.ndarray, total, open_points) -> np.ndarray:
    """Moves each run's centres to the means of their points until that changes nothing.

    A run also ends when it comes back to centres it had before: rounded means can alternate. A
    point is settled while the centres have moved less than half the margin between its two
    nearest; settled points are summed up once, and passes read the open ones until some run has
    moved further than the phase allows, or all move much less. Then the next phase begins with all
    points, of which ever fewer are open as the centres slow down.
    """
    centres = centres.copy()
    active = list(range(len(centres)))
    seen = [{run.tobytes()} for run in centres]
    allowed, moved_by, over, fixed = 0.0, None, None, None
    try:
        while active:
            here = centres[active]
            if over is None:
                weights, held, _ = total(here)
            else:
                weights, held, _ = total(here, over, [phase.index(r) for r in active])
                at = [phase.index(r) for r in active]
                weights, held = weights + fixed[0][at], held + fixed[1][at]
            full = weights > 0  # a cluster without points stays where it is
            moved = np.where(full[..., None], held / np.where(full, weights, 1)[..., None], here)
            moved = np.round(moved, 9) + 0.0
            step = np.sqrt(((moved - here) ** 2).sum(-1)).max(-1)
            still = []
            for r, new, far in zip(active, moved, step):
                if moved_by is not None:
                    moved_by[r] += far
                centres[r] = new
                if new.tobytes() not in seen[r]:
                    seen[r].add(new.tobytes())
                    still.append(r)
            active = still
            if not active:
                break
            slack = SLACK * float(step.max())
            if over is None or max(moved_by[r] for r in active) > allowed or slack * SLOWER < allowed:
                if over is not None:
                    over.unpersist()
                phase, allowed = list(active), slack
                moved_by = dict.fromkeys(phase, 0.0)
                margin = 2 * allowed + 1e-6  # well above the last bits of a distance
                over = open_points(centres[phase], margin).persist(StorageLevel.MEMORY_AND_DISK)
                fixed = total(centres[phase], settled=margin)[:2]
    finally:
        if over is not None:
            over.unpersist()
    return centres


def fit_clusters(points: DataFrame, scaler: Scaler, weight: str, k: int = CLUSTERS,
                 starts: int = STARTS, seed: int = SEED) -> list[list[float]]:
    """Centres of the cheapest of several k-means runs, in ascending order.

    All runs share every pass over the points, and go on until no centre moves (``settle``). Starts
    are drawn by hashes of the points, and centres are rounded to nine digits, far coarser than the
    last bits of a sum that depend on its order: how the points are dealt to tasks does not matter.
    """
    names = [f"v{d}" for d in range(len(FEATURES))]
    scaled = points.select(*[F.round(c, 9).alias(n) for c, n in zip(scaler.columns(), names)],
                           F.col(weight).cast("double").alias("weight"))
    parts = pass_tasks(points.count(), points.sparkSession.sparkContext.defaultParallelism)
    scaled = scaled.withColumn("key", F.xxhash64(*names)).repartition(parts, "key")
    scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    draw, total, open_points = _passes(scaled, len(names))
    try:
        centres = None
        for _ in range(k):
            centres = draw(centres, starts, seed)
        centres = settle(centres, total, open_points)
        _, _, cost = total(centres)
    finally:
        scaled.unpersist()
    return min((round(float(c), 6), sorted(run.tolist())) for c, run in zip(cost, centres))[1]


def _complete() -> Column:
    """True where no feature is missing."""
    return F.forall(F.array(*[F.col(c).isNotNull() for c in FEATURES]), lambda known: known)


@dataclass(frozen=True)
class AnomalyModel:
    """Works on the features as they are: random splits between a feature's extremes do not
    change with its scale, and unscaled values carry no rounding from the scaler's sums."""

    forest: Forest
    cut: float

    def label(self, rows: DataFrame) -> DataFrame:
        """Add ``score_anomalia`` and ``anomalia`` (-1 or 1); null where a feature is missing.

        Each row is labelled on its own, with no join back.
        """
        score = F.when(_complete(), self.forest.score(FEATURES))
        return rows.withColumn("score_anomalia", score).withColumn(
            "anomalia",
            F.when(F.col("score_anomalia") > self.cut, -1)
            .when(F.col("score_anomalia").isNotNull(), 1),
        )


@dataclass(frozen=True)
class ClusterModel:
    scaler: Scaler
    centres: list[list[float]]

    def label(self, rows: DataFrame) -> DataFrame:
        """Add ``cluster``, the nearest centre; null where a feature is missing."""
        distances = F.array(*[
            sum((F.pow(F.col(c) - x, F.lit(2.0)) for c, x in zip(SCALED, centre)), F.lit(0.0))
            for centre in self.centres
        ])
        nearest = F.array_position("_distances", F.array_min("_distances")) - 1
        return (
            rows.select("*", *self.scaler.columns())
            .withColumn("_distances", distances)
            .withColumn("cluster", F.when(_complete(), nearest.cast("int")))
            .drop(*SCALED, "_distances")
        )


@contextmanager
def _training_points(rows: DataFrame):
    """Distinct feature rows with the number of rows they stand for, their scaler and the count.

    The registry join repeats a company's figures once per period, so training on distinct
    points with weights gives the same models from far fewer rows, however many copies there are.
    """
    points = ml_features(rows).select(
        *[F.col(c).cast("double").alias(c) for c in FEATURES]
    ).groupBy(*FEATURES).agg(F.count("*").alias("peso")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scaler, n, _ = fit_scaler(points, "peso")
        yield points, scaler, n
    finally:
        points.unpersist()


def _fit_anomaly(points: DataFrame, n: int, seed: int, contamination: float) -> AnomalyModel:
    forest = fit_forest(points, FEATURES, "peso", n, seed=seed)
    scored = points.select(forest.score(FEATURES).alias("s"), "peso").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        cut = exact_quantile(scored, "s", "peso", 1 - contamination)
    finally:
        scored.unpersist()
    return AnomalyModel(forest, cut)


def fit_anomaly_model(rows: DataFrame, seed: int = SEED,
                      contamination: float = CONTAMINATION) -> AnomalyModel:
    with _training_points(rows) as (points, _, n):
        return _fit_anomaly(points, n, seed, contamination)


def fit_cluster_model(rows: DataFrame, seed: int = SEED) -> "ClusterModel":
    with _training_points(rows) as (points, scaler, _):
        return ClusterModel(scaler, fit_clusters(points, scaler, "peso", seed=seed))


def fit_priority_model(rows: DataFrame, seed: int = SEED,
                       contamination: float = CONTAMINATION) -> "PriorityModel":
    """Both models from one set of training points."""
    with _training_points(rows) as (points, scaler, n):
        return PriorityModel(
            _fit_anomaly(points, n, seed, contamination),
            ClusterModel(scaler, fit_clusters(points, scaler, "peso", seed=seed)),
        )


@dataclass(frozen=True)
class PriorityModel:
    anomalies: AnomalyModel
    clusters: ClusterModel

    def label(self, rows: DataFrame) -> DataFrame:
        return self.clusters.label(self.anomalies.label(rows))


def ml_scaled(rows: DataFrame) -> DataFrame:
    """Standardised features of every complete row."""
    with _training_points(rows) as (_, scaler, _n):
        return ml_features(rows).select(
            "cnpj", "ano_referencia", "periodo_cadastro", *scaler.columns()
        )


def prioritise(rows: DataFrame, model: PriorityModel) -> DataFrame:
    """Combined score and priority: five points for an anomaly plus the risk score.

    Rows with a missing feature get no anomaly points and cluster -1. The cluster is stored and
    adds nothing.
    """
    points = F.when(F.col("anomalia") == -1, 5).otherwise(0)
    return (
        model.label(rows)
        .withColumn("score_ml_anomalia", points)
        .withColumn("cluster_ml", F.coalesce("cluster", F.lit(-1)))
        .withColumn("score_ml_total", F.col("score_ml_anomalia") + F.col("score_risco_total"))
        .withColumn("prioridade_ml", R.ml_priority(F.col("score_ml_total")))
        .drop("score_anomalia", "anomalia", "cluster")
    )


def ml_summary(prioritised: DataFrame) -> DataFrame:
    return prioritised.agg(
        F.count_if(F.col("score_ml_anomalia") == 5).alias("anomalias"),
        F.count_if(F.col("prioridade_ml") == "Crítica").alias("criticas"),
        F.count_if(F.col("prioridade_ml") == "Alta").alias("altas"),
        F.countDistinct(F.when(F.col("cluster_ml") >= 0, F.col("cluster_ml"))).alias("clusters"),
    )


def ml_top(prioritised: DataFrame, limit: int = 50) -> DataFrame:
    score = F.coalesce(F.col("score_ml_total").cast("double"), F.lit(0.0))
    order = [F.desc("score_ml_total"), F.asc("cnpj"), F.asc("ano_referencia"),
             F.asc_nulls_last("periodo_cadastro")]
    return best_rows(prioritised.withColumn("score_ml_total", score), order, limit).select(
        "cnpj", "nm_razao_social", "setor", "cd_uf", "score_ml_total", "prioridade_ml",
        "score_risco_total", "ativo_milhoes", "receita_milhoes", "liquidez", "endividamento",
    )


def ml_points(prioritised: DataFrame) -> DataFrame:
    return prioritised.select("cnpj", "nm_razao_social", "setor", "cd_uf", "ativo_milhoes",
                              "score_risco_total", "score_ml_total", "prioridade_ml")
