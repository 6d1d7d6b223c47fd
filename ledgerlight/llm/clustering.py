"""K-means over integer vectors, each assignment a tournament of bisectors.

For two centroids c < d, a vector x is nearer to d exactly when 2 (d - c) . x > |d|^2 - |c|^2: a
linear test with an integer normal and threshold, which are computed once a round for every pair.
A vector keeps a champion, the first centroid to begin with; each next centroid in turn meets the
champion, and one sign test eliminates one of them. Zero favours the smaller number, which is the
champion's. So k - 1 tests find the nearest centroid with ties to the smaller number, and only its
distance is computed, exactly, at the end.

Tests run on whole batches, on doubles where every number stays far below 2^53, else on Python's
integers: components of any size are exact. A round is one pass that sums up inside each task; the
driver receives one number for each centroid, component and 32 bits of the sum.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import arrow_map, written

WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
#: Components up to this keep a test of ``WIDTH`` products below 2^53.
SMALL = 1 << 20
_LIMB = 32
_LONG = 1 << 63


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as integral doubles where those are small, else as Python integers.

    ``scale`` is a power of two, so products of doubles are exact.
    """
    if not x.size or np.abs(x).max() * scale <= SMALL:
        return np.floor(x * scale)
    bits = scale.bit_length() - 1
    exact = [[int(v) << bits if abs(v) >= 1 << 53 else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(exact, dtype=object)


class Bisectors:
    """Normals and thresholds of all pairs of centroids; a centroid is a tuple of integers."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.small = max((abs(v) for c in centroids for v in c), default=0) <= SMALL
        width = len(centroids[0]) if centroids else 0
        self.exact = np.array(centroids, dtype=object).reshape(len(centroids), width)
        self.pairs = {}

    def _of(self, x):
        """The vectors, centroids, normals and thresholds in one kind of number that is exact."""
        kind = float if self.small and x.dtype != object else object
        if kind not in self.pairs:
            at = self.exact.astype(kind)
            norms = (at * at).sum(1)
            self.pairs[kind] = at, 2 * (at[None, :, :] - at[:, None, :]), norms[None, :] - norms[:, None]
        if kind is object and x.dtype != object:
            x = np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)
        return x, *self.pairs[kind]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        x, _, normal, threshold = self._of(x)
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.exact)):
            side = (x * normal[champion, rival]).sum(1) - threshold[champion, rival]
            champion[(side > 0).astype(bool)] = rival
        return champion

    def distance(self, x: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        x, at, _, _ = self._of(x)
        apart = x - at[nearest]
        return (apart * apart).sum(1)


def _vectors(batch, scale):
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, WIDTH)), scale)


def _limbs(number: int):
    """Parts of a number, 32 bits each, with its sign."""
    sign, number, k = (-1 if number < 0 else 1), abs(number), 0
    while number:
        yield k, sign * (number & ((1 << _LIMB) - 1))
        number, k = number >> _LIMB, k + 1


def _sums(centroids, scale):
    """cluster, at, limb, value: the task's sums by component; its counts at -1."""
    def run(batches):
        bisectors, total, counts = Bisectors(centroids), {}, np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _vectors(batch, scale)
            if not len(x):
                continue
            best = bisectors.nearest(x)
            for c in np.unique(best):
                held = x[best == c]
                counts[c] += len(held)
                some = [int(v) for v in held.sum(0)]
                total[c] = [a + b for a, b in zip(total[c], some)] if c in total else some
        rows = [(int(c), at, k, part) for c, some in total.items()
                for at, number in [(-1, int(counts[c])), *enumerate(some)] for k, part in _limbs(number)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())],
            ["cluster", "at", "limb", "value"])
    return run


def _assigned(centroids, scale):
    def run(batches):
        bisectors = Bisectors(centroids)
        for batch in batches:
            x = _vectors(batch, scale)
            if not len(x):
                continue
            best = bisectors.nearest(x)
            far = [int(d) for d in bisectors.distance(x, best)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()),
                 pa.array([d if d < _LONG else None for d in far], pa.int64())], ["doc_id", "cluster", "distance"])
    return run


def kept(vectors: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """vec_id and x, as doubles, of the vectors of that width with finite components alone."""
    wide = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(wide) == width) & F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("x"), usable.alias("usable"))
    return rows.where("usable").select("vec_id", "x")


def moved(rows: DataFrame, centroids: list[tuple[int, ...]], scale: int) -> list[tuple[int, ...]]:
    """Centroids at the floored means of their vectors; one without vectors stays."""
    parts = arrow_map(rows, _sums(centroids, scale), "cluster int, at int, limb int, value long")
    sums = {}
    for cluster, at, limb, value in parts.groupBy("cluster", "at", "limb").agg(F.sum("value")).collect():
        sums[cluster, at] = sums.get((cluster, at), 0) + (value << _LIMB * limb)
    return [c if (k, -1) not in sums else
            tuple(sums.get((k, at), 0) // sums[k, -1] for at in range(len(c))) for k, c in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
            width: int = WIDTH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Kept are vectors of ``width`` components, none null or not finite; others have no row. The first
    ``k`` by a digest of seed and id are the centroids to begin with, equal digests by vector; fewer
    vectors give fewer centroids. Repeated ids and rows each keep their row and may each be a
    centroid; rows without an id take part and come last as centroids. A distance or inertia beyond
    64 bits is null, what belongs to which centroid is exact at any size. No kept vector gives an
    empty result. Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, vec_id, vector, width)
    luck = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.withColumn("luck", luck).orderBy(F.asc_nulls_last("luck"), "vec_id", "x").limit(k).collect()
    centroids = [tuple(int(v) for v in integers(np.array([r.x]), scale)[0]) for r in start]
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    found = written(arrow_map(rows, _assigned(centroids, scale), "doc_id *, cluster int, distance long"), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = {r[0]: None if r[2] else int(r[1]) for r in found.groupBy("cluster").agg(
        wide, F.count_if(F.col("distance").isNull())).collect()}  # k rows
    whole = None if None in by.values() else sum(by.values())
    small = [(c, _fitting(by[c]), _fitting(whole),
              hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(by)]
    about = spark.createDataFrame(small, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(  # k rows
        F.col("doc_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _fitting(number: int | None) -> int | None:
    return number if number is not None and number < _LONG else None
