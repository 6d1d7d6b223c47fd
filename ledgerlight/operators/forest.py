"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) trained and scored as Spark jobs."""

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Workers receive the functions of this module with the task; they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329
NODES = "tree int, node int, feature int, split double, left int, right int, length double"


def _mean_depth(size):
    """Average path length of an unsuccessful search among ``size`` rows."""
    size = np.asarray(size, dtype=float)
    safe = np.maximum(size, 3)
    long = 2 * (np.log(safe - 1) + EULER_GAMMA) - 2 * (safe - 1) / safe
    return np.where(size > 2, long, np.where(size == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays indexed (tree, node); a leaf has feature -1 and its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    expected: np.ndarray

    def score(self, columns: list[str]) -> Column:
        """Anomaly score in (0, 1] of rows whose features are ``columns``."""
        forest = self

        @F.pandas_udf("double")
        def anomaly(batch: pd.DataFrame) -> pd.Series:
            return pd.Series(forest.score_distinct(batch.to_numpy(dtype=float)))

        return anomaly(F.struct(*columns))

    def score_distinct(self, x: np.ndarray) -> np.ndarray:
        """``score_array``, walking the trees once for equal rows: a company's figures are repeated
        for each of its registry periods."""
        whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
        _, first, place = np.unique(whole, return_index=True, return_inverse=True)
        return self.score_array(x[first])[place]

    def score_array(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            feature = self.feature[t]
            while True:
                chosen = feature[node]
                inner = chosen >= 0
                if not inner.any():
                    break
                below = x[rows, np.maximum(chosen, 0)] < self.split[t][node]
                node = np.where(inner, np.where(below, self.left[t][node],
                                                self.right[t][node]), node)
            total += self.length[t][node] / self.expected[t]
        return np.power(2.0, -total / len(self.feature))


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Node rows of one tree over at most a few hundred sample rows."""
    random = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, pending = [None], [(0, np.arange(len(x)), 0)]
    while pending:
        node, rows, depth = pending.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[node] = (tree, node, -1, 0.0, -1, -1, depth + float(_mean_depth(len(rows))))
            continue
        feature = int(random.choice(usable))
        split = float(random.uniform(low[feature], high[feature]))
        if split <= low[feature]:
            split = float(np.nextafter(low[feature], high[feature]))
        below = x[rows, feature] < split
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[node] = (tree, node, feature, split, left, right, 0.0)
        pending += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


def _copies(u: np.ndarray, weight: np.ndarray, p: float) -> np.ndarray:
    """Binomial(weight, p) draws by inverting the distribution at ``u``."""
    copies = np.zeros(len(u), dtype=np.int64)
    term = np.exp(weight * np.log1p(-p)) if p < 1 else np.zeros(len(u))
    if p >= 1:
        return weight.astype(np.int64)
    reached = term.copy()
    open_ = (u >= reached) & (copies < weight)
    while open_.any():
        copies[open_] += 1
        term = np.where(open_, term * (weight - copies + 1) / np.maximum(copies, 1) * p / (1 - p),
                        term)
        reached = np.where(open_, reached + term, reached)
        open_ = open_ & (u >= reached) & (copies < weight) & (term > 0)
    return copies


def fit_forest(points: DataFrame, columns: list[str], weight: str, rows: int,
               trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    """Train on distinct ``points`` that stand for ``weight`` equal rows each.

    A tree's sample takes each of the ``rows`` rows with probability ``sample / rows``, drawn
    from a hash of the point, the tree and the seed, so the sample does not depend on the
    partitioning. Points are tested inside an array before any row is made, and each group of
    rows that reaches Python is one tree's sample.
    """
    p = min(1.0, sample / rows)
    hashed = F.xxhash64(*columns)

    def draw(t):
        return F.pmod(F.xxhash64(hashed, t, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    missed = F.pow(F.lit(1.0 - p), F.col(weight))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) >= missed)
    picked = points.select(*columns, F.col(weight).alias("_weight"),
                           F.explode(drawn).alias("tree"))
    picked = picked.withColumn("_u", draw(F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns)
        copies = _copies(pdf["_u"].to_numpy(), pdf["_weight"].to_numpy(), p)
        x = np.repeat(pdf[columns].to_numpy(dtype=float), np.maximum(copies, 1), axis=0)
        tree = int(pdf["tree"].iloc[0])
        grown = _grow(tree, x, seed)
        grown.append((tree, -1, -1, 0.0, -1, -1, float(_mean_depth(len(x)))))
        return pd.DataFrame(grown, columns=[c.split()[0] for c in NODES.split(", ")])

    # At most trees * (2 * sample size) rows, whatever the size of the table.
    nodes = picked.groupBy("tree").applyInPandas(grow, NODES).toPandas()
    return _pack(nodes)


def _pack(nodes: pd.DataFrame) -> Forest:
    expected = nodes[nodes.node < 0].sort_values("tree")
    nodes = nodes[nodes.node >= 0]
    place = {tree: i for i, tree in enumerate(expected.tree)}
    shape = (len(place), int(nodes.node.max()) + 1)
    at = (nodes.tree.map(place).to_numpy(), nodes.node.to_numpy())
    packed = {}
    for name in ("feature", "split", "left", "right", "length"):
        filled = np.zeros(shape, dtype=nodes[name].to_numpy().dtype)
        filled[at] = nodes[name].to_numpy()
        packed[name] = filled
    return Forest(**packed, expected=np.maximum(expected.length.to_numpy(), 1.0))
