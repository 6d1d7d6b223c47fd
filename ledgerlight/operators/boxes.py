"""An isolation forest as a table of leaf boxes, scored by a join instead of a Python function.

A leaf is the box of all points that reach it: for each feature at least ``low`` and below ``high``,
null where it is open. Its share of the score is its path length over the tree's expected one, as a
whole number of 2^-40, so the sum over the trees is the same in any order and any engine.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.operators.forest import Forest

UNIT = 1 << 40


def leaf_boxes(spark: SparkSession, forest: Forest, features: Sequence[str]) -> DataFrame:
    """tree, leaf, share and low_/high_ of every feature.

    A table of at most ``trees * sample`` rows: 25,600 by the defaults, some 4 MB.
    """
    rows = []
    for tree in range(len(forest.feature)):
        pending = [(0, {}, {})]
        while pending:
            node, low, high = pending.pop()
            d = int(forest.feature[tree][node])
            if d < 0:
                share = round(float(forest.length[tree][node]) / float(forest.expected[tree]) * UNIT)
                rows.append((tree, node, share, *map(low.get, range(len(features))),
                             *map(high.get, range(len(features)))))
                continue
            split = float(forest.split[tree][node])
            # a split above the box's own bounds leaves one side empty: no point reaches it
            if low.get(d) is None or split > low[d]:
                pending.append((int(forest.left[tree][node]), low, {**high, d: min(split, high.get(d, split))}))
            if high.get(d) is None or split < high[d]:
                pending.append((int(forest.right[tree][node]), {**low, d: max(split, low.get(d, split))}, high))
    bounds = ", ".join(f"{side}_{c} double" for side in ("low", "high") for c in features)
    return spark.createDataFrame(rows, f"tree int, leaf int, share long, {bounds}")


def score_by_boxes(rows: DataFrame, boxes: DataFrame, features: Sequence[str], trees: int,
                   name: str = "score_anomalia") -> DataFrame:
    """``rows`` with their anomaly score; null where a feature is missing.

    Every distinct point meets the boxes of each tree by that tree's number and the bounds; equal
    rows are one point, so a hot point costs nothing more until the scores are joined back.
    """
    known = rows
    for c in features:
        known = known.where(F.col(c).isNotNull())
    points = known.select(*features).distinct().withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    inside = points["tree"] == boxes["tree"]
    for c in features:
        x, low, high = points[c].cast("double"), boxes[f"low_{c}"], boxes[f"high_{c}"]
        inside &= (low.isNull() | (x >= low)) & (high.isNull() | (x < high))
    shares = points.join(boxes, inside).groupBy(*[points[c] for c in features]).agg(
        F.sum("share").alias("_share"))
    score = F.pow(F.lit(2.0), -F.col("_share") / F.lit(float(UNIT)) / F.lit(trees))
    return rows.join(shares, list(features), "left").select(*rows.columns, score.alias(name))
