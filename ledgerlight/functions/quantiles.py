"""Exact quantiles of columns too large for one aggregation buffer."""

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

BUCKETS = 1000


def exact_quantile(df: DataFrame, value: str, weight: str, q: float) -> float | None:
    """Linearly interpolated q-quantile of ``value``, each row counted ``weight`` times.

    ``percentile`` keeps every distinct value in one buffer. Here each pass counts at most
    ``BUCKETS + 1`` equal-width buckets, combined inside the map tasks, and keeps the bucket
    that holds the wanted rank, until it holds a single value. A pass narrows the range about
    a thousandfold, so a few passes do, and neither ties nor the row count change that.
    """
    df = df.select(F.col(value).alias("v"), F.col(weight).alias("w")).where("v IS NOT NULL")
    total, low, high = df.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    rank = q * (total - 1)
    first, share = math.floor(rank), rank - math.floor(rank)
    at, up_to = _order_statistic(df, first, low, high)
    if share == 0 or up_to > first + 1:
        return at
    following = df.where(F.col("v") > at).agg(F.min("v")).first()[0]
    return at + share * (following - at)


def _order_statistic(df: DataFrame, rank: int, low: float, high: float) -> tuple[float, int]:
    """The value at 0-based ``rank`` and the weight of all values up to it."""
    below = 0
    while low < high:
        bucket = F.width_bucket("v", F.lit(low), F.lit(high), F.lit(BUCKETS))
        counted = (
            df.where(F.col("v").between(low, high))
            .groupBy(bucket.alias("b"))
            .agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        for row in sorted(counted.collect(), key=lambda r: r.b):  # at most BUCKETS + 1 rows
            if below + row.w > rank:
                low, high = row.lo, row.hi
                break
            below += row.w
    return low, below + df.where(F.col("v") == low).agg(F.sum("w")).first()[0]


def grouped_quantiles(df: DataFrame, group: str, value: str,
                      shares: Sequence[float]) -> dict[object, list[float]]:
    """Linearly interpolated quantiles of every group's values, nulls left out, for all groups and
    shares at once.

    Equal values are counted together first. Then each pass narrows the range of every rank that is
    still open: its range is cut into ``BUCKETS`` of equal width, whose counts combine inside the map
    tasks, and the bucket that holds the rank is its next range. A range of one value ends. So no
    task and no buffer holds a group's values, and the driver receives bucket counts. Groups are few:
    the driver holds one state for each group and rank.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(
        F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spans = {r.g: r for r in counted.groupBy("g").agg(
            F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        places = {g: [share * (r.n - 1) for share in shares] for g, r in spans.items()}
        state = {(g, rank): (spans[g].lo, spans[g].hi, 0) for g, some in places.items()
                 for p in some for rank in (math.floor(p), math.ceil(p))}
        while ranges := {(g, lo, hi) for (g, _), (lo, hi, _) in state.items() if lo < hi}:
            table = df.sparkSession.createDataFrame(
                sorted(ranges, key=repr), T.StructType([counted.schema["g"], *(
                    T.StructField(c, T.DoubleType()) for c in ("lo", "hi"))]))
            inside = counted.join(F.broadcast(table), "g").where("v BETWEEN lo AND hi")
            bucket = F.width_bucket("v", F.col("lo"), F.col("hi"), F.lit(BUCKETS))
            rows = inside.groupBy("g", "lo", "hi", bucket.alias("b")).agg(
                F.sum("w").alias("w"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
            found = {}
            for r in sorted(rows, key=lambda r: r.b):  # BUCKETS + 1 a range
                found.setdefault((r.g, r.lo, r.hi), []).append(r)
            for (g, rank), (lo, hi, below) in state.items():
                if lo < hi:
                    for r in found[g, lo, hi]:
                        if below + r.w > rank:
                            state[g, rank] = r.least, r.most, below
                            break
                        below += r.w
    finally:
        counted.unpersist()

    def between(g, place):
        low, high = math.floor(place), math.ceil(place)
        a, b = state[g, low][0], state[g, high][0]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    return {g: [between(g, p) for p in some] for g, some in places.items()}
