"""Joins and top-k shapes that hold up under one very hot key."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64


def best_rows(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def best_rows_per(rows: DataFrame, group: Sequence[str], order: Sequence[Column],
                  limit: int | None, salts: int = SALTS) -> DataFrame:
    """First ``limit`` rows of every group, all without one.

    Each group is cut in ``salts`` parts first, and Spark cuts every part once more inside the
    map tasks, so no task ever sorts more than ``salts * limit`` rows of a finished group.
    """
    if limit is None:
        return rows
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    parted = Window.partitionBy(*group, "_part").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(parted))
    rows = rows.where(F.col("_place") <= limit).drop("_part", "_place")
    rows = rows.withColumn("_place", F.row_number().over(whole))
    return rows.where(F.col("_place") <= limit).drop("_place")


#: Rows of a list that one task may rank.
SHORT = 100_000


def attach_to_best(rows: DataFrame, details: DataFrame, on: Sequence[str],
                   order: Sequence[Column], limit: int | None,
                   details_order: Sequence[Column] = ()) -> DataFrame:
    """``rows LEFT JOIN details ON on ORDER BY order, details_order LIMIT limit``.

    ``order`` uses columns of ``rows`` alone and a left join drops none of them, so the cut
    comes first and a key with very many details does not multiply the other rows. The limit
    bounds what Spark estimates for the cut: a short list is broadcast to the details, which are
    then not shuffled, a long one is joined and ranked by ranges alone. ``order`` must be total up to identical rows.

    The cut is used twice, to find details and to keep rows without any. It ends in an exchange
    and both uses need the same columns of it, so Spark runs it once.
    """
    on = list(on)
    if limit is None:
        return fan_out_left_join(rows, details, on).orderBy(*order, *details_order)
    if limit > SHORT:
        best = rows.orderBy(*order).limit(limit)
        return fan_out_left_join(best, details, on).orderBy(*order, *details_order).limit(limit)
    extra = [c for c in details.columns if c not in on]
    place = F.rank().over(Window.orderBy(*order))
    best = rows.orderBy(*order).limit(limit).withColumn("_place", place).repartition(1)
    known = details.where(" AND ".join(f"{c} IS NOT NULL" for c in on)).withColumnsRenamed(
        {c: f"_on_{c}" for c in on}
    )
    # Null-safe equality adds no filter to the cut; null keys are already gone from the details.
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    found = (
        known.join(best, match)
        .select(*best.columns, *extra, F.lit(False).alias("_alone"))
        .orderBy("_place", *details_order)
        .limit(limit)
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in details.schema if f.name in extra}
    alone = best.select("*", *[missing[c].alias(c) for c in extra], F.lit(True).alias("_alone"))
    matched = F.min("_alone").over(Window.partitionBy("_place"))  # at most 2 * limit rows
    return (
        found.union(alone)
        .withColumn("_matched", matched)
        .where("_alone = _matched")
        .orderBy("_place", *details_order)
        .limit(limit)
        .drop("_place", "_alone", "_matched")
    )


def join_group_stats(rows: DataFrame, stats: DataFrame, on: Sequence[str], spread: str,
                     how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to one-row-per-group statistics without piling a hot group on one task.

    Each group is split ``salts`` ways by a hash of ``spread`` and its statistics row is
    repeated once per part. When the statistics turn out small at run time, adaptive
    execution broadcasts them instead; nothing here assumes that they are.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        rows.withColumn("_part", part)
        .join(stats.withColumn("_part", parts), [*on, "_part"], how)
        .drop("_part")
    )


#: Rows of one key that a task of a fan-out join takes.
PART_ROWS = 100_000


def fan_out_left_join(rows: DataFrame, details: DataFrame, on: str | Sequence[str],
                      part_rows: int = PART_ROWS) -> DataFrame:
    """``rows LEFT JOIN details ON on`` where one key may hold very many of the details.

    Adaptive execution cannot split the right side of a left join. So the details of a key are
    dealt to as many parts as it takes to keep ``part_rows`` in each (``dealt_details``), and its rows
    are repeated for every part that has details. Keys of one part are not listed anywhere, and how
    the list of the others travels is left to Spark's size check.
    """
    on = [on] if isinstance(on, str) else list(on)
    spread = dealt_details(details, on, part_rows)
    filled = spread.where("_hot").select(*on, "_part").distinct()
    repeated = rows.join(filled, on, "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    joined = repeated.join(spread.drop("_hot"), [*on, "_part"], "left")
    each = F.explode(F.array_repeat(F.lit(True), F.coalesce("_copies", F.lit(1))))
    return joined.withColumn("_each", each).drop("_part", "_copies", "_each")


def dealt_details(details: DataFrame, on: Sequence[str], part_rows: int) -> DataFrame:
    """The details with _hot (their key has more than a part), _part and _copies.

    Equal rows of a hot key are one row with the number of copies, cut at ``part_rows``; the pieces
    go round the parts one after another, other rows by their hash. All of it follows from the rows
    alone, so a task that runs again deals alike.
    """
    parts = F.ceil(F.col("_n") / part_rows).cast("int")
    large = details.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows).select(
        *on, parts.alias("_parts"))
    marked = details.join(large, on, "left")
    cold = marked.where("_parts IS NULL").select(
        *details.columns, F.lit(False).alias("_hot"), F.lit(0).alias("_part"), F.lit(1).alias("_copies"))
    hot = marked.where("_parts IS NOT NULL").groupBy(*details.columns, "_parts").agg(F.count("*").alias("_n"))
    pieces = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / part_rows) - 1)
    hot = hot.withColumn("_piece", F.explode(pieces))
    hot = hot.select(
        *details.columns, F.lit(True).alias("_hot"),
        F.pmod(F.xxhash64(*details.columns) + F.col("_piece"), F.col("_parts")).cast("int").alias("_part"),
        F.least(F.lit(part_rows), F.col("_n") - F.col("_piece") * part_rows).cast("int").alias("_copies"))
    return cold.unionByName(hot)
