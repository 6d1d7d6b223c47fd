"""Running sums over rows of any number, with no group in one task.

Rows are dealt by ranges of group and order, so a hot group spreads over many tasks. Each task sums
up its own stretch of a group as the rows stream by; what lies before a stretch comes from the sums
of the stretches, of which there are as many as tasks and groups together.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.common import arrow_map, written

#: The task stands in the upper bits of Spark's increasing ids.
_TASK_BITS = 33


def _within(batches):
    """Adds what the task's earlier rows of the same group sum up to."""
    group, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, sizes = batch.column(1), batch.column(3).to_numpy(zero_copy_only=False)
        fresh = np.ones(len(sizes), bool)
        fresh[1:] = pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = groups[0].as_py() != group
        ahead = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(fresh)
        base = np.zeros(len(sizes), np.int64)
        if len(starts):
            base[starts] = np.diff(np.concatenate([[0], ahead[starts]]))
            base = np.cumsum(base)
        before = ahead - base
        before[:starts[0] if len(starts) else len(sizes)] += total
        group, total = groups[-1].as_py(), int(before[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), groups, pc.shift_right(batch.column(2), _TASK_BITS), batch.column(3),
             pa.array(before)], ["doc_id", "grp", "part", "size", "before"])


def stretches(rows: DataFrame, group: Column, order: Sequence[Column], size: Column,
              name: str) -> DataFrame:
    """The rows as a table with grp, part, size and before: what the same task holds of the group
    ahead of the row. ``group`` is a string that is not null, ``order`` should tell all rows apart,
    or equal rows pile up in one task; ``size`` is a long that is not null."""
    plain = rows.select(F.struct(*rows.columns).alias("row"), group.alias("grp"), size.alias("size"),
                        *[o.alias(f"o{i}") for i, o in enumerate(order)])
    keys = ["grp", *[f"o{i}" for i in range(len(order))]]
    dealt = plain.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select("row", "grp", F.monotonically_increasing_id().alias("id"), "size")
    within = arrow_map(dealt, _within, "doc_id *, grp string, part long, size long, before long")
    return written(within.select("doc_id.*", "grp", "part", "size", "before"), name)


def sums(table: DataFrame, name: str) -> DataFrame:
    """grp, part, size and first (the sum of the group's earlier parts), a row for each stretch."""
    each = table.groupBy("grp", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(each.withColumn("first", F.coalesce(F.sum("size").over(ahead), F.lit(0))), name)
