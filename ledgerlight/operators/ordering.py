"""Places of rows in one total order, without sorting them in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.sources.sinks import scratch_path

#: Bits of a row's number inside its range, as ``monotonically_increasing_id`` lays them out.
INSIDE = 33


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "posicao",
             parts: int | None = None) -> DataFrame:
    """``rows`` with their place in ``order``, from 1 and without gaps.

    Rows are dealt to ranges of the order, sorted there and written with their number inside the
    range. Sampled range bounds may fall elsewhere in a second run, so the written table is what
    both the sizes of the ranges and the rows are read from. Offsets are a running sum over one row
    a range. ``order`` must be total up to identical rows.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_inside", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.parquet(path).withColumn("_range", F.shiftright("_inside", INSIDE))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = written.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_inside").bitwiseAND(F.lit((1 << INSIDE) - 1))
    return written.join(offsets, "_range").select(
        *rows.columns, (F.col("_offset") + inside + 1).alias(name))
