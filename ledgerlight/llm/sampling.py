"""Bounded samples of documents for fitting, with no group in one task and nothing else collected."""

from pyspark.sql import DataFrame, Window, functions as F

#: Parts in which a group is cut before its parts meet.
SALTS = 256


def first_of(ids: DataFrame, group: str, key: str, sample: int) -> DataFrame:
    """At most ``sample`` distinct keys of each group, those first by a hash of the key.

    Every part of a group is cut before the group meets, so a task sorts a part or as many rows as
    all parts may leave.
    """
    luck = F.xxhash64(key)
    ids = ids.select(group, key).distinct().withColumn("_part", F.pmod(luck, F.lit(SALTS)))
    for keys in ((group, "_part"), (group,)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(luck, key))
        ids = ids.withColumn("_place", place).where(F.col("_place") <= sample)
    return ids.select(group, key)


def texts_of(docs: DataFrame, chosen: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One whole text for each chosen key, however often it is repeated: the first by its hash.

    ``chosen`` is a sample of bounded size and travels to the documents."""
    rows = docs.join(F.broadcast(chosen), keys).where(F.col(text).isNotNull())
    return rows.groupBy(*chosen.columns).agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias(text))
