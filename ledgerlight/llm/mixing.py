"""Mixing of sources to target weights by weighted fair queueing.

Every source is an endless queue of its documents in a shuffled order, passed through ``repeats``
times at most. A document's virtual finish time is what its source has sent up to its end, divided
by the source's weight; sent in the order of finish times, all sources progress in proportion to
their weights, and one that has run out leaves its part to the others. The mix is that order, cut
where the budget is used up. There each source has sent its target: its share by weight, or all its
repeats where that is less, what remains being shared among the others by weight again. A document
that is being sent at that moment is cut there, as texts are when a token budget ends.

Virtual times are integers: weights are, and times are multiplied by their least common multiple.
Sums within a source and along the mix are running sums over ranges (``running``), so a source that
holds most rows is spread over the tasks. What the plan for the sources needs is one row each.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.llm.common import written
from ledgerlight.llm.running import stretches, sums

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 1
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``documents`` has every row with its key, source_size and target; ``entries`` has the mix in
    its order: key, doc_id, source, epoch, finish (virtual), position (words ahead), words."""

    documents: DataFrame
    entries: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken: the words of all entries of a document."""
        every = self.documents.select("key", "doc_id", "size", "source_size", "target", F.lit(0).alias("words"))
        nothing = [F.lit(None).cast(every.schema[c].dataType).alias(c)
                   for c in ("doc_id", "size", "source_size", "target")]
        sent = self.entries.select("key", *nothing, "words")
        own = [F.max_by(c, F.col("size").isNotNull()).alias(c) for c in ("doc_id", "size", "source_size", "target")]
        return every.unionByName(sent).groupBy("key").agg(
            *own, F.sum("words").cast("long").alias("taken")).drop("key")


def plan(sizes: DataFrame, weights, repeats: int) -> DataFrame:
    """grp, source_size, rank, weight, target, sent and budget from one row (grp, source_size) for each source.

    Sources ranked by their group take the weights in turn. Ordered by when they run out, those that
    do so before the budget is used up send all they have; the others share what is left.
    """
    step = math.lcm(*weights)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("grp")) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)).cast("long"))
    whole = Window.partitionBy()
    upto = Window.orderBy("ends", "grp").rowsBetween(Window.unboundedPreceding, 0)
    wide = "decimal(38,0)"
    ranked = ranked.withColumn("most", F.col("source_size") * repeats).withColumn(
        "ends", F.col("most").cast(wide) * F.expr(f"{step} div weight")).withColumn(
        "budget", F.sum("source_size").over(whole))
    left = (F.sum("weight").over(whole) - F.sum("weight").over(upto)).cast(wide)
    used = F.sum("most").over(upto).cast(wide) * step
    ranked = ranked.withColumn("out", used + (F.col("ends") * left).cast(wide) <= F.col("budget").cast(wide) * step)
    rest = F.col("budget") - F.sum(F.when(F.col("out"), F.col("most")).otherwise(0)).over(whole)
    of = F.sum(F.when(F.col("out"), 0).otherwise(F.col("weight"))).over(whole)
    ranked = ranked.withColumn("rest", F.col("weight") * rest).withColumn("of", of)
    return ranked.select(
        "grp", "source_size", "rank", "weight", "budget", F.lit(step).cast("long").alias("step"),
        F.when(F.col("out"), F.col("most").cast("double"))
        .otherwise(F.col("rest").cast("double") / F.nullif("of", F.lit(0)).cast("double")).alias("target"),
        F.when(F.col("out"), F.col("most")).otherwise(F.expr("rest div nullif(of, 0)")).alias("sent"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """The mix of all documents; its budget is the sum of their words.

    Sources stand in code point order, a null source last, and take the weights in turn. Documents of
    a source are shuffled by a digest of seed and id; null ids come first, equal ids are ordered by
    size. A null text or one without words has size 0 and no entry. Repeated rows and ids each keep
    their row, told apart by ``key``. Reruns agree. An empty table gives an empty mix. Further columns
    are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col(source).cast("string")
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), name.alias("source"),
        F.when(name.isNull(), ">").otherwise(F.concat(F.lit("="), name)).alias("queue"),  # > is behind =
        size.alias("n"),
        F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary")), F.lit("")).alias("luck"),
    ), "mix-rows")
    queued = stretches(rows, F.col("queue"), [F.col("luck"), F.col("doc_id"), F.col("n"), F.col("key")],
                       F.col("n"), "mix-queues").drop("queue", "luck", "n")
    parts = sums(queued, "mix-sums")
    planned = plan(parts.groupBy("grp").agg(F.sum("size").alias("source_size")), weights, repeats)
    parts = written(parts.select("grp", "part", "first").join(planned, "grp"), "mix-plan")
    placed = queued.join(parts, ["grp", "part"]).withColumn("before", F.col("first") + F.col("before"))

    # what the source has sent of the document when it has sent all of ``sent``, each time around
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    entries = placed.where("size > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", start)
    entries = entries.withColumn("words", F.least("size", F.col("sent") - F.col("start"))).where("words > 0")
    entries = entries.select(
        "key", "doc_id", "source", "rank", "epoch", "start", "words", "budget",
        ((F.col("start") + F.col("size")) * F.expr("step div weight")).alias("finish"))
    queue = stretches(entries, F.lit("mix"), [F.col("finish"), F.col("rank"), F.col("start")],
                      F.col("words"), "mix-entries")
    ahead = sums(queue, "mix-ahead").select("grp", "part", "first")
    position = F.col("first") + F.col("before")
    sent = queue.join(F.broadcast(ahead), ["grp", "part"])  # a row for each task of the sort
    sent = sent.withColumn("position", position).where("position < budget").withColumn(
        "words", F.least("words", F.col("budget") - F.col("position")))
    return Mix(placed.select("key", "doc_id", "source", "size", "source_size", "target"),
               sent.select("key", "doc_id", "source", "epoch", "finish", "position", "words"))
