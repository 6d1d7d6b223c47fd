"""Minimax contiguous sharding, with DataFrame functions alone.

Documents with equal texts form an atomic group. Groups stand in the order of their text digest;
a shard is a run of them. The smallest capacity under which a greedy cut needs no more than the
wanted number of shards is found by binary search, and the groups are cut there.

The search runs over sums of digest prefixes. A prefix with more than one group is split further
only when a cut falls inside it and the answer depends on where: treated as divisible it gives a
lower bound on the shards needed, treated as atomic an upper bound, and while the two disagree
about a capacity the prefixes under the cuts are split into their 256 parts by one aggregation.
The driver holds prefix sums (4,097 and 256 for each split), never rows.

A group that is larger than an even share fixes the capacity by itself; it gets a shard of its own
and the runs on either side share the rest, so that no shard stays empty because of it.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.llm.common import written

FIRST_DIGITS = 3
MORE_DIGITS = 2
SLOT_PARTS = 256


class _Runs:
    """Ordered prefix sums of the groups, split on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.leaves = self._sums(F.lit(True), FIRST_DIGITS)

    def _sums(self, which, digits):
        """(prefix, bytes, is one group) in order; an absent text has the empty digest."""
        rows = (
            self.groups.where(which).groupBy(F.substring("digest", 1, digits).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        return sorted((r.prefix, r.bytes, r.n == 1) for r in rows)

    def split(self, prefixes):
        """Replaces leaves by their parts; one job for all of the same depth."""
        by_depth = {}
        for p in prefixes:
            by_depth.setdefault(len(p), []).append(p)
        kept = [leaf for leaf in self.leaves if leaf[0] not in prefixes]
        for depth, some in by_depth.items():
            kept += self._sums(F.substring("digest", 1, depth).isin(some), depth + MORE_DIGITS)
        self.leaves = sorted(kept)


def _greedy(leaves, capacity, divisible):
    """Shards needed, their start indexes, and the leaves of several groups that cuts touch."""
    shards, room, starts, touched = 1, capacity, [0], set()
    for i, (prefix, size, single) in enumerate(leaves):
        if size <= room:
            room -= size
            continue
        if single or not divisible:
            if not single:
                touched.add(prefix)
            shards, room = shards + 1, capacity - size
            starts.append(i)
            if room < 0:  # larger than any shard: only a further split can tell
                return len(leaves) + 2, starts, touched
        else:
            touched.add(prefix)
            size -= room
            more = -(-size // capacity)
            shards, room = shards + more, more * capacity - size
            starts.append(i)
    return shards, starts, touched


def _fits(runs, low, high, capacity, count):
    """Whether ``count`` shards of the capacity hold the leaves between two prefixes."""
    while True:
        leaves = _between(runs, low, high)
        most, _, under = _greedy(leaves, capacity, False)
        if most <= count:
            return True
        least, _, over = _greedy(leaves, capacity, True)
        if least > count:
            return False
        runs.split(under | over)


def _between(runs, low, high):
    return [x for x in runs.leaves if x[0] >= low and (high is None or x[0] < high)]


def _cut(runs, low, high, count, largest):
    """First prefixes of the shards that follow the first, smallest greatest shard."""
    total = sum(x[1] for x in _between(runs, low, high))
    if count <= 1 or not total:
        return []
    a, b = max(1, -(-total // count)), max(1, total)
    a = max(a, min(largest, b))
    while a < b:
        middle = (a + b) // 2
        if _fits(runs, low, high, middle, count):
            b = middle
        else:
            a = middle + 1
    _fits(runs, low, high, a, count)
    leaves = _between(runs, low, high)
    _, starts, _ = _greedy(leaves, a, False)
    return [leaves[i][0] for i in starts[1:]]


def boundaries(groups: DataFrame, count: int) -> list[str]:
    """Digests at which shards 1, 2, ... begin. ``groups`` has digest and bytes, one row each."""
    top = groups.orderBy(F.desc("bytes"), "digest").limit(count).select("digest", "bytes").collect()
    if not top:
        return []
    runs = _Runs(groups)
    return sorted(_around(runs, "", None, count, [(r.digest, r.bytes) for r in top]))


def _around(runs, low, high, count, large):
    """Gives groups above an even share their own shard, largest first, then cuts the rest."""
    large = [x for x in large if x[0] >= low and (high is None or x[0] < high)]
    total = sum(x[1] for x in _between(runs, low, high))
    if count < 3 or not large or large[0][1] * count <= total:
        return _cut(runs, low, high, count, large[0][1] if large else 1)
    digest, size = large[0]
    while holding := [x[0] for x in _between(runs, low, high)
                      if digest.startswith(x[0]) and not x[2]
                      and len(x[0]) < len(digest) and (x[0] or digest == "")]:
        runs.split(holding)
    here = [x[0] for x in _between(runs, low, high)]
    own = max(p for p in here if p <= digest)
    after = min((p for p in here if p > own), default=None)
    before = sum(x[1] for x in _between(runs, low, own))
    rest = total - size - before
    share, n = count - 1, 0
    if before and rest:
        n = min(range(1, share), key=lambda k: max(before / k, rest / (share - k)))
    elif before:
        n = share
    starts = []
    if before:
        starts += [*_around(runs, low, own, n, large[1:]), own]
    if rest:
        starts += [after, *_around(runs, after, high, share - n, large[1:])]
    return starts


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Every row with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned; of no bytes for
    a null text), law (``bytes``), shard, slot (from 0, without gaps) and grown_shard (null: the
    law does not say where a row goes when shards are added). A null text is a group of its own,
    apart from the empty one. Null and repeated ids and repeated rows each keep their row. Fewer
    groups than shards leave shards empty. Further columns are ignored.
    """
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("digest"),
    ), "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    starts = boundaries(groups, shards)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("digest") >= F.lit(start)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOT_PARTS)).cast("int"))
    # shards x 256 counts: a bounded table
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "digest")
    return placed.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
