"""Exact Jaccard self-join of documents on word shingles, through token-combination prefixes.

A document is the set of its distinct five-word shingles. If two sets are similar enough, they
share at least ``need(n)`` shingles, so when every set is ordered alike they share one among the
first n - need(n) + 1, and l among the first n - need(n) + l. The order puts shingles of the rare
class first and those of the frequent class last.

* Where the plain prefix holds rare shingles only, each is an index key: what it shares there
  with a similar set is rare, hence a single key of both.
* Where it reaches into the frequent class, its rare shingles are keys, and the prefix is extended
  by l - 1 more: then a similar set shares a rare key, or at least l frequent shingles. The
  frequent ones are dealt by hash into l - 1 classes, so two of the shared ones fall into the same
  class, and all pairs within a class are keys. The number of classes follows from the power of
  two below n; as sizes of similar sets differ by less than a factor of two, each set emits keys
  for its own power and the next. A class holds a few shingles, so keys stay in proportion to n.

Which shingles are frequent is read from counts in a fixed number of cells, summed over all
documents. A cell counts at least each of its shingles, so no rare shingle is more frequent than
the bound says; the classes only steer the order, which any two documents share.

Sets that are equal are one node. Similar nodes share not just one key but a number that follows
from their sizes (``_least_shared``), and a node shares nothing of its keys that no other has with
nodes whose keys reach as far as its own; so most pairs are ruled out by counts alone, before whole sets are compared. Comparison goes in two steps. First each node meets a
few nodes of each of its keys, those that share most, and what links is contracted. Then only nodes of different
components that share a key meet, in each key those outside its largest component with all. So a
large group of near copies costs a few comparisons for each member, and no link that would join
two components is passed over. ``every_link`` lets all nodes that share a key meet instead and
counts their links.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.llm.common import arrow_map, drop, picked, row_ranges, utf8, written
from ledgerlight.llm.components import components
from ledgerlight.llm.words import hashed, run_hashes, stir

PERCENT = 75
WORDS = 5
#: Cells of the frequency counts, and of one part of them.
CELL_BITS = 22
PART_BITS = 16
#: Standard deviations above the mean cell at which a cell is frequent.
ABOVE = 8
#: Nodes of a key that all its nodes meet first.
HUBS = 6
#: Nodes of the sample that tells hot keys, about, and how many of them make a key hot.
HOT_SAMPLE = 4_000
HOT = 20
#: Parts of a component's rows that join apart.
SALTS = 32
#: Combinations of a node before another that it is compared by.
BEFORE = 16
#: Top bits of its last key that tell how far a plain prefix reaches.
END_BITS = 16
#: Bits that preselect the documents whose whole sets are needed: so many for each, which lets one
#: other document in sixteen through, within these powers of two. Beyond the larger (16 MB, eight
#: million documents) more are let through, which costs time alone.
BITS_EACH = 16
FILTER_BITS = 22, 27
NODES = "doc_id *, node long, n int, singles int, keys array<bigint>"
_U = np.uint64


def need(n: int, percent: int) -> int:
    """Shingles a set of n shares with any similar one, at least."""
    return -(-n * percent // 100)


def _sets(batch, words):
    """(row, sorted distinct shingle hashes, fingerprint of the set) of each row of a batch."""
    data, offsets = utf8(batch.column(1))
    for i, j in row_ranges(offsets, 1 << 20):
        hashes, at = hashed(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower=True)
        for k in range(j - i):
            found = np.unique(run_hashes(hashes[at[k]:at[k + 1]], words))
            yield i + k, found, xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else None


def _signed(x):
    return x - (1 << 64) if x is not None and x >= 1 << 63 else x


def _count_cells(words):
    """Cell counts of a task's distinct sets, in parts; sparse where that is smaller."""
    def run(batches):
        counts, seen, held, size = np.zeros(1 << CELL_BITS, np.int64), set(), [], 0

        def add():
            cells = (np.concatenate(held) >> _U(64 - CELL_BITS)).astype(np.int64)
            counts[:] += np.bincount(cells, minlength=len(counts))

        for batch in batches:
            for _, found, node in _sets(batch, words):
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append(found)
                size += len(found)
                if size > 1 << 20:
                    add()
                    held, size = [], 0
        if held:
            add()
        for part, some in enumerate(counts.reshape(-1, 1 << PART_BITS)):
            where = np.flatnonzero(some)
            if not len(where):
                continue
            most = int(some.max())
            kind = "u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8"
            dense = len(where) * 3 > len(some)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([kind]),
                pa.array([None if dense else where.astype("<u2").tobytes()], pa.binary()),
                pa.array([(some if dense else some[where]).astype(kind).tobytes()], pa.binary()),
            ], ["part", "kind", "cells", "counts"])
    return run


def _sum_cells(batches):
    """Sums of the parts a task was dealt, as they stream by."""
    sums = {}
    for batch in batches:
        for part, kind, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            total = sums.setdefault(part, np.zeros(1 << PART_BITS, np.int64))
            counts = np.frombuffer(counts, kind).astype(np.int64)
            if cells is None:
                total += counts
            else:
                total[np.frombuffer(cells, "<u2")] += counts
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()),
             pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())],
            ["part", "counts"])


def frequent_cells(docs: DataFrame, words: int) -> np.ndarray:
    """A bit for each cell. The driver receives one number for each of the fixed cells."""
    parts = arrow_map(docs, _count_cells(words), "part int, kind string, cells binary, counts binary")
    summed = arrow_map(parts.repartition("part"), _sum_cells, "part int, counts binary")
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    for part, raw in summed.collect():
        counts[part << PART_BITS:(part + 1) << PART_BITS] = np.frombuffer(raw, "<u4")
    mean = counts.mean()
    return np.packbits(counts > mean + ABOVE * np.sqrt(mean) + 2 * ABOVE)


def combination_keys(frequent: np.ndarray, classes: int, seed: int) -> np.ndarray:
    """Keys of all pairs of shingles in the same class."""
    spread = stir(frequent ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    order = np.argsort(spread % _U(classes), kind="stable")
    spread = spread[order]
    which = spread % _U(classes)
    keys, gap = [], 1
    while gap < len(spread):
        same = which[gap:] == which[:-gap]
        if not same.any():
            break
        a, b = spread[:-gap][same], spread[gap:][same]
        keys.append(stir(np.minimum(a, b) * _U(0xD6E8FEB86659FD93) + np.maximum(a, b)))
        gap += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def index_keys(found: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """Index keys of a sorted set, single ones first, and how many those are; ``frequent`` holds
    the bits of the cells."""
    n = len(found)
    cells = (found >> _U(64 - CELL_BITS)).astype(np.int64)
    often = (frequent[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    rare, often = found[~often], found[often]
    plain = n - need(n, percent) + 1
    if len(rare) >= plain:
        return plain, rare[:plain]
    keys = [rare]
    if len(often):
        power = n.bit_length() - 1
        for p in (power, power + 1):
            classes = max(1, (1 << p) // 8)
            prefix = min(n, n - need(n, percent) + classes + 1)
            keys.append(combination_keys(often[:prefix - len(rare)], classes, p + 1))
    return len(rare), np.concatenate(keys)


def _nodes(words, percent, held):
    """Node and size of every row; keys where the task meets the node first."""
    def run(batches):
        frequent, seen = held.value, set()
        for batch in batches:
            rows, nodes, sizes, singles, keys = [], [], [], [], []

            def out():
                lengths = np.cumsum([0, *(0 if k is None else len(k) for k in keys)])
                flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.uint64)])
                return pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([_signed(x) for x in nodes], pa.int64()), pa.array(sizes, pa.int32()),
                    pa.array(singles, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat.view(np.int64)))],
                    ["doc_id", "node", "n", "singles", "keys"])

            size = 0
            for row, found, node in _sets(batch, words):
                alone, some = None, None
                if node is not None and node not in seen:
                    seen.add(node)
                    alone, some = index_keys(found, frequent, percent)
                    size += len(some)
                rows.append(row)
                nodes.append(node)
                sizes.append(len(found))
                singles.append(alone)
                keys.append(some)
                if size > 1 << 20:
                    yield out()
                    rows, nodes, sizes, singles, keys, size = [], [], [], [], [], 0
            if rows:
                yield out()
    return run


def _whole_sets(words, held):
    """Sets of the rows whose bit is set, once for each node of a task."""
    def run(batches):
        wanted, seen = held.value, set()
        for batch in batches:
            cells = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)))
            for _, found, node in _sets(batch, words):
                if node is not None and node not in seen:
                    seen.add(node)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([_signed(node)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()),
                                                 pa.array(found.view(np.int64)))], ["node", "shingles"])
    return run


def _sets_of(pairs, nodes, docs, words):
    """Whole shingle sets of all nodes in ``pairs``, made again from the texts, one row each.

    A filter of bounded size, sent to every task, spares most other documents the work; the sets
    of those that it lets through meet no pair.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = written(nodes.join(ends, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "chosen")
    bits = min(max((chosen.count() * BITS_EACH).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).cast("int")
    parts = chosen.select(cell.alias("cell")).groupBy(F.expr("cell div 32768").alias("part")).agg(
        F.expr("bitmap_construct_agg(cell % 32768)").alias("bits")).collect()  # 4 KB each, 16 MB at most
    drop(chosen)
    wanted = np.zeros(1 << bits - 3, np.uint8)
    for part, some in parts:  # the first cell is the lowest bit of the first byte
        raw = np.unpackbits(np.frombuffer(bytes(some), np.uint8), bitorder="little")
        wanted[part * 4096:(part + 1) * 4096] = np.packbits(raw)
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    sets = arrow_map(docs.withColumn("cell", cell), _whole_sets(words, held),
                     "node long, shingles array<bigint>")
    return sets.join(ends, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs, nodes, docs, words, percent, name):
    """The pairs (a, b) that link, as a table."""
    pairs = written(pairs, f"{name}-pairs")
    sets = _sets_of(pairs, nodes, docs, words)  # one exchange by node serves both ends
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    whole = pairs.join(a, "a").join(b, "b").select(
        "a", "b", shared.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    links = written(whole.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select(
        "a", "b"), name)
    drop(pairs)
    return links


def _common(m, n, percent):
    """Shingles that similar sets of these sizes share at least: the union's bound asks for
    percent / (100 + percent) of both sizes."""
    return F.ceil((m + n) * percent / (100 + percent))


def _prefix_end(percent):
    """How far a node's keys reach among the rare shingles: a plain prefix up to its last key, of
    which the top bits tell, any other past all of them."""
    plain = F.col("singles") > F.col("n") - F.ceil(F.col("n") * percent / 100)
    last = F.shiftrightunsigned(F.get("keys", F.col("singles") - 1), 64 - END_BITS)
    return F.when(plain, last).otherwise(1 << END_BITS).cast("int")


def _binding(l, r, of_l, of_r, both, either):
    """What the two nodes' values ``of_l`` and ``of_r`` say of the single keys they share.

    Up to where the earlier of two prefixes ends, all rare shingles of both are keys. So only the
    keys of that node that the other does not have as keys are surely missing from it, and its value
    holds. Both hold (``both``) where all rare shingles are keys on either side; where two plain
    prefixes end too close to tell, it is one of the two (``either``).
    """
    end_l, end_r = F.col(f"{l}.end"), F.col(f"{r}.end")
    return (F.when(end_l < end_r, of_l).when(end_r < end_l, of_r)
            .when(end_l == 1 << END_BITS, both(of_l, of_r)).otherwise(either(of_l, of_r)))


def _least_shared(l, r, percent):
    """Single keys that two similar nodes share at least: only as many of the binding node's may be
    missing from the other as ``_common`` leaves."""
    common = _common(F.col(f"{l}.n"), F.col(f"{r}.n"), percent)
    of_l = common - F.col(f"{l}.n") + F.col(f"{l}.singles")
    of_r = common - F.col(f"{r}.n") + F.col(f"{r}.singles")
    return _binding(l, r, of_l, of_r, F.greatest, F.least)


def _shared(keys, nodes):
    """The distinct rows (key, node, single, hot) of keys that more than one node has.

    Least and greatest node tell, key by key in one task. A key that many nodes of a bounded sample
    have is hot, and shared for sure: its rows are kept without coming together anywhere.
    """
    every = max(1, nodes.count() // HOT_SAMPLE)
    some = keys.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("key", "node").distinct()
    hot = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select(
        "key", F.lit(True).alias("hot"))
    marked = keys.join(F.broadcast(hot), "key", "left")  # a few thousand keys, as the sample is bounded
    by_key = Window.partitionBy("key")
    cold = marked.where("hot is null").withColumn("low", F.min("node").over(by_key)).withColumn(
        "high", F.max("node").over(by_key)).where("low <> high")
    return cold.select(*keys.columns, F.lit(False).alias("hot")).unionByName(
        marked.where("hot").select(*keys.columns, "hot")).distinct()


def _with_hubs(rows):
    """Each row of a key (l) with the key's few hubs (r) that are better: what a group has in common
    is most of what its original holds, and that one links best.

    A hot key's hubs are the best of each of a few classes of its nodes, which map tasks combine.
    """
    node = F.struct("node", "n", "singles", "end", "reach")
    rank = F.struct((F.col("reach") / F.col("n")).alias("share"), "node", "n", "singles", "end", "reach")
    cold, hot = (rows.where(F.col("hot") == is_hot).select("key", "single", node.alias("l"), rank.alias("rank"), "node")
                 for is_hot in (False, True))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rank")))
    cold = cold.withColumn("place", place).withColumn("hubs", F.collect_list(
        F.when(F.col("place") <= HUBS, F.col("rank"))).over(Window.partitionBy("key"))).drop("place")
    best = [F.max(F.when(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS)) == k, F.col("rank"))).alias(f"hub{k}")
            for k in range(HUBS)]
    hubs = hot.groupBy("key").agg(*best).select("key", F.filter(
        F.array(*[F.col(f"hub{k}") for k in range(HUBS)]), lambda h: h.isNotNull()).alias("hubs"))
    both = cold.unionByName(hot.join(hubs, "key"))
    return both.select("single", "l", "rank", F.explode("hubs").alias("r")).where("rank < r").select("single", "l", "r")


def _between(rows):
    """Rows (key, node, single, part, minor) of the keys that nodes of several parts have; minor are
    those outside the part that has most of the key."""
    by_key = Window.partitionBy("key")
    cold = rows.where("not hot").withColumn("low", F.min("part").over(by_key)).withColumn(
        "high", F.max("part").over(by_key)).where("low <> high")
    cold = cold.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "part"))).withColumn(
        "main", F.max(F.struct("n", "part")).over(by_key)["part"])
    hot = rows.where("hot")
    parts = hot.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mains = parts.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts"))
    hot = hot.join(mains.where("parts > 1"), "key")
    columns = ["key", "node", "single", "part", (F.col("part") != F.col("main")).alias("minor")]
    return cold.select(*columns).unionByName(hot.select(*columns))


def _fits(m, n, percent):
    """Whether sets of these sizes can be similar at all."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def jaccard_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, doc_id: str = "doc_id",
                 text: str = "text", every_link: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, and with ``every_link`` also
    n_links, its links to documents of other shingle sets.

    Two documents link when 100 * shared shingles >= percent * shingles of both. A document with
    fewer words than a shingle has its word sequence as its only one; one without words, or a null
    text, links with nothing and is its own component. component_id is the smallest doc_id
    reachable; ids that are null do not count, and a component of such only has a null one. Null
    and repeated ids and repeated rows each keep their row. Shingles and sets are told apart by
    64-bit hashes. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = picked(docs, doc_id, text)
    held = spark.sparkContext.broadcast(frequent_cells(docs, words))
    nodes = written(arrow_map(docs, _nodes(words, percent, held), NODES), "nodes")

    # keys travel with their node alone; its sizes come back for the few that two nodes have
    keys = nodes.where(F.size("keys") > 0).select("node", "singles", F.posexplode("keys").alias("at", "key"))
    keys = keys.select("key", "node", (F.col("at") < F.col("singles")).alias("single"))
    sizes = nodes.where(F.size("keys") > 0).select("node", "n", "singles", _prefix_end(percent).alias("end")).distinct()
    keys, sizes = written(_shared(keys, nodes), "keys"), written(sizes, "sizes")
    rows = written(nodes.select("doc_id", "node", "n"), "rows")
    drop(nodes)

    def with_reach(some, name, before=False):
        """The rows with their nodes' sizes and how many shingles a node can share with another node
        of these rows whose keys reach at least as far: all but its single keys that are not among
        them. With ``before``, also the few combinations before each."""
        counts = some.groupBy("node").agg(F.sum(F.col("single").cast("int")).alias("shared"))
        reach = counts.join(sizes, "node").select(
            "node", "n", "singles", "end", (F.col("n") - F.col("singles") + F.col("shared")).alias("reach"))
        rows = some.join(reach, "node")
        if before:
            few = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
            rows = rows.where("single").withColumn("before", F.lit(None).cast("array<bigint>")).unionByName(
                rows.where("not single").withColumn("before", few))
        return written(rows, name)

    def enough(pairs):
        """Distinct pairs of different nodes among rows (l, r) that share enough keys."""
        pairs = pairs.where(_fits(F.col("l.n"), F.col("r.n"), percent))
        reach = _binding("l", "r", F.col("l.reach"), F.col("r.reach"), F.least, F.greatest)
        pairs = pairs.where(reach >= _common(F.col("l.n"), F.col("r.n"), percent))
        pairs = pairs.select(
            F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"),
            F.col("single").cast("int").alias("single"), _least_shared("l", "r", percent).alias("enough"))
        pairs = pairs.groupBy("a", "b").agg(F.sum("single").alias("n"), F.first("enough").alias("enough"))
        return pairs.where("n >= enough").select("a", "b")

    def meeting(left, right, apart):
        """Pairs of the rows that meet at a key."""
        apart_from = ("key", "single", "hot")
        one, other = (x.select("key", "single", F.struct(*[c for c in x.columns if c not in apart_from]).alias(n))
                      for x, n in ((left, "l"), (right, "r")))
        # two sets of frequent shingles share many combinations; where they share one of the last
        # few as well they have met there already, and the first they share is passed by none
        met = ~F.col("single") & F.coalesce(F.arrays_overlap("l.before", "r.before"), F.lit(False))
        return enough(one.join(other.drop("single"), "key").where(apart).where(~met))

    some = with_reach(keys, "shared", before=every_link)
    if every_link:
        links = _verified(meeting(some, some, "l.node < r.node"), rows, docs, words, percent, "links")
        drop(some)
    else:
        links = _verified(enough(_with_hubs(some)), rows, docs, words, percent, "near")
        drop(some)
        found = components(links)
        apart = keys.join(found.withColumnRenamed("component", "part"), "node", "left").withColumn(
            "part", F.coalesce("part", "node"))
        apart = _between(apart)
        apart = with_reach(apart, "apart", before=True)
        drop(keys, found)
        pairs = meeting(apart.where("minor"), apart, "l.part <> r.part and (not r.minor or l.node < r.node)")
        far = _verified(pairs, rows, docs, words, percent, "far")
        drop(apart)
        links = links.unionByName(far)

    found = components(links)
    nodes = rows
    rows = nodes.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(
        found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # documents without shingles have no node and stay alone
    least = rows.where(F.col("node").isNotNull()).groupBy("component").agg(
        F.min("doc_id").alias("component_id"))
    # a large component's rows are dealt to several tasks
    salt = F.pmod(F.xxhash64("doc_id", "node"), F.lit(SALTS)).cast("int")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", salt).join(least, ["component", "salt"], "left").withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    if not every_link:
        return rows.select("doc_id", "n_shingles", "component_id")
    copies = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    degree = ends.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
        F.sum("copies").alias("n_links"))
    return rows.join(degree, "node", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
