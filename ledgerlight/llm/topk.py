"""Exact top-k inner product search by Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size. A block keeps, for each dimension, its vectors
sorted by that component. A query walks all lists at once, each from the end that suits the
sign of its component there: whoever appears is scored in full, and the components just reached
bound the score of everything not yet seen. The walk stops when that bound is below the query's
k-th score. Ties need no special case, because a bound that equals the k-th score does not stop it.

Blocks of one task are searched one after another, and a query takes the k-th score found so far
into the next one; a block whose first bound is below it is left unread. Queries stream past the
blocks, so a task holds one block group and one batch of queries. What the tasks found, k rows a
query each, is ranked at the end.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.llm.common import arrow_map, written

SCALE = 1024
#: Vectors of a block, and components of all vectors of a part.
BLOCK = 4096
PART = 1 << 22
#: Components of a part at least, where there are cores for more parts; queries of a slice.
LEAST_PART = 1 << 18
SLICE = 1 << 16
#: Components, after scaling, below which every score fits a decimal of 38 digits.
LARGEST = 1 << 58
_LONG = 1 << 63
#: Entries of each list read before the first look at the bound; doubled after each.
STEP = 8
FOUND = "query_id long, vec_id long, score decimal(38,0)"


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double, where all are finite numbers."""
    wide = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(wide) > 0) & F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("x"), usable.alias("usable"))
    return rows.where(F.col("usable") & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))


def _best(ids, scores, k):
    """The k best of both, equal scores by id."""
    if scores.dtype == object:
        keep = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


class Block:
    """Vectors sorted by id, and for each dimension their order by that component."""

    def __init__(self, ids, rows):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        # doubles hold integers below 2^53 exactly, and multiply faster
        self.most = most = int(np.abs(self.rows).max(initial=0))
        if most * most * self.rows.shape[1] < 1 << 53:
            self.rows = self.rows.astype(np.float64)
        self.lists = np.take_along_axis(self.rows.T, self.order, axis=1)

    def search(self, query, own, k, floor):
        """(ids, scores) that may be among the k best, given a k-th score already found."""
        n = len(self.ids)
        if n and int(np.abs(query).max()) * self.most * len(query) >= _LONG:
            # beyond 64 bits the whole lists are read, in Python's integers
            whole = [int(v) for v in query]
            scores = np.array([sum(a * int(b) for a, b in zip(whole, row)) for row in self.rows], dtype=object)
            other = self.ids != own
            return _best(self.ids[other], scores[other], k)
        used = np.flatnonzero(query)
        weight = query[used]
        up = weight > 0
        lists, order = self.lists[used], self.order[used]
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while True:
            edge = np.where(up, lists[:, n - 1 - depth], lists[:, depth]) if depth < n else None
            if edge is None or len(used) == 0 and depth:
                break
            if floor is not None and int(weight @ edge.astype(np.int64)) < floor:
                break
            end = min(n, depth + step) if len(used) else n
            if len(used):
                met = np.concatenate([order[up, n - end:n - depth].ravel(), order[~up, depth:end].ravel()])
            else:  # an all-zero query: every score is 0
                met = np.arange(n)
            met = np.unique(met[~seen[met]])
            seen[met] = True
            exact = self.rows.dtype if abs(query).max(initial=0) * self.most * len(query) < 1 << 53 else np.int64
            found = (self.rows[met].astype(exact) @ query.astype(exact)).astype(np.int64)
            other = self.ids[met] != own
            ids = np.concatenate([ids, self.ids[met][other]])
            scores = np.concatenate([scores, found[other]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
            depth, step = end, step * 2
        return ids, scores


def _search(k, size):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))])

    def blocks(ids, rows):
        # neighbours in the leading components share a block, so bounds differ between blocks
        order = np.lexsort(rows.T[:2][::-1])
        return [Block(ids[o], rows[o]) for o in np.array_split(order, -(-len(ids) // size))]

    def run(batches):
        groups, here, held = None, [], []  # candidates of a part come before its queries
        part = None
        for batch in batches:
            keys, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            values, width = batch.column(3), batch.column(4).to_numpy()
            out = [[], [], []]
            flat = values.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(width)])
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i] and kinds[j] == kinds[i]:
                    j += 1
                rows = flat[at[i]:at[j]].reshape(j - i, -1)
                if keys[i] != part:
                    part, here, held, groups = keys[i], [], [], None
                if kinds[i] == 0:
                    here.append(ids[i:j].copy())
                    held.append(rows.copy())
                else:
                    if groups is None:
                        groups = blocks(np.concatenate(here), np.concatenate(held)) if here else []
                        here, held = [], []
                    for query, own in zip(rows, ids[i:j]):
                        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                        for group in groups:
                            floor = int(best[-1]) if len(best) == k else None
                            more_ids, more = group.search(query, own, k, floor)
                            best_ids = np.concatenate([best_ids, more_ids])
                            best = np.concatenate([best, more])
                            best_ids, best = _best(best_ids, best, k)
                        out[0] += [int(own)] * len(best)
                        out[1] += best_ids.tolist()
                        out[2] += [Decimal(int(x)) for x in best]
                i = j
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = SCALE, part: int = PART,
          block: int = BLOCK) -> DataFrame:
    """For each vector whose id is divisible by ``every``, its k best among all others.

    Returns query_id, rank from 1, vec_id, score; equal scores rank the smaller id first. Vectors
    that are null or empty, or hold a null or a non-finite component, and rows without an id take
    no part. Vectors of different lengths do not meet. A row that repeats another's id is not its
    candidate; as a query it is asked once, with the smallest of its vectors. Scores rank exactly
    at any size; one that does not fit 64 bits is returned as null. A scaled component of 2^58 or
    more raises. Further columns are ignored.
    """
    rows = scaled(vectors, vec_id, vector, scale)
    sized = written(rows.select(
        "vec_id", F.when(F.forall("v", lambda x: F.abs(x) < LARGEST), F.col("v")).otherwise(
            F.raise_error("a scaled component is too large for exact scores")).alias("v"),
        F.size("v").alias("width")), "vectors")
    total, queries = sized.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    of = F.lit(total) * F.col("width")
    parts = F.greatest(F.ceil(of / part), F.least(F.lit(cores), F.ceil(of / LEAST_PART)))
    dealt = sized.withColumn("parts", parts.cast("int"))
    # each part's vectors meet every query; the queries are dealt, too, slice by slice
    slices = max(1, -(-queries // SLICE))
    candidates = dealt.withColumn("at", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        F.concat_ws("/", "width", "at", "slice").alias("part"), F.lit(0).alias("kind"), "vec_id", "v", "width")
    asked = dealt.where(F.col("vec_id") % every == 0)
    asked = asked.groupBy("vec_id", "width", "parts").agg(F.min("v").alias("v"))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"),
        F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"), "vec_id", "v", "width")
    asked = asked.select(F.concat_ws("/", "width", "at", "slice").alias("part"), F.lit(1).alias("kind"),
                         "vec_id", "v", "width")
    together = candidates.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "vec_id")
    found = arrow_map(together, _search(k, block), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
