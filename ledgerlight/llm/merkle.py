"""Merkle manifest of a dataset: a postorder append log for each language, and proofs out of it.

A document is a leaf; the leaves of a language stand in the order of their ids; every eight nodes
in a row are hashed into one until one is left, and the languages' roots are leaves of a tree of
their own. Aligned builders each take ``BLOCK`` leaves that start at a multiple of it, a power of
eight, and append nodes to a log in the order in which they are complete: leaves as they come, an
inner node right after the last leaf below it. The roots of the blocks are the leaves of the next
round, so no task holds more than a block and there are few rounds.

In such a log a node's place follows from the sizes of the complete subtrees before it
(``position``), so nothing is searched: a proof reads the siblings of each level at their computed
places. Logs are kept as tables, a segment for each block; a proof is put together from the segment
of the leaf and those of the rounds above.
"""

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.common import arrow_map, written
from ledgerlight.llm.running import stretches, sums

ARITY = 8
#: Levels and leaves of a builder's block.
LEVELS = 3
BLOCK = ARITY**LEVELS
_DIGEST = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(leaves: int) -> int:
    """Levels above the leaves; a single leaf is its own root."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of node ``index`` of ``level`` over so many leaves.

    Ahead of the last leaf below the node stand complete subtrees alone: for each base-eight digit
    of that leaf's number as many of the digit's height, each of 1 + 8 + ... nodes. Behind the leaf
    its ancestors follow level by level.
    """
    last = min((index + 1) * ARITY**level, leaves) - 1
    place, size = level, 1
    while last:
        last, digit = divmod(last, ARITY)
        place += digit * size
        size = size * ARITY + 1
    return place


def digest_of(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def build(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes in the order in which they are complete, up to ``levels`` above the leaves."""
    log, open_ = [], [[] for _ in range(levels + 1)]

    def close(level):
        log.append(digest_of(open_[level]))
        open_[level] = []
        open_[level + 1].append(log[-1])

    for leaf in leaves:
        log.append(leaf)
        open_[0].append(leaf)
        level = 0
        while level < levels and len(open_[level]) == ARITY:
            close(level)
            level += 1
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def siblings(log: bytes, index: int, leaves: int, levels: int):
    """(place in its run, digests of the run's other nodes) of a leaf and its ancestors."""
    for level in range(levels):
        of_level = -(-leaves // ARITY**level)
        first = index - index % ARITY
        places = (position(level, x, leaves) for x in range(first, min(first + ARITY, of_level)) if x != index)
        yield index - first, [log[p * _DIGEST:(p + 1) * _DIGEST] for p in places]
        index //= ARITY


def pack_path(steps) -> bytes:
    return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in steps)


def unpack_path(path: bytes):
    at = 0
    while at < len(path):
        n = path[at + 1]
        body = path[at + 2:at + 2 + n * _DIGEST]
        yield path[at], [body[k:k + _DIGEST] for k in range(0, len(body), _DIGEST)]
        at += 2 + n * _DIGEST


def fold(digest: bytes, steps) -> bytes:
    """The root that follows from a node and its siblings."""
    for at, others in steps:
        digest = digest_of(others[:at] + [digest] + others[at:])
    return digest


def _levels(leaves: int, total: int) -> int:
    """Levels of a segment: all of them where the group has one block alone."""
    return LEVELS if total > BLOCK else height(leaves)


def _build(batches):
    for batch in batches:
        logs, roots = [], []
        for leaves, total in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            log = build(leaves, _levels(len(leaves), total))
            logs.append(b"".join(log))
            roots.append(log[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(logs, pa.binary()), pa.array(roots, pa.binary())], ["doc_id", "log", "root"])


def _segments_paths(batch):
    """For each row of (carried, log, count, total, path) the paths of its leaves."""
    log, count, total, path = (batch.column(i).to_pylist() for i in range(1, 5))
    for one, n, whole, above in zip(log, count, total, path):
        levels = _levels(n, whole)
        yield one, [(list(siblings(one, i, n, levels)), above) for i in range(n)]


def _paths(batches):
    for batch in batches:
        found = [[pack_path(steps) + above for steps, above in rows] for _, rows in _segments_paths(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "paths"])


def _verdicts(batches):
    """Proof digest and folded root of each leaf; the leaf is replaced where it was tampered with."""
    for batch in batches:
        proofs, roots = [], []
        changed = batch.column(5).to_pylist()
        for (log, rows), tampered in zip(_segments_paths(batch), changed):
            proofs.append([])
            roots.append([])
            above = list(unpack_path(rows[0][1])) if rows else []
            for i, (steps, _) in enumerate(rows):
                steps = steps + above
                proofs[-1].append(digest_of([x for _, others in steps for x in others]).hex())
                place = position(0, i, len(rows)) * _DIGEST
                leaf = log[place:place + _DIGEST] if tampered[i] is None else tampered[i]
                roots[-1].append(fold(leaf, steps).hex())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(proofs, pa.list_(pa.string())), pa.array(roots, pa.list_(pa.string()))],
            ["doc_id", "proofs", "roots"])


@dataclass(frozen=True)
class Log:
    """Rounds of segments from the leaves up: grp, block, total (leaves of the group in this round),
    count (of the segment), members (index, leaf and what was carried), log, root."""

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        """grp and root, a row for each group."""
        return self.rounds[-1].select("grp", "root")

    def down(self, above: DataFrame, name: str) -> DataFrame:
        """The segments of the lowest round with the path over them, given a path for each group.

        ``above`` has grp, path and further columns, which go along.
        """
        last = self.rounds[-1].join(above, "grp")
        for k, lower in enumerate(reversed(self.rounds[:-1])):
            carried = [c for c in above.columns if c != "path"]
            found = arrow_map(
                last.select(F.struct("members", *carried).alias("row"), "log", "count", "total", "path"),
                _paths, "doc_id *, paths array<binary>")
            each = found.select("doc_id.*", "paths").select(
                *carried, F.inline(F.arrays_zip(F.col("members.index").alias("block"), F.col("paths").alias("path"))))
            last = lower.join(written(each, f"{name}-paths-{k}"), ["grp", "block"])
        return last


def log_of(leaves: DataFrame, most: int, carried: list[str], name: str) -> Log:
    """Builds the logs of all groups from grp, index, total, leaf and carried columns.

    ``most`` is the largest group's number of leaves.
    """
    rounds = []
    nodes = leaves
    while True:
        member = F.struct("index", "leaf", *carried)
        blocks = nodes.groupBy("grp", F.expr(f"index div {BLOCK}").alias("block")).agg(
            F.first("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members"))  # BLOCK at most
        row = F.struct("grp", "block", "total", F.size("members").alias("count"), "members")
        built = arrow_map(blocks.select(row.alias("row"), F.col("members.leaf").alias("leaves"), "total"),
                          _build, "doc_id *, log binary, root binary")
        rounds.append(written(built.select("doc_id.*", "log", "root"), f"{name}-log-{len(rounds)}"))
        most = -(-most // BLOCK)
        if most <= 1:
            return Log(rounds)
        nodes = rounds[-1].select("grp", F.col("block").alias("index"),
                                  F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("root").alias("leaf"))
        carried = []


def numbered(rows: DataFrame, group: Column, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """The rows with grp, index and total, and the largest total."""
    table = stretches(rows, group, order, F.lit(1).cast("long"), name)
    parts = sums(table, f"{name}-sums")
    total = F.sum("size").over(Window.partitionBy("grp"))
    parts = written(parts.select("grp", "part", "first", total.alias("total")), f"{name}-parts")
    most = parts.agg(F.max("total")).first()[0] or 0
    found = table.join(parts, ["grp", "part"]).withColumn("index", F.col("first") + F.col("before"))
    return found.drop("part", "size", "before", "first"), most


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c), F.lit(":"), c))


def _leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def manifest(docs: DataFrame, fields=("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id",
             group: str = "lang", tampered: Column | None = None, text: str = "text") -> DataFrame:
    """One row for each document with its leaf, the roots and what its proof says.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings in order), folded_root (from
    the siblings and the leaf, tampered with where ``tampered`` is true, which lower-cases A-Z of the
    text), verified, and position, the place of the leaf in its language's log. Leaves of a language
    ascend by id, null ids first, equal ids by leaf; repeated rows are leaves of their own. A null
    language is a group of its own ahead of the empty one. A row whose id is null is not tampered
    with where ``tampered`` is null. Fields may be null; no row gives an empty result. Further
    columns are ignored.
    """
    columns = [F.col(c) for c in fields]
    changed = [F.translate(F.col(c).cast("string"), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    lang = F.col(group).cast("string")
    leaves = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("key"),
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("branch"),
        _leaf(columns).alias("leaf"), F.when(F.lit(False) if tampered is None else tampered, _leaf(changed)).alias("tampered"))
    leaves, most = numbered(written(leaves, "leaves"), F.col("branch"), [F.col(c) for c in ("doc_id", "leaf", "key")], "numbered")
    log = log_of(leaves, most, ["doc_id", "tampered"], "leaves")

    tops, n = numbered(log.roots().withColumnRenamed("grp", "branch"), F.lit(""), [F.col("branch")], "branches")
    top = log_of(tops.withColumnRenamed("root", "leaf"), n, ["branch"], "top")
    above = top.roots().withColumn("path", F.lit(b""))
    found = top.down(above.select("grp", "path", F.col("root").alias("top")), "top")
    found = arrow_map(found.select(F.struct("members", "top").alias("row"), "log", "count", "total", "path"),
                      _paths, "doc_id *, paths array<binary>").select("doc_id.*", "paths")
    found = found.select("top", F.inline(F.arrays_zip(
        F.col("members.branch").alias("grp"), F.col("members.leaf").alias("subroot"), F.col("paths").alias("path"))))

    held = log.down(written(found, "branch-paths"), "leaf")
    kept = F.struct("members", "block", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("top")).alias("root"))
    judged = arrow_map(
        held.select(kept.alias("row"), "log", "count", "total", "path", F.col("members.tampered").alias("tampered")),
        _verdicts, "doc_id *, proofs array<string>, roots array<string>").select("doc_id.*", "proofs", "roots")
    judged = judged.select("subroot", "root", F.inline(F.arrays_zip(
        F.col("members").alias("member"), F.col("proofs").alias("proof_sha256"), F.col("roots").alias("folded_root"))))
    return judged.select(
        F.col("member.doc_id").alias("doc_id"), F.lower(F.hex("member.leaf")).alias("leaf"), "subroot", "root",
        "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
        _place(F.col("member.index")).alias("position"))


def _place(index: Column) -> Column:
    """``position`` of a leaf, in JVM arithmetic: its number and all complete inner nodes before it."""
    bits = ARITY.bit_length() - 1
    return sum((F.shiftright(index, k) for k in range(bits, 63, bits)), index)
