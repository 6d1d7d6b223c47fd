import random
import zlib
from collections import Counter, defaultdict

from ledgerlight.llm import sharding


def smallest_capacity(sizes, count):
    """The least greatest shard of a contiguous partition, by dynamic programming."""
    ahead = [0]
    for s in sizes:
        ahead.append(ahead[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(count):
        best = [0] + [min(max(best[j], ahead[i] - ahead[j]) for j in range(i))
                      for i in range(1, len(sizes) + 1)]
    return best[-1]


def check(rows, found, shards):
    assert len(found) == len(rows)
    slots = defaultdict(list)
    by_text = defaultdict(set)
    sent = Counter((d, t or "", t is None) for d, t, *_ in rows)
    crc = {zlib.crc32(t.encode()): t for _, t, _ in ((d, t or "", n) for d, t, *n in rows)}
    for r in found:
        text = crc[r.text_crc32]
        assert r.size == len(text.encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        if text:
            by_text[text].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(sent.values()) == len(found)


def test_shards_are_minimax_over_text_groups(docs):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(150)} " + "y" * rng.randrange(300)) for i in range(400)]
    rows += [(1000 + i, "copied " * 9) for i in range(30)]
    found = sharding.shard_documents(docs(rows), 7).collect()
    check(rows, found, 7)
    import hashlib
    sizes = Counter()
    for _, t in rows:
        sizes[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    ordered = [sizes[k] for k in sorted(sizes)]
    assert max(loads.values()) == smallest_capacity(ordered, 7)


def test_group_above_an_even_share_leaves_no_shard_empty(docs):
    rows = [(i, "hot copy " * 40) for i in range(200)] + [(900 + i, f"other {i}") for i in range(300)]
    found = sharding.shard_documents(docs(rows), 8).collect()
    check(rows, found, 8)
    assert {r.shard for r in found} == set(range(8))
    hot = {r.shard for r in found if r.doc_id < 200}
    assert len(hot) == 1


def test_odd_rows_and_empty_table(docs, odd_rows):
    found = sharding.shard_documents(docs(odd_rows), 16).collect()
    check(odd_rows, found, 16)
    assert sharding.shard_documents(docs([]), 16).collect() == []


def test_plan_has_no_python(docs):
    df = sharding.shard_documents(docs([(1, "a"), (2, "b")]), 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
