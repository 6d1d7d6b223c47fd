import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerlight.llm import topk


def brute(rows, k=10, every=100):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % every == 0:
            queries[i, len(v)] = min(v, queries.get((i, len(v)), v))
    out = []
    for (q, width), v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == width)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def result(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=lambda r: r[:3])


def vectors(spark, rows):
    full = [(i, v, 0, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, part string, v int").repartition(3)


def test_equals_brute_force_with_ties_and_small_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(301)]
    found = topk.top_k(vectors(spark, rows), part=600, block=32)
    assert result(found) == brute(rows)


def test_odd_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, None), (2, []), (3, [1.0, nan]), (4, [1.0, inf]), (5, [None, 1.0]),
            (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, -2.0]), (200, [1.0]), (8, [2.0]), (None, [1.0, 1.0]),
            (300, [1.0, 2.0, 3.0]), (0, [1.0, 2.0])]
    assert result(topk.top_k(vectors(spark, rows))) == [
        x for x in brute(rows)]
    assert topk.top_k(vectors(spark, [])).collect() == []


def test_large_components_rank_exactly(spark):
    rows = [(i, [float(10**6 * ((i * 7) % 13 - 6)), float(i % 5), 0.5]) for i in range(300)]
    wide = [(i, [2.0**40 * (i % 7 - 3), 2.0**41 * (i % 4), float(i)]) for i in range(230)]
    for some in (rows, wide):  # scores about and far beyond 64 bits
        want = [(q, r, v, s if abs(s) < 1 << 63 else None) for q, r, v, s in brute(some)]
        assert sorted(map(repr, result(topk.top_k(vectors(spark, some))))) == sorted(map(repr, want))


def test_parts_and_slices_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    want = result(topk.top_k(vectors(spark, rows)))
    monkeypatch.setattr(topk, "LEAST_PART", 512)
    monkeypatch.setattr(topk, "SLICE", 3)
    assert want == result(topk.top_k(vectors(spark, rows))) == brute(rows)


def test_beyond_all_bounds_raises(spark):
    with pytest.raises(Exception, match="too large"):
        topk.top_k(vectors(spark, [(0, [1e16, 1.0]), (1, [1.0, 1.0])])).collect()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 1000), st.integers(1, 12))
def test_block_search_keeps_the_best(n, width, seed, k):
    rng = np.random.default_rng(seed)
    rows, query = rng.integers(-3, 4, (n, width)), rng.integers(-3, 4, width)
    block = topk.Block(np.arange(n), rows)
    ids, scores = block.search(query, 0, k, None)
    want = sorted((-int(r @ query), i) for i, r in enumerate(rows) if i != 0)[:k]
    assert [(-s, i) for i, s in zip(ids[np.lexsort((ids, -scores))], scores[np.lexsort((ids, -scores))])] == want
