import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from ledgerlight.llm import jaccard_join as J
from ledgerlight.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows, percent=75):
    """n_shingles, component and links of each row, over all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                if sets[i] != sets[j]:
                    links[i] += 1
                    links[j] += 1
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(s), ids.get(find(i)), n) for i, ((d, *_), s, n)
                   in enumerate(zip(rows, sets, links))), key=str)


def corpus(seed, n=160):
    """Texts with exact and near copies, shared passages and variants at the edge of similarity."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=40)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25 or not texts:
            texts.append(rng.choices(vocab, k=rng.randrange(1, 120)))
        elif kind < 0.4:
            texts.append(rng.choices(vocab, k=rng.randrange(0, 30)) + passage)
        elif kind < 0.5:
            texts.append(list(rng.choice(texts)))
        else:
            new = list(rng.choice(texts))
            for _ in range(max(1, int(len(new) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            texts.append(new[rng.randrange(0, 2):])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_equals_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        found = J.jaccard_join(docs(rows), every_link=True).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found), key=str) == want
        plain = J.jaccard_join(docs(rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in plain) == [x[:3] for x in sorted(want)]


def test_large_groups_around_the_threshold(docs):
    """Near copies of one text of which many pairs do not link, with frequent shingles."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        new = list(base)
        for _ in range(rng.randrange(0, 9)):
            new[rng.randrange(len(new))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(new)))
    found = J.jaccard_join(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [
        x[:3] for x in sorted(brute(rows))]


def test_texts_inside_longer_copies(docs):
    """Texts extended by 20 to 33 percent, alone and inside a group of near copies."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        base = [f"a{k}x{i}" for i in range(rng.randrange(20, 120))]
        more = int((len(base) - 4) * rng.uniform(0.2, 1 / 3))
        tail = [f"e{k}x{i}" for i in range(more)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + tail))]
        for _ in range(5 * (k % 3 == 0)):
            new = list(base)
            new[rng.randrange(len(new))] = f"n{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(new)))
    want = brute(rows)
    found = J.jaccard_join(docs(rows), every_link=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found), key=str) == want
    plain = J.jaccard_join(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in plain) == [x[:3] for x in sorted(want)]


def test_odd_rows_and_empty_table(docs, odd_rows):
    found = J.jaccard_join(docs(odd_rows), every_link=True).collect()
    want = brute(odd_rows)
    # a document without words is its own component
    want = sorted(((d, n, c if n else d, k) for d, n, c, k in want), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found), key=str) == want
    assert J.jaccard_join(docs([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.floats(0, 1), st.integers(0, 9))
def test_similar_sets_share_a_key(both, only_a, only_b, share, seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 1 << 63, both + only_a + only_b, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(tokens[:both + only_a]), np.unique(np.concatenate([tokens[:both], tokens[both + only_a:]]))
    frequent = np.packbits(rng.random(1 << J.CELL_BITS) < share)
    if 100 * both >= 75 * (both + only_a + only_b) and (only_a or only_b):
        ka, kb = J.index_keys(a, frequent, 75), J.index_keys(b, frequent, 75)
        assert np.intersect1d(ka[1], kb[1]).size
        # and as many single keys as the bound says
        common = -(-(len(a) + len(b)) * 75 // 175)
        bounds = [common - len(x) + k[0] for x, k in ((a, ka), (b, kb))]
        plain = [k[0] > len(x) - J.need(len(x), 75) for x, k in ((a, ka), (b, kb))]
        least = (min(bounds) if all(plain) else bounds[0] if plain[0] else bounds[1] if plain[1]
                 else max(bounds))
        assert np.intersect1d(ka[1][:ka[0]], kb[1][:kb[0]]).size >= least


def test_keys_stay_in_proportion():
    rng = np.random.default_rng(1)
    for n in (10, 100, 1000, 10_000):
        found = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        _, keys = J.index_keys(found, np.full(1 << J.CELL_BITS - 3, 255, np.uint8), 75)
        assert len(keys) < 4 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, c in found.items():
        groups.setdefault(c, set()).add(node)
    assert sorted(map(len, groups.values())) == [2, 40, 61]
    assert all(c in g for c, g in groups.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_keys_take_the_same_links(docs, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "BEFORE", 2)
    rows = corpus(7, 120)
    found = J.jaccard_join(docs(rows), every_link=True)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    assert sorted((tuple(r) for r in J.jaccard_join(docs(rows)).collect()), key=str) == [r[:3] for r in brute(rows)]


def test_repeated_rows_are_one_node(spark, docs):
    """Two near copies, each very often: one set a node, so one pair is compared."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i % 3, text + (" end" if i % 2 else ""), "en") for i in range(4000)]
    found = J.jaccard_join(docs(rows)).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(0, 0), (1, 0), (2, 0)} and sum(r["count"] for r in found) == 4000
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    held = docs(rows).select("doc_id", "text")
    nodes = J.arrow_map(held, J._nodes(5, 75, spark.sparkContext.broadcast(np.zeros(1 << J.CELL_BITS - 3, np.uint8))), J.NODES)
    ids = [r.node for r in nodes.select("node").distinct().collect()]
    pairs = spark.createDataFrame([(min(ids), max(ids))], links.schema)
    assert J._sets_of(pairs, nodes, held, 5).count() == 2
