"""The manifest against trees built level by level, and its log against a walk of the tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lowered=False):
    def field(name):
        v = row[name]
        if v is None:
            return "-"
        v = str(v)
        if lowered and name == "text":
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        return f"{len(v.encode())}:{v}"
    return h(*map(field, FIELDS))


def levels_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i:i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def path_of(levels, index):
    for level in levels[:-1]:
        first = index - index % 8
        run = level[first:first + 8]
        yield run[:index - first], run[index - first + 1:]
        index //= 8


def brute_force(rows):
    """Rows as the operator returns them, sorted."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = levels_of([leaf_of(r) for r in by_lang[lang]])
    top = levels_of([trees[x][-1][0] for x in langs])
    found = []
    for n, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            path = [*path_of(trees[lang], i), *path_of(top, n)]
            doc = r["doc_id"]
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            digest = leaf_of(r, bad)
            for left, right in path:
                digest = h(*left, digest, *right)
            found.append((doc, leaf_of(r), trees[lang][-1][0], top[-1][0],
                          h(*(x for left, right in path for x in (*left, *right))), digest, digest == top[-1][0]))
    return sorted(found, key=repr)


def third(docs):
    return merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def result(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512, 513, 700])
def test_positions_follow_completion(leaves):
    levels = merkle.height(leaves)
    log = merkle.build([hashlib.sha256(str(i).encode()).digest() for i in range(leaves)], levels)
    tree = levels_of([hashlib.sha256(str(i).encode()).hexdigest() for i in range(leaves)])
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for i, digest in enumerate(nodes):
            assert log[merkle.position(level, i, leaves)].hex() == digest


def test_paths_fold_to_the_root():
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(77)]
    levels = merkle.height(77)
    log = b"".join(merkle.build(leaves, levels))
    for i in (0, 7, 8, 63, 64, 72, 76):
        steps = list(merkle.siblings(log, i, 77, levels))
        assert merkle.fold(leaves[i], steps) == log[-32:]
        assert list(merkle.unpack_path(merkle.pack_path(steps))) == steps
        assert merkle.fold(leaves[i - 1], steps) != log[-32:]


def as_rows(docs):
    return [r.asDict() for r in docs.select(*FIELDS).collect()]


def test_odd_rows(docs, odd_rows):
    table = docs(odd_rows)
    assert result(third(table)) == brute_force(as_rows(table))


def test_several_blocks_and_many_languages(docs):
    r = random.Random(5)
    rows = [(i, f"Text {r.randrange(50)} Of Document", "en" if i % 3 else "x") for i in range(2600)]
    rows += [(i, f"Alone {i}", f"l{i:03d}") for i in range(600)]  # more languages than a block has leaves
    rows += [(i, "null language", None) for i in range(9)] + [(i, "empty", "") for i in range(2)]
    rows += [(77, "the same row", "en")] * 20
    r.shuffle(rows)
    table = docs(rows)
    found = third(table)
    assert result(found) == brute_force(as_rows(table))
    assert result(third(table.repartition(1))) == result(third(table.repartition(9)))
    # positions: leaf numbers and the inner nodes that are complete before them
    en = [x["position"] for x in found.where("subroot = '%s'" % found.where("doc_id = 77").first()["subroot"]).collect()]
    n = len(en)
    assert sorted(en) == [merkle.position(0, i, n) for i in range(n)]


def test_nothing_tampered_and_empty(docs):
    rows = docs([(1, "A", "en"), (2, None, "en")])
    assert {r["verified"] for r in merkle.manifest(rows).collect()} == {True}
    assert merkle.manifest(rows.where("doc_id < 0")).collect() == []
