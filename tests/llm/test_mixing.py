"""The mix against a queue of finish times in plain Python."""

import hashlib
import math
import random
import re
from fractions import Fraction

import pytest

from ledgerlight.llm import mixing
from ledgerlight.llm.running import stretches, sums
from pyspark.sql import functions as F

NAMES = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, grp string, words int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "k", "z", "g", 4, 5) for i, t, s in rows], NAMES).repartition(3)


def brute_force(rows, weights=(5, 2, 1), repeats=3):
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    order = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n, x in sized if x == s) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:  # what is above is capped, and its excess shared again
        rest = budget - sum(target.values())
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in open_)) for s in open_}
        above = {s for s in open_ if share[s] >= repeats * sizes[s]}
        target |= {s: Fraction(repeats * sizes[s]) for s in above} if above else share
        open_ -= above or open_
    found = []
    for s in order:
        def luck(d):
            return (d[0] is not None, "" if d[0] is None else hashlib.md5(f"1:{d[0]}".encode()).hexdigest(), d[1])

        ahead, sent = 0, math.floor(target[s])
        for i, n, _ in sorted((d for d in sized if d[2] == s), key=luck):
            taken = sum(max(0, min(n, sent - ahead - e * sizes[s])) for e in range(repeats))
            found.append((i, n, sizes[s], float(target[s]), taken))
            ahead += n
    return sorted(found, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def words(r, n):
    return " ".join(f"w{r.randrange(99)}" for _ in range(n))


@pytest.fixture
def rows():
    r = random.Random(2)
    rows = [(i, words(r, r.randrange(1, 60)), "hot") for i in range(400)]
    rows += [(1000 + i, words(r, r.randrange(1, 30)), f"s{i % 9}") for i in range(200)]
    rows += [(3000, words(r, 5000), "long"), (None, "no id here", "s1"), (None, None, None), (5, "a  b\tc", None)]
    rows += [(6, None, "s2"), (7, " \n", "empty"), (8, "", "empty"), (9, "x\x1cy z w", "")]
    return rows + [(77, "the same row", "s3")] * 30


def test_taken_against_brute_force(spark, rows):
    found = result(mixing.mix_sources(table(spark, rows)).taken())
    assert found == brute_force(rows)
    assert found == result(mixing.mix_sources(table(spark, rows).repartition(11)).taken())


def test_other_weights_and_repeats(spark, rows):
    found = result(mixing.mix_sources(table(spark, rows), (7, 3), 2).taken())
    assert found == brute_force(rows, (7, 3), 2)


def test_mix_runs_in_finish_order_without_gaps(spark, rows):
    mix = mixing.mix_sources(table(spark, rows))
    entries = sorted(mix.entries.collect(), key=lambda e: e["position"])
    at = 0
    for e in entries:
        assert e["position"] == at and e["words"] > 0
        at += e["words"]
    assert [e["finish"] for e in entries] == sorted(e["finish"] for e in entries)
    sizes = {(r["source"], r["source_size"], r["target"]) for r in mix.documents.collect()}
    budget = sum(s[1] for s in sizes)
    assert budget - len(sizes) < at <= budget
    taken = {}
    for e in entries:
        taken[e["source"]] = taken.get(e["source"], 0) + e["words"]
    assert all(abs(taken.get(s, 0) - target) < 1 for s, _, target in sizes)
    # all sources are served side by side: ahead of any cut they keep their proportions
    assert all(e["epoch"] < 3 for e in entries)


def test_empty(spark, rows):
    assert mixing.mix_sources(table(spark, rows).where("doc_id < 0")).taken().collect() == []
    assert result(mixing.mix_sources(table(spark, [(1, None, "a"), (2, "", None)])).taken()) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_running_sums_of_a_hot_group(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 11).alias("n")).repartition(6)
    table = stretches(rows, F.col("g"), [F.col("id")], F.col("n"), "t")
    firsts = sums(table, "s").select("grp", "part", "first")
    found = table.join(firsts, ["grp", "part"]).collect()
    assert len(found) == 5000
    total = {}
    for r in sorted(found, key=lambda r: r["id"]):
        assert r["first"] + r["before"] == total.get(r["grp"], 0)
        total[r["grp"]] = total.get(r["grp"], 0) + r["n"]
