import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import types as T

from ledgerlight.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()),
                      T.StructField("shard", T.StringType()), T.StructField("payload", T.StringType())])


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(parts)


def sample():
    long_ = "<p>copied é</p>" * 90
    rows = [(i, f"http://a/{i}", f"<html>{i}" + "x" * (i * 13 % 900)) for i in range(300)]
    rows += [(1000 + i, "http://c", long_) for i in range(7)] + [(1003, "http://d", long_)]
    rows += [(2000, "http://e", "short"), (2001, "http://e", "short"), (2002, None, None), (2003, "http://e", ""),
             (None, "http://n", long_), (None, None, None), (5000, "bad url\r\nX: y", "z" * 30_000),
             (1006, "http://c", long_)]
    return rows


def want(rows):
    top = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            top[raw] = max(i, top.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        other = top.get(raw)
        revisit = other is not None and i != other
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                    other if revisit else None))
    return sorted(out, key=str)


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


def test_round_trip(spark, tmp_path):
    rows, folder = sample(), f"{tmp_path}/a"
    manifest = warc.write_archives(pages(spark, rows), f"file://{folder}", shard_bytes=30_000, roll_bytes=9_000)
    back = warc.read_archives(spark, f"file://{folder}")
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in back.collect()), key=str) == want(rows)
    texts = {(r.page_id, r.url): bytes(r.payload) for r in back.collect() if r.record_type == "response"}
    assert texts[5, "http://a/5"] == rows[5][2].encode() and texts[2002, None] == b""
    assert any(url and url.startswith("bad%20url%0D%0A") for _, url in texts)
    listed = {r.file: r for r in manifest.collect()}
    held = files(folder)
    assert set(listed) == set(held) and len(held) > 5
    assert sum(r.records for r in listed.values()) == len(rows)
    assert all(hashlib.sha1(raw).hexdigest() == listed[name].sha1 and len(raw) == listed[name].bytes
               for name, raw in held.items())
    assert not [*Path(folder).glob("_temporary*")]
    # ids rise from file to file
    ids = [int(line.split(b": ")[1]) for name in sorted(held) for line in gzip.decompress(held[name]).split(b"\r\n")
           if line.startswith(b"WARC-Page-ID")]
    assert ids == sorted(ids)


def test_same_files_whatever_the_partitioning(spark, tmp_path):
    rows = sample()
    for name, order, parts in (("a", rows, 2), ("b", rows[::-1], 5)):
        warc.write_archives(pages(spark, order, parts), f"file://{tmp_path}/{name}", shard_bytes=30_000, roll_bytes=9_000)
    assert files(f"{tmp_path}/a") == files(f"{tmp_path}/b")


def test_unlisted_files_do_not_count(spark, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write_archives(pages(spark, sample()), f"file://{folder}")
    (Path(folder) / "shard-99999-00000.warc.gz").write_bytes(b"left over")
    assert warc.read_archives(spark, f"file://{folder}").count() == len(sample())


def test_broken_archives_raise(spark, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write_archives(pages(spark, sample()), f"file://{folder}")
    path = sorted(Path(folder).glob("*.warc.gz"))[0]
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception):
        warc.read_archives(spark, f"file://{folder}").collect()


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages(spark, []), f"file://{tmp_path}/a")
    assert warc.read_archives(spark, f"file://{tmp_path}/a").collect() == []


def test_id_ranges_divide_heavy_intervals(spark):
    rows = [(i, 10) for i in range(1000)] + [(10**12 + i, 10) for i in range(1000)] + [(77, 5000), (-(10**9), 10)]
    sizes = spark.createDataFrame(rows, "page_id long, bytes long")
    starts = warc.id_ranges(sizes, 2500)
    edges = [-(10**18), *starts, 10**18]
    loads = [sum(n for i, n in rows if a <= i < b) for a, b in zip(edges, edges[1:])]
    assert starts == sorted(set(starts)) and sum(loads) == sum(n for _, n in rows)
    assert sum(x > 2500 for x in loads) <= 1  # the id that is heavy by itself


def test_shards_by_binary_search(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        starts = [*range(-50, 10 * n - 50, 10)]
        ids = [None, -(1 << 63), (1 << 63) - 1, *range(-60, 200)]
        rows = spark.createDataFrame([(i,) for i in ids], "page_id long").withColumn(
            "shard", warc.shard_of("page_id", starts)).collect()
        assert [r.shard for r in rows] == [sum(i is not None and s <= i for s in starts) for i in ids]


def test_id_ranges_over_the_whole_width_of_ids(spark):
    rows = [(-(1 << 63), 10), ((1 << 63) - 1, 10), (None, 9999), *((i, 10) for i in range(500))]
    starts = warc.id_ranges(spark.createDataFrame(rows, "page_id long, bytes long"), 1000)
    edges = [-(1 << 63), *starts, 1 << 63]
    loads = [sum(n for i, n in rows if i is not None and a <= i < b) for a, b in zip(edges, edges[1:])]
    assert max(loads) <= 1000 and len(loads) < 12


def test_shards_of_the_query_roll(spark, tmp_path):
    """With the production parameters a shard is several files, the same under two partitionings."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    for name, parts in (("a", 3), ("b", 7)):
        warc.write_archives(table.repartition(parts), f"file://{tmp_path}/{name}")
    held = files(f"{tmp_path}/a")
    assert held == files(f"{tmp_path}/b") and len({n for n in held if n.startswith("shard-00000-")}) > 1


def test_shards_grow_with_the_input():
    assert warc.shard_size(0) == warc.shard_size(10**9) == warc.LEAST_SHARD
    assert warc.shard_size(10**14) == warc.MOST_SHARD and 10**14 / warc.shard_size(10**14) < 30_000
    assert warc.shard_size(10**12) == 10**12 // warc.SHARES
