import pytest

import corpus_pipeline as P
from ledgerlight.llm import fertility, jaccard_join, packing, toxicity
from ledgerlight.llm.common import table
from ledgerlight.llm.queries import BYTE_BPE, PIECES, oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "packing"]


def test_each_stage_acts_on_what_the_last_kept(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns

    def step(k, docs):
        P.STAGES[k][1](spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    kept = {r.doc_id for r in fertility.quality(docs, PIECES).where("kept").collect()}
    first = step(0, docs)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == kept and len(kept) < docs.count()
    clean = {r.doc_id for r in toxicity.score(first, toxicity.learn(first, table(spark, SF, "labels"))).where(
        "predicted = 0").collect()}
    second = step(1, first)
    assert second.columns == columns and {r.doc_id for r in second.collect()} == clean < kept
    single = {r.doc_id for r in jaccard_join.jaccard_join(second).where("doc_id = component_id").collect()}
    third = step(2, second)
    assert third.columns == columns and {r.doc_id for r in third.collect()} == single < clean
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in third.collect())
    fourth = step(3, third)
    assert fourth.agg({"length": "sum"}).first()[0] == packing.pack_documents(third, BYTE_BPE).agg(
        {"length": "sum"}).first()[0]
    assert P.run(spark, SF).count() == fourth.count()


def test_stages_take_small_batches(spark, docs, monkeypatch):
    name, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    pack_documents = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: asked.update(k) or pack_documents(*a, **k))
    before = spark.conf.get(name)
    try:
        for own, found in (("10000", "500"), ("2000", "500"), ("700", "700")):
            spark.conf.set(name, own)
            assert P.pack(spark, docs([(1, "a b", "en")]), SF).count() and spark.conf.get(name) == found
    finally:
        spark.conf.set(name, before)
    assert asked["block"] <= 1 << 20 and asked["remembered"] <= 50_000


def test_odd_rows(spark, docs, odd_rows, tmp_path):
    rows = docs(odd_rows)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
    assert {4} <= {r.doc_id for r in rows.collect()} <= {4, 7, None}


def test_empty_table(spark, docs, tmp_path):
    rows = docs([])
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
    assert rows.count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_one_row_of_each_group_stays(spark, docs):
    same = "one two three four five six seven eight nine ten eleven twelve"
    other = "a passage of its own that no other row holds in any form at all"
    rows = docs([(4, same, "en"), (4, same, "en"), (None, same, "en"), (None, same, "en"), (4, same.upper(), "en"),
                 (9, same + " thirteen", "en"), (None, other, "en"), (None, other, "en"), (5, other[::-1], "en"),
                 (5, "quite another text under the same id as the last one had", "en"), (6, None, "en"), (6, None, "en"),
                 (7, "", "en")])
    kept = sorted(((r.doc_id, r.text) for r in P.deduplicated(spark, rows, SF).collect()), key=repr)
    assert [r for r in kept if r[0] == 4][0][1].lower() == same
    assert kept == sorted([[r for r in kept if r[0] == 4][0], (None, other), (5, other[::-1]),
                           (5, "quite another text under the same id as the last one had"), (6, None), (6, None), (7, "")], key=repr)
