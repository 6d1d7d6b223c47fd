"""Registered queries of the operators; each applies one to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import (
    bpe, clustering, fertility, jaccard_join, langid, licences, merkle, mixing, packing, sharding, topk,
    toxicity, warc,
)
from ledgerlight.llm.common import new_folder, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), 75, 5)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.learn(docs))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)
    return piece_digests(pieces)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 10, 100)


OP7_SQL = """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
origins AS (
  SELECT payload_digest, max(page_id) AS origin FROM heads
  WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < origin THEN origin END AS refers_to
FROM heads LEFT JOIN origins USING (payload_digest)
"""


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), PIECES).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).select(
        "doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, tampered=third).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 bit by bit over the digits of the id, which are ASCII.
OP11_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, row_number() OVER () AS key,
         list_reduce(
           list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                                 lambda s, i: xor(s >> 1, (s & 1) * 3988292384))) AS crc,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body
  FROM documents),
leaves AS (
  SELECT key, doc_id, lang, sha256(head || body) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0
              THEN sha256(head || translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
              ELSE sha256(head || body) END AS shown
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY lang) AS cnt FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)),
         any_value(cnt + 7) // 8
  FROM nodes WHERE cnt > 1 GROUP BY lang, idx // 8),
tops AS (
  SELECT 0 AS level, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, digest,
         count(*) OVER () AS cnt
  FROM nodes WHERE cnt = 1),
top_nodes AS (
  SELECT level, idx, digest, cnt FROM tops
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value(cnt + 7) // 8
  FROM top_nodes WHERE cnt > 1 GROUP BY idx // 8),
sides AS (
  SELECT a.lang, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b
    ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.cnt > 1 GROUP BY ALL),
top_sides AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top_nodes a JOIN top_nodes b ON a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.cnt > 1 GROUP BY ALL),
climbed AS (
  SELECT key, lang, 0 AS level, idx, shown AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT c.key, c.lang, c.level + 1, c.idx // 8, sha256(s.l || c.digest || s.r), c.proof || s.l || s.r
  FROM climbed c JOIN sides s ON c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND c.idx = s.idx),
arrived AS (
  SELECT key, lang, digest, proof FROM climbed QUALIFY level = max(level) OVER (PARTITION BY key)),
risen AS (
  SELECT a.key, 0 AS level, t.idx, a.digest, a.proof, t.digest AS subroot
  FROM arrived a JOIN tops t ON a.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT c.key, c.level + 1, c.idx // 8, sha256(s.l || c.digest || s.r), c.proof || s.l || s.r, c.subroot
  FROM risen c JOIN top_sides s ON c.level = s.level AND c.idx = s.idx),
ended AS (
  SELECT * FROM risen QUALIFY level = max(level) OVER (PARTITION BY key))
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, ended.digest AS folded_root,
       ended.digest = top.digest AS verified
FROM placed JOIN ended USING (key), (SELECT digest FROM top_nodes WHERE cnt = 1) AS top
"""


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


_NEAREST = """a{n} AS (
  SELECT key, vec_id, any_value(v) AS v,
         min({{'far': CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT), 'k': k}}) AS best
  FROM kept, c{n} GROUP BY key, vec_id)"""
_MOVED = """s{n} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS mean
  FROM (SELECT best.k AS k, i, sum(v[i]) AS s, count(*) AS n
        FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
  GROUP BY k),
c{m} AS (SELECT c{n}.k, coalesce(mean, c) AS c FROM c{n} LEFT JOIN s{n} ON c{n}.k = s{n}.k)"""
OP12_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS key, vec_id,
         [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, vec_id, v) - 1 AS INTEGER) AS k, v AS c
  FROM (SELECT *, sha256('1:' || vec_id) AS h FROM kept) QUALIFY k < 16),
""" + ",\n".join(
    _NEAREST.format(n=n) + ("" if n == 3 else ",\n" + _MOVED.format(n=n, m=n + 1)) for n in range(4)) + """
SELECT vec_id, best.k AS cluster, best.far AS distance,
       CAST(sum(best.far) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.far) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON best.k = c3.k
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).taken()


OP13_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
         3 * source_size * (10 // weight) AS ends
  FROM sources),
ended AS (
  SELECT *, sum(most) OVER w * 10 + ends * (weights - sum(weight) OVER w) <= budget * 10 AS out
  FROM ordered WINDOW w AS (ORDER BY ends, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
planned AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, most, out,
         weight * (budget - sum(CASE WHEN out THEN most ELSE 0 END) OVER ()) AS rest,
         nullif(sum(CASE WHEN out THEN 0 ELSE weight END) OVER (), 0) AS of
  FROM ended),
targets AS (
  SELECT source, source_size,
         CASE WHEN out THEN CAST(most AS DOUBLE) ELSE CAST(rest AS DOUBLE) / CAST(of AS DOUBLE) END AS target,
         CASE WHEN out THEN most ELSE rest // of END AS sent
  FROM planned),
queued AS (
  SELECT sized.*, source_size, target, sent,
         sum(size) OVER (PARTITION BY sized.source ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)) NULLS FIRST,
                         doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, sent - ahead)) + greatest(0, least(size, sent - ahead - source_size))
            + greatest(0, least(size, sent - ahead - 2 * source_size)) AS BIGINT) AS taken
FROM queued
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_licences": op2_licences,
        "op3_sharding": op3_sharding,
        "op4_packing": op4_packing,
        "op5_bpe": op5_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_topk": op7_topk,
        "op8_warc": op8_warc,
        "op9_fertility": op9_fertility,
        "op10_langid": op10_langid,
        "op11_merkle": op11_merkle,
        "op12_clustering": op12_clustering,
        "op13_mixing": op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_topk": OP7_SQL,
        "op8_warc": OP8_SQL,
        "op11_merkle": OP11_SQL,
        "op12_clustering": OP12_SQL,
        "op13_mixing": OP13_SQL,
    }
