"""From raw documents to packed training sequences, in stages over the operators of ``llm``.

Each stage works on all rows its predecessor kept and returns the columns of ``documents``; the
last returns the packed pieces. Filters carry each row whole past the operator, so nothing is
joined back by id.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import fertility, jaccard_join, packing, toxicity
from ledgerlight.llm.common import batch_rows, new_folder, table, written
from ledgerlight.llm.queries import BYTE_BPE, PIECES, piece_digests

#: Rows of a batch between Spark and Python. Executors keep memory from stage to stage, so all stages
#: take smaller batches than an operator alone; they carry each text twice, too.
BATCH = 500


def _in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        batch_rows(spark, BATCH)
        return stage(spark, docs, sf_dir)
    return run


def _with_row(docs: DataFrame) -> DataFrame:
    """The whole row as one column, beside what an operator reads."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")


@_in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the fertility bands keep."""
    judged = fertility.quality(_with_row(docs), PIECES, doc_id="row")
    return judged.where("kept").select("doc_id.*")


@_in_small_batches
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not score as toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_with_row(docs), model, doc_id="row").where("predicted = 0").select("doc_id.*")


@_in_small_batches
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A row is told by its id and a hash of all it holds. Rows without an id are copies like any, and
    stay only where no row of their group has one; of a row that is repeated whole one stays. Texts
    without words are no copies of anything.
    """
    digest = F.xxhash64(*docs.columns)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", digest.alias("digest"))
    keyed = docs.withColumn("_row", row)
    groups = jaccard_join.jaccard_join(keyed, doc_id="_row")
    judged = groups.where("n_shingles > 0").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("component_id").alias("stays"))
    judged = judged.where(~F.col("doc_id").eqNullSafe(F.col("stays")) | (F.col("n") > 1)).select(
        F.xxhash64("doc_id").alias("_key"), F.col("doc_id").eqNullSafe(F.col("stays")).alias("again"))
    judged = written(judged, "judged")
    keyed = docs.withColumn("_key", F.xxhash64(row))
    once = keyed.join(judged, "_key", "left_anti")
    # rows repeated whole; a table of its own, so its size is known
    again = written(judged.where("again").select("_key"), "repeated")
    again = keyed.join(again, "_key").dropDuplicates(["_key"])
    return once.unionByName(again).select(*docs.columns)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document that is left."""
    # workers hold what earlier stages left of the executor's memory
    return piece_digests(packing.pack_documents(docs, BYTE_BPE, remembered=50_000, block=1 << 20))


STAGES = [
    ("quality rules", quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", deduplicated),
    ("packing", pack),
]

#: Learned scores and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a table the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
