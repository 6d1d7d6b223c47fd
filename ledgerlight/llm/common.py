"""Helpers the operators share: reading, cutting lineage, Arrow batches."""

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests, and
    only where all of Spark runs on this machine."""
    with contextlib.suppress(AnalysisException):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder:
            return folder.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.mkdtemp(prefix="ledgerlight-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/ledgerlight/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and the table
    survives the loss of any executor. An empty schema-only table reads back as such."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    # small row groups: a task holds one of them whole, with long texts in it
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again: what was made from them is
    written itself, so no lineage leads back to them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a row group of the tables written between steps.
ROW_GROUP = 16 << 20
#: Rows of a batch between Spark and Python; texts are long, and a batch stands in memory on either
#: side. A session that sets its own number keeps it.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped = {}


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Batches of so many rows from now on, unless the session set its own number."""
    if spark.conf.get(_BATCH) in ("10000", str(BATCH_ROWS)):  # Spark's own, ours
        spark.conf.set(_BATCH, str(rows))


def ship(spark: SparkSession) -> None:
    """Sends these modules to the executors, which need not have the package installed."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    here = Path(__file__).parent
    if "zip" not in _shipped:
        _shipped["zip"] = f"{tempfile.mkdtemp(prefix='ledgerlight-')}/ledgerlight.zip"
        with zipfile.ZipFile(_shipped["zip"], "w") as file:
            file.writestr("ledgerlight/__init__.py", "")
            for path in sorted(here.glob("*.py")):
                file.write(path, f"ledgerlight/llm/{path.name}")
    context.addPyFile(_shipped["zip"])
    _shipped["to"] = context.applicationId


_loaded, _worker = {}, {}


def loaded(kind, path):
    """One object of a kind for each file in a worker process, kept from task to task."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _release():
    """Gives freed memory back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _tidy(run, name):
    """``run`` in a worker that lets go what another operator left, and what each batch took."""
    def each(batches):
        for batch in batches:
            yield batch
            del batch
            _release()

    def tidied(batches):
        if _worker.get("runs") != name:
            _worker["runs"] = name
            _loaded.clear()
            gc.collect()
            _release()
        yield from run(each(batches))

    return tidied


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of these modules.

    A first column written as ``doc_id *`` has the type of the input's first column, whatever that
    is: a caller may carry a whole row there as a struct.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == "10000":  # Spark's own
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    fields = []
    if schema.startswith("doc_id *"):
        fields.append(T.StructField("doc_id", df.schema[0].dataType))
        schema = schema.removeprefix("doc_id *").lstrip(", ")
    return df.mapInArrow(_tidy(run, f"{run.__module__}.{run.__qualname__}"), T.StructType(fields + T.StructType.fromDDL(schema).fields))


def picked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text alone; whatever else the rows hold cannot clash."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may stand over bytes of its own
        lengths = np.diff(offsets) * column.is_valid().to_numpy(zero_copy_only=False)
        if lengths.sum() != offsets[-1] - offsets[0]:
            parts = [data[a:a + n] for a, n in zip(offsets[:-1], lengths)]
            data = np.concatenate(parts) if parts else data
            return data, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of at most ``limit`` bytes, or one row that is larger."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
