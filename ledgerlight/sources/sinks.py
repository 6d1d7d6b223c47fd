"""Result sinks: dated CSV exports and partitioned tables."""

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.operators.views import file_label


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's settings name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder all executors share")
    return folder


def export_csv(df: DataFrame, folder: str, name: str,
               date: datetime.date | None = None) -> str:
    """Write ``<folder>/<name>_YYYYMMDD.csv`` with a header and return that path."""
    day = (date or datetime.date.today()).strftime("%Y%m%d")
    path = f"{folder}/{file_label(name)}_{day}.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: str = "ano_referencia") -> str:
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
