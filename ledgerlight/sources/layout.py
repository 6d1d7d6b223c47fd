"""Tables laid out by company: bucketed and sorted, with bloom filters on the company key.

A join of two tables with the same number of buckets needs no exchange on either side, and a look-up
of one company reads one bucket, where the filters spare the row groups without it.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame

COMPANY = "cnpj"
#: Rows that a bucket should hold; the tables of a database need one number of buckets. A task sorts a
#: whole bucket, when it is written and when it is joined, and that is what a task holds in memory.
BUCKET_ROWS = 500_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that the buckets of a table that has grown divide evenly."""
    return 1 << max(0, -(-rows // bucket_rows) - 1).bit_length()


def write_by_company(df: DataFrame, table: str, path: str, buckets: int,
                     sort: Sequence[str] = ("ano_referencia",)) -> DataFrame:
    """Save ``df`` as the catalog table ``table`` under ``path`` and return it as read back.

    Rows are shuffled by the buckets first, so each bucket is one file.
    """
    order = [COMPANY, *[c for c in sort if c in df.columns]]
    writer = df.repartition(buckets, COMPANY).write.bucketBy(buckets, COMPANY).sortBy(*order)
    writer = writer.option("path", path).option(f"parquet.bloom.filter.enabled#{COMPANY}", "true")
    writer.format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
