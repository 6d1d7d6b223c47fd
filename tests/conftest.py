import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlight import schemas as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows of a filing table from dicts; columns left out are null."""
    def build(name, rows):
        schema = S.SCHEMAS[name]

        def fit(field, value):
            if value is None:
                return None
            kind = field.dataType.simpleString()
            if kind.startswith("decimal"):
                return Decimal(str(value))
            if kind == "double":
                return float(value)
            if kind == "date":
                return datetime.date.fromisoformat(value)
            return value

        return spark.createDataFrame(
            [tuple(fit(f, r.get(f.name)) for f in schema) for r in rows], schema
        )

    return build
