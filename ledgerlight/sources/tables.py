"""The twelve filing tables, from a folder of Parquet, a catalog, or built frames."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ledgerlight import schemas as S


@dataclass(frozen=True)
class FilingTables:
    registry: DataFrame
    indicators: DataFrame
    balance: DataFrame
    income: DataFrame
    chart: DataFrame
    account_balances: DataFrame
    risk: DataFrame | None
    neaf_indications: DataFrame
    neaf_scores: DataFrame
    equation: DataFrame
    variations: DataFrame
    benchmark: DataFrame | None


# Field -> warehouse table name
NAMES = {
    "registry": S.REGISTRY, "indicators": S.INDICATORS, "balance": S.BALANCE,
    "income": S.INCOME, "chart": S.CHART, "account_balances": S.ACCOUNT_BALANCES,
    "risk": S.RISK, "neaf_indications": S.NEAF_INDICATIONS, "neaf_scores": S.NEAF_SCORES,
    "equation": S.EQUATION, "variations": S.VARIATIONS, "benchmark": S.BENCHMARK,
}
OPTIONAL = {"risk", "benchmark"}


def read_folder_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table under ``folder`` with its declared schema."""
    return spark.read.schema(S.SCHEMAS[table]).parquet(f"{folder}/{table}")


def read_catalog_table(spark: SparkSession, database: str, table: str) -> DataFrame | None:
    """One catalog table conformed to its declared schema, or None when it does not exist."""
    name = f"{database}.{table}"
    if not spark.catalog.tableExists(name):
        return None
    return S.conform(spark.table(name), table)


def from_folder(spark: SparkSession, folder: str) -> FilingTables:
    """Tables under ``folder``; the two with a computed fallback are None where it has none."""
    def read(field: str, table: str) -> DataFrame | None:
        if field in OPTIONAL and not _exists(spark, f"{folder}/{table}"):
            return None
        return read_folder_table(spark, folder, table)

    return FilingTables(**{f: read(f, t) for f, t in NAMES.items()})


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that Spark reads has the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def from_catalog(spark: SparkSession, database: str) -> FilingTables:
    """Catalog tables; only the two with a computed fallback may be missing."""
    found = {f: read_catalog_table(spark, database, t) for f, t in NAMES.items()}
    missing = [NAMES[f] for f, df in found.items() if df is None and f not in OPTIONAL]
    if missing:
        raise LookupError(f"missing in {database}: {', '.join(missing)}")
    return FilingTables(**found)


def field_names() -> list[str]:
    return [f.name for f in fields(FilingTables)]
