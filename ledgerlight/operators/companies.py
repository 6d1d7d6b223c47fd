"""Per-company views: profile, latest filings, series and trends."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlight.functions import rules as R
from ledgerlight.functions.periods import month_label, months_of, year_of
from ledgerlight.schemas import RISK, SCHEMAS
from ledgerlight.sources.tables import FilingTables

CNPJ_LENGTH = 14


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                ties: Sequence[str] | None = None) -> DataFrame:
    """The last row of every key by ``order``, then by ``ties`` (all other columns unless named).

    Spark keeps one row per key inside each map task before the shuffle, so a key with very many
    rows is cut there. Columns that are neither used later nor named here are not read.
    """
    if ties is None:
        ties = [c for c in df.columns if c not in keys and c not in order]
    newest = Window.partitionBy(*keys).orderBy(
        *[F.desc_nulls_last(c) for c in (*order, *ties)]
    )
    place = F.row_number().over(newest)
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def overview_summary(registry: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct companies, years, sectors and states, and the latest period."""
    count = F.approx_count_distinct if approx else F.countDistinct
    return registry.where("ano_referencia > 0").agg(
        count("cnpj").alias("total_empresas"),
        count("ano_referencia").alias("total_anos"),
        F.max("ano_referencia").alias("ano_mais_recente"),
        count("cnae_divisao").alias("total_setores"),
        count("cd_uf").alias("total_estados"),
    )


def registry_at(registry: DataFrame, grain: str) -> DataFrame:
    """All registry periods of a company, or its latest."""
    if grain == "latest":
        return latest_rows(registry, ["cnpj"], ["ano_referencia"])
    if grain != "all":
        raise ValueError(f"registry grain is 'all' or 'latest': {grain!r}")
    return registry


def or_empty(table: DataFrame | None, name: str, spark: SparkSession) -> DataFrame:
    """A missing optional table as one without rows."""
    return spark.createDataFrame([], SCHEMAS[name]) if table is None else table


def company_profile(tables: FilingTables, cnpj: str | None = None) -> dict[str, DataFrame]:
    """Registry (latest row), indicators, balance, income and risk histories.

    Without ``cnpj`` the five frames hold all companies; with it each is one pushed filter.
    """
    if cnpj is not None and len(cnpj) != CNPJ_LENGTH:
        raise ValueError(f"a company key has {CNPJ_LENGTH} digits: {cnpj!r}")

    def newest(df: DataFrame, *order: str) -> DataFrame:
        # One company's rows are sorted for reading; a sort of whole tables is left to the user.
        if cnpj is None:
            return df
        return df.where(F.col("cnpj") == cnpj).orderBy(*[F.desc_nulls_first(c) for c in order])

    registry = tables.registry.where(
        F.length("cnpj") == CNPJ_LENGTH if cnpj is None else F.col("cnpj") == cnpj
    )
    return {
        "registry": latest_rows(registry, ["cnpj"], ["ano_referencia"]),
        "indicators": newest(tables.indicators, "ano_referencia"),
        "balance": newest(tables.balance, "ano_referencia", "data_fim_periodo"),
        "income": newest(tables.income, "ano_referencia", "data_fim_periodo"),
        "risk": newest(or_empty(tables.risk, RISK, tables.registry.sparkSession), "ano_referencia"),
    }


def latest_statement(statement: DataFrame, year: int | None = None) -> DataFrame:
    """Latest balance sheet or income statement of every company, with its month label."""
    if year is not None:
        statement = statement.where(months_of("ano_referencia", year))
    return latest_rows(statement, ["cnpj"], ["data_fim_periodo", "ano_referencia"]).withColumn(
        "mes", month_label("data_fim_periodo")
    )


def balance_series(balance: DataFrame, year: int | None = None) -> DataFrame:
    if year is not None:
        balance = balance.where(months_of("ano_referencia", year))
    return balance.select(
        "cnpj", "data_fim_periodo", "ativo_total", "passivo_total", "patrimonio_liquido"
    ).orderBy("cnpj", "data_fim_periodo")


def income_series(income: DataFrame, year: int | None = None) -> DataFrame:
    if year is not None:
        income = income.where(months_of("ano_referencia", year))
    return income.select(
        "cnpj", "data_fim_periodo", "receita_liquida", "custos_totais", "despesas_totais",
        "resultado_liquido",
    ).orderBy("cnpj", "data_fim_periodo")


def available_years(statement: DataFrame) -> DataFrame:
    """Years with a filing, newest first."""
    return statement.select(year_of("ano_referencia").alias("ano")).distinct().orderBy(
        F.desc("ano")
    )


def indicator_trend(indicators: DataFrame) -> DataFrame:
    """Four indicators in long form, by company and year."""
    names = ["liquidez_corrente", "endividamento_geral", "margem_liquida_perc",
             "roe_retorno_patrimonio_perc"]
    return (
        indicators.select("cnpj", F.col("ano_referencia").alias("ano"), *names)
        .unpivot(["cnpj", "ano"], names, "indicador", "valor")
        .orderBy("cnpj", "indicador", "ano")
    )


def risk_trend(risk: DataFrame) -> DataFrame:
    """Score history of companies with more than one risk row."""
    rows = F.count("*").over(Window.partitionBy("cnpj"))
    return (
        risk.withColumn("_rows", rows).where("_rows > 1")
        .select("cnpj", F.col("ano_referencia").alias("ano"), "score_risco_total",
                "score_equacao_contabil", "score_neaf")
        .orderBy("cnpj", "ano")
    )


def risk_components(risk: DataFrame) -> DataFrame:
    """Component scores of each company's latest risk row, in long form."""
    current = latest_rows(risk, ["cnpj"], ["ano_referencia"]).select(
        "cnpj", "ano_referencia",
        F.col("score_equacao_contabil").alias("Equação Contábil"),
        F.col("score_neaf").alias("NEAF"),
        F.col("score_risco_financeiro").alias("Risco Financeiro"),
    )
    return current.unpivot(["cnpj", "ano_referencia"],
                           ["Equação Contábil", "NEAF", "Risco Financeiro"],
                           "componente", "pontuacao")


def risk_bands(risk: DataFrame) -> DataFrame:
    """Band and alert of each company's latest risk row."""
    score = F.col("score_risco_total")
    return latest_rows(risk, ["cnpj"], ["ano_referencia"]).select(
        "cnpj", "ano_referencia", score, "classificacao_risco",
        R.risk_band(score).alias("faixa"), R.risk_alert(score).alias("alerta"),
        F.coalesce("qtd_indicios_neaf", F.lit(0)).cast("int").alias("indicios"),
    )
