"""Frequencies, page totals, distributions and top lists over any result."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.joins import best_rows, best_rows_per
from ledgerlight.functions.quantiles import grouped_quantiles

HISTOGRAM_BINS = 30


def frequency(df: DataFrame, column: str, by: Sequence[str] = (), top: int | None = None,
              order: str = "count") -> DataFrame:
    """Rows per value, nulls left out, most frequent first or by value."""
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, column)
        .agg(F.count("*").alias("quantidade"))
    )
    by_value = [*[F.asc(c) for c in by], F.asc(column)]
    keys = by_value if order == "value" else [F.desc("quantidade"), *by_value]
    if by and top is not None:
        return best_rows_per(counted, by, keys, top)
    return best_rows(counted, keys, top)


def top_k(df: DataFrame, column: str, limit: int, ties: Sequence[str]) -> DataFrame:
    """Largest values, unreadable ones counted as 0; ``ties`` decide between equals."""
    value = N.to_number(F.col(column))
    return best_rows(df.withColumn(column, value),
                     [F.desc(column), *[F.asc_nulls_last(c) for c in ties]], limit)


def top_k_per(df: DataFrame, group: Sequence[str], column: str, limit: int,
              ties: Sequence[str]) -> DataFrame:
    value = N.to_number(F.col(column))
    return best_rows_per(df.withColumn(column, value), group,
                         [F.desc(column), *[F.asc_nulls_last(c) for c in ties]], limit)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted picker values of several columns, in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor"))
        for c in columns
    ]))
    return (
        df.select(pairs.alias("p")).select("p.*").where("valor IS NOT NULL")
        .distinct().orderBy("campo", "valor")
    )


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def kpi_overview(sectors: DataFrame) -> DataFrame:
    return sectors.agg(
        F.sum("qtd_empresas").alias("total_empresas"),
        F.avg("media_ativo_milhoes").alias("media_ativo"),
        F.avg("media_receita_milhoes").alias("media_receita"),
        F.avg("media_liquidez").alias("media_liquidez"),
        F.when(F.avg("media_liquidez") > 1, "Saudável").otherwise("Atenção").alias("situacao"),
    )


def kpi_high_risk(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("empresas_listadas"),
        _or_zero(F.avg("score_risco_total")).alias("score_medio"),
        F.count_if(F.col("prioridade_fiscalizacao") == 1).alias("prioridade_critica"),
        _or_zero(F.sum("ativo_milhoes")).alias("ativo_total_milhoes"),
    )


def kpi_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.agg(
        F.count("*").alias("contas_analisadas"),
        F.avg("qtd_empresas_usam").alias("media_empresas_conta"),
        F.sum("total_saldo_bilhoes").alias("total_saldo_bilhoes"),
        F.max("qtd_empresas_usam").alias("conta_mais_usada"),
    )


def kpi_neaf(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_empresas"),
        F.sum("qtd_total_indicios").alias("total_indicios"),
        F.avg("score_risco_neaf").alias("media_score"),
        F.count_if(F.col("classificacao_risco_neaf") == "CRÍTICO").alias("criticos"),
    )


def kpi_equation(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_inconsistencias"),
        F.avg("percentual_diferenca").alias("media_percentual"),
        F.count_if(F.col("classificacao_inconsistencia") == "Crítica").alias("criticas"),
        F.avg("score_risco_equacao").alias("media_score"),
    )


def kpi_variation(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_variacoes"),
        F.countDistinct("cnpj").alias("empresas_afetadas"),
        F.count_if(F.col("classificacao_variacao") == "Variação Extrema").alias("criticas"),
        F.avg(F.abs("variacao_percentual")).alias("variacao_media"),
    )


def kpi_benchmark(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_setores"),
        F.sum("qtd_empresas_setor").alias("total_empresas"),
        F.avg("media_liquidez_corrente_setor").alias("media_liquidez"),
        F.avg("media_margem_liquida_setor").alias("media_margem"),
    )


def _long(sectors: DataFrame, columns: Mapping[str, str], key: str) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(label).alias("indicador"), F.col(c).cast("double").alias("valor"))
        for label, c in columns.items()
    ]))
    return sectors.select(key, pairs.alias("p")).select(key, "p.*")


def indicator_stats(sectors: DataFrame, columns: Mapping[str, str] = R.SECTOR_COLUMNS,
                    key: str = "setor") -> DataFrame:
    """Mean, median, sample deviation, maximum and outer deciles over the listed sectors.

    Quantiles are found by counting (``grouped_quantiles``); no task holds an indicator's values.
    """
    value = F.col("valor")
    values = _long(sectors, columns, key)
    found = _quantile_table(values, {"mediana": 0.5, "p10": 0.1, "p90": 0.9})
    means = values.groupBy("indicador").agg(
        F.avg(value).alias("media"),
        F.stddev_samp(value).alias("desvio_padrao"),
        F.max(value).alias("maximo"),
    )
    return means.join(F.broadcast(found), "indicador", "left").select(  # a row for each given column
        "indicador", "media", "mediana", "desvio_padrao", "maximo", "p10", "p90")


def _quantile_table(values: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """indicador and a column for each share; one row for each indicator with a value."""
    found = grouped_quantiles(values, "indicador", "valor", list(shares.values()))
    rows = [(name, *some) for name, some in sorted(found.items())]
    return values.sparkSession.createDataFrame(
        rows, ", ".join(["indicador string", *(f"{c} double" for c in shares)]))


def indicator_histogram(sectors: DataFrame, columns: Mapping[str, str] = R.SECTOR_COLUMNS,
                        key: str = "setor", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins between the least and greatest value of each indicator."""
    values = _long(sectors, columns, key).withColumn("valor", _or_zero(F.col("valor")))
    bounds = values.groupBy("indicador").agg(F.min("valor").alias("lo"), F.max("valor").alias("hi"))
    low, high = F.col("lo"), F.col("hi")
    place = F.floor((F.col("valor") - low) * bins / F.nullif(high - low, F.lit(0.0)))
    counted = (
        values.join(bounds, "indicador")
        .withColumn("faixa", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
        .groupBy("indicador", "faixa", "lo", "hi")
        .agg(F.count("*").alias("quantidade"))
    )
    width = (high - low) / bins
    return counted.select(
        "indicador", "faixa", "quantidade",
        (low + F.col("faixa") * width).alias("inicio"),
        (low + (F.col("faixa") + 1) * width).alias("fim"),
    )


def indicator_box(sectors: DataFrame, columns: Mapping[str, str] = R.SECTOR_COLUMNS,
                  key: str = "setor") -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers and number of outliers per indicator."""
    values = _long(sectors, columns, key).withColumn("valor", _or_zero(F.col("valor")))
    q1, q3 = F.col("q1"), F.col("q3")
    boxes = _quantile_table(values, {"q1": 0.25, "mediana": 0.5, "q3": 0.75}).select(
        "indicador", "q1", "mediana", "q3",
        (q1 - (q3 - q1) * 1.5).alias("cerca_inferior"),
        (q3 + (q3 - q1) * 1.5).alias("cerca_superior"),
    )
    inside = F.col("valor").between(F.col("cerca_inferior"), F.col("cerca_superior"))
    names = ["indicador", "q1", "mediana", "q3", "cerca_inferior", "cerca_superior"]
    return values.join(F.broadcast(boxes), "indicador").groupBy(*names).agg(
        F.min(F.when(inside, F.col("valor"))).alias("minimo"),
        F.max(F.when(inside, F.col("valor"))).alias("maximo"),
        F.count_if(~inside).alias("atipicos"),
    )
