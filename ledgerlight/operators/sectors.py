"""Sector aggregates, companies of a sector, company against sector, suspicious companies."""

from pyspark.sql import DataFrame, functions as F

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.joins import (
    attach_to_best, best_rows, best_rows_per, join_group_stats,
)
from ledgerlight.functions.periods import period_in_year, year_of
from ledgerlight.operators.companies import or_empty
from ledgerlight.schemas import RISK


def _in_year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else df.where(F.col("ano_referencia") == year)


def registry_by_year(registry: DataFrame, year: int | None = None) -> DataFrame:
    """Registry rows with YYYY in ``ano_referencia`` and YYYYMM in ``periodo_cadastro``."""
    if year is not None:
        registry = registry.where(period_in_year("ano_referencia", year))
    return registry.withColumn("periodo_cadastro", F.col("ano_referencia")).withColumn(
        "ano_referencia", year_of("ano_referencia")
    )


def _sector_aggregate(registry: DataFrame, indicators: DataFrame, year: int | None,
                      keys: list[str]) -> DataFrame:
    # A company files several registry rows a year and every one of them counts in the means.
    # They are counted first, so the join carries one weighted row instead of the copies.
    filed = (
        registry_by_year(registry, year)
        .select("cnpj", "ano_referencia", R.sector_label().alias("setor"))
        .groupBy("cnpj", "ano_referencia", "setor")
        .agg(F.count("*").alias("n"))
    )
    rows = filed.join(_in_year(indicators, year), ["cnpj", "ano_referencia"])
    n = F.col("n")

    def mean(name):
        return N.weighted_mean(F.col(name), n)

    return rows.groupBy(*keys).agg(
        F.countDistinct("cnpj").alias("qtd_empresas"),
        N.round2(mean("ativo_total") / N.MILLION).alias("media_ativo_milhoes"),
        N.round2(mean("receita_liquida") / N.MILLION).alias("media_receita_milhoes"),
        N.round2(mean("liquidez_corrente")).alias("media_liquidez"),
        N.round2(mean("endividamento_geral")).alias("media_endividamento"),
        N.round2(mean("margem_liquida_perc")).alias("media_margem_liquida"),
        N.round2(mean("roa_retorno_ativo_perc")).alias("media_roa"),
        N.round2(mean("roe_retorno_patrimonio_perc")).alias("media_roe"),
    )


def sector_indicators(registry: DataFrame, indicators: DataFrame, year: int | None = None,
                      limit: int | None = 50) -> DataFrame:
    """Company count and mean indicators per sector, largest sectors first."""
    sectors = _sector_aggregate(registry, indicators, year, ["setor"]).where("qtd_empresas > 0")
    return best_rows(sectors, [F.desc("qtd_empresas"), F.asc("setor")], limit)


def companies_by_sector(registry: DataFrame, indicators: DataFrame, risk: DataFrame | None,
                        sector: str | None = None, year: int | None = None,
                        limit: int | None = 200) -> DataFrame:
    """Largest companies of one sector, or of every sector, with their risk score.

    Without a risk table the score columns are null.

    The sector is the two-way label: a company with neither description belongs to none.
    """
    label = F.coalesce("cnae_divisao_descricao", "de_cnae")
    filed = registry_by_year(registry, year).withColumn("setor", label)
    filed = filed.where(F.col("setor").isNotNull() if sector is None else label == sector)
    rows = filed.select(
        "setor", "cnpj", "ano_referencia", "periodo_cadastro", "nm_razao_social",
        "nm_fantasia", "cd_uf", "empresa_grande_porte",
    ).join(
        _in_year(indicators, year).select(
            "cnpj", "ano_referencia", "ativo_total", "receita_liquida", "liquidez_corrente",
            "margem_liquida_perc",
        ),
        ["cnpj", "ano_referencia"],
    )
    scores = or_empty(risk, RISK, filed.sparkSession).select(
        "cnpj", "ano_referencia", "score_risco_total", "classificacao_risco")
    order = [F.desc_nulls_first("ativo_total"), F.asc("cnpj"), F.asc("periodo_cadastro")]
    scored = [F.asc_nulls_last("score_risco_total"), F.asc_nulls_last("classificacao_risco")]
    keys = ["cnpj", "ano_referencia"]
    if sector is not None:
        rest = [F.asc_nulls_last(c) for c in rows.columns]
        best = attach_to_best(rows, scores, keys, order + rest, limit, scored)
    else:
        best = best_rows_per(rows, ["setor"], order, limit).join(scores, keys, "left")
        best = best_rows_per(best, ["setor"], order + scored, limit)
    return best.select(
        "setor", "cnpj", "nm_razao_social", "nm_fantasia", "cd_uf", "empresa_grande_porte",
        N.millions(F.col("ativo_total")).alias("ativo_milhoes"),
        N.millions(F.col("receita_liquida")).alias("receita_milhoes"),
        N.round2(F.col("liquidez_corrente")).alias("liquidez"),
        N.round2(F.col("margem_liquida_perc")).alias("margem_liquida"),
        "score_risco_total", "classificacao_risco", "periodo_cadastro",
    )


def suspicious_companies(registry: DataFrame, indicators: DataFrame, risk: DataFrame | None,
                         indicator: str, year: int | None = None, limit: int | None = 100,
                         population: str = "filtered") -> DataFrame:
    """Companies beyond an indicator's threshold, with the sector mean and the gap to it.

    ``population="filtered"`` takes the mean over the suspicious rows of the sector, as the
    reported figure does; ``"sector"`` takes it over all rows of the sector.
    """
    column, beyond, ascending = R.SUSPICIOUS[indicator]
    value = F.col("indicador")
    measured = _in_year(indicators, year).select(
        "cnpj", "ano_referencia", F.col(column).alias("indicador"), "ativo_total",
        "receita_liquida",
    )
    filed = registry_by_year(registry, year).select(
        "cnpj", "ano_referencia", "periodo_cadastro", "nm_razao_social", "cd_uf",
        R.sector_label().alias("setor"),
    )
    keys = ["cnpj", "ano_referencia"]
    rows = measured.where(beyond(value)).join(filed, keys)
    counted = rows if population == "filtered" else measured.join(filed, keys)
    means = counted.groupBy("setor").agg(F.avg(value).alias("media"))
    scores = or_empty(risk, RISK, filed.sparkSession).select(
        "cnpj", "ano_referencia", "score_risco_total")

    rows = rows.withColumn("valor_indicador", N.round2(value))
    first = F.asc_nulls_last if ascending else F.desc_nulls_first
    order = [first("valor_indicador"), F.asc("cnpj"), F.asc("periodo_cadastro")]
    if limit is None:
        rows = join_group_stats(rows, means, ["setor"], "cnpj").join(scores, keys, "left")
        rows = rows.orderBy(*order)
    else:
        rest = [F.asc_nulls_last(c) for c in rows.columns]
        rows = attach_to_best(rows, scores, keys, order + rest, limit,
                              [F.asc_nulls_last("score_risco_total")])
        rows = rows.join(means, "setor").orderBy(*order)
    return rows.select(
        "cnpj", "nm_razao_social", "cd_uf", "setor", "valor_indicador",
        N.millions(F.col("ativo_total")).alias("ativo_milhoes"),
        N.millions(F.col("receita_liquida")).alias("receita_milhoes"),
        "score_risco_total",
        N.round2(F.col("media")).alias("media_setor"),
        N.round2(value - F.col("media")).alias("desvio_setor"),
        "periodo_cadastro",
    )


def company_vs_sector(registry: DataFrame, indicators: DataFrame,
                      year: int | None = None) -> DataFrame:
    """Five indicators of every company against its sector's mean of the same year.

    The company row is its latest year, or ``year``; its sector is the division description of
    its latest registry row.
    """
    from ledgerlight.operators.companies import latest_rows

    names = [column for _, column, *_ in R.COMPARED]
    current = latest_rows(
        _in_year(indicators, year).select("cnpj", "ano_referencia", *names),
        ["cnpj"], ["ano_referencia"],
    )
    sector_of = latest_rows(
        registry.select("cnpj", "ano_referencia", "cnae_divisao_descricao"),
        ["cnpj"], ["ano_referencia"],
    ).where("cnae_divisao_descricao IS NOT NULL").select(
        "cnpj", F.col("cnae_divisao_descricao").alias("setor")
    )
    sectors = _sector_aggregate(registry, indicators, year, ["setor", "ano_referencia"])
    joined = join_group_stats(
        current.join(sector_of, "cnpj"), sectors, ["setor", "ano_referencia"], "cnpj"
    )
    compared = F.explode(F.array(*[
        F.struct(
            F.lit(label).alias("indicador"),
            F.coalesce(F.col(column), F.lit(0.0)).alias("valor_empresa"),
            F.coalesce(F.col(mean), F.lit(0.0)).alias("media_setor"),
            F.lit(low).alias("ideal_min"),
            F.lit(high).alias("ideal_max"),
        )
        for label, column, mean, low, high in R.COMPARED
    ]))
    rows = joined.select(
        "cnpj", "ano_referencia", "setor", "qtd_empresas", compared.alias("c")
    ).select("cnpj", "ano_referencia", "setor", "qtd_empresas", "c.*")
    value, mean = F.col("valor_empresa"), F.col("media_setor")
    return rows.withColumn("desvio_perc", N.deviation_percent(value, mean)).withColumn(
        "status",
        R.deviation_status(value, mean, F.col("desvio_perc"), F.col("ideal_min"),
                           F.col("ideal_max")),
    )


def company_profile_radar(compared: DataFrame) -> DataFrame:
    """Company and sector values on one 0-100 scale per indicator."""
    value, mean = F.col("valor_empresa"), F.col("media_setor")
    low = F.least(value, mean, F.lit(0.0))
    high = F.greatest(value, mean, F.col("ideal_max"))
    return compared.select(
        "cnpj", "ano_referencia", "setor", "indicador",
        N.rescale(value, low, high).alias("empresa_norm"),
        N.rescale(mean, low, high).alias("setor_norm"),
    )
