"""Sector benchmark: stored, computed, filtered and persisted."""

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.joins import best_rows, join_group_stats
from ledgerlight.operators.companies import registry_at
from ledgerlight.schemas import BENCHMARK, SCHEMAS

KEYS = ["cd_cnae", "de_cnae", "cnae_secao", "cnae_secao_descricao", "cnae_divisao",
        "cnae_divisao_descricao"]
DEFAULT_YEAR = 2024

# Benchmark column -> indicator averaged
MEANS = {
    "media_ativo_total_setor": "ativo_total",
    "media_receita_liquida_setor": "receita_liquida",
    "media_resultado_liquido_setor": "resultado_liquido",
    "media_liquidez_corrente_setor": "liquidez_corrente",
    "media_endividamento_setor": "endividamento_geral",
    "media_margem_liquida_setor": "margem_liquida_perc",
    "media_roe_setor": "roe_retorno_patrimonio_perc",
}
BOUNDS = {"liquidez_setor": "liquidez_corrente", "margem_liquida_setor": "margem_liquida_perc"}


def _sector_keys() -> list[Column]:
    unknown = F.lit(R.UNCLASSIFIED)
    return [
        F.coalesce("cnae_divisao", F.lit("N/A")).alias("cd_cnae"),
        F.coalesce("de_cnae", unknown).alias("de_cnae"),
        F.coalesce("cnae_secao", F.lit("N/A")).alias("cnae_secao"),
        F.coalesce("cnae_secao_descricao", unknown).alias("cnae_secao_descricao"),
        F.coalesce("cnae_divisao", F.lit("N/A")).alias("cnae_divisao"),
        R.sector_label().alias("cnae_divisao_descricao"),
    ]


def _aggregate(registry: DataFrame, indicators: DataFrame, by_year: bool,
               deviations: bool = False) -> DataFrame:
    """Sector figures over ``indicators LEFT JOIN registry`` on the company alone.

    That join pairs every year with every registry period of a company. Both sides are reduced
    to one row per company (and sector, and year) before it: sums, counts and extremes on the
    left, the number of registry rows on the right. Weighting by that number gives the figures
    of the full pairing without building it.
    """
    company = ["cnpj", "ano_referencia"] if by_year else ["cnpj"]
    names = sorted(set(MEANS.values()))
    parts = []
    for c in names:
        parts += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"c_{c}"),
                  F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        if deviations:  # squared distances from the company's own mean
            x = F.col(c).cast("double")
            parts += [F.avg(x).alias(f"a_{c}"), (F.var_pop(x) * F.count(c)).alias(f"q_{c}")]
    measured = indicators.groupBy(*company).agg(*parts)
    filed = registry.select("cnpj", *_sector_keys()).groupBy("cnpj", *KEYS).agg(
        F.count("*").alias("n")
    )
    # Companies without a registry row join the unclassified group and are not counted in it.
    rows = measured.join(filed, "cnpj", "left").select(
        *[c for c in measured.columns if c != "cnpj"],
        *[F.coalesce(k, F.lit("N/A" if k in ("cd_cnae", "cnae_secao", "cnae_divisao")
                              else R.UNCLASSIFIED)).alias(k) for k in KEYS],
        F.when(F.col("n").isNotNull(), F.col("cnpj")).alias("cnpj"),
        F.coalesce("n", F.lit(1)).alias("n"),
    )
    n = F.col("n")

    def total(prefix, c):
        return F.sum(F.col(f"{prefix}_{c}") * n)

    def mean(c):
        return total("s", c) / F.nullif(total("c", c), F.lit(0))

    group = [*KEYS, "ano_referencia"] if by_year else KEYS
    figures = [F.countDistinct("cnpj").alias("qtd_empresas_setor")]
    figures += [N.round2(mean(c)).alias(name) for name, c in MEANS.items()]
    for name, c in BOUNDS.items():
        figures += [N.round2(F.min(f"min_{c}")).alias(f"min_{name}"),
                    N.round2(F.max(f"max_{c}")).alias(f"max_{name}")]
    if not deviations:
        return rows.groupBy(*group).agg(*figures)
    # Distances are taken from the sector's mean, known from a pass before: the difference of two
    # large sums of squares would lose all digits of a small spread.
    def weighted(c):
        return F.sum(F.col(f"a_{c}") * F.col(f"c_{c}") * n) / F.nullif(total("c", c), F.lit(0))

    centres = rows.groupBy(*group).agg(*[weighted(c).alias(f"m_{c}") for c in names])
    rows = join_group_stats(rows, centres, group, "cnpj")
    for name, c in MEANS.items():
        off = F.col(f"a_{c}") - F.col(f"m_{c}")
        spread = F.sum(n * (F.col(f"q_{c}") + F.col(f"c_{c}") * off * off))
        figures.append(F.sqrt(spread / F.nullif(total("c", c) - 1, F.lit(0))).alias(
            name.replace("media_", "desvio_padrao_")))
    return rows.groupBy(*group).agg(*figures)


def benchmark_dynamic(registry: DataFrame, indicators: DataFrame, year: int | None = None,
                      min_companies: int = 3, limit: int | None = 100,
                      registry_grain: str = "all") -> DataFrame:
    """Benchmark computed from indicators, largest sectors first."""
    registry = registry_at(registry, registry_grain)
    if year is not None:
        indicators = indicators.where(F.col("ano_referencia") == year)
    rows = _aggregate(registry, indicators, by_year=False).where(
        F.col("qtd_empresas_setor") >= min_companies
    ).withColumn("ano_referencia", F.lit(DEFAULT_YEAR if year is None else year))
    rows = rows.select(SCHEMAS[BENCHMARK].fieldNames())
    return best_rows(rows, [F.desc("qtd_empresas_setor"), *[F.asc(k) for k in KEYS]], limit)


def build_benchmark(registry: DataFrame, indicators: DataFrame,
                    min_companies: int = 3) -> DataFrame:
    """Benchmark rows of every year, with sample standard deviations, ready to persist."""
    return _aggregate(registry, indicators, by_year=True, deviations=True).where(
        F.col("qtd_empresas_setor") >= min_companies
    )


def benchmark_stored(benchmark: DataFrame, year: int | None = None) -> DataFrame:
    if year is not None:
        benchmark = benchmark.where(F.col("ano_referencia") == year)
    return benchmark.select(SCHEMAS[BENCHMARK].fieldNames()).orderBy(
        F.desc("qtd_empresas_setor"), *[F.asc(k) for k in KEYS], F.asc("ano_referencia")
    )


def sector_benchmark(stored: DataFrame | None, registry: DataFrame, indicators: DataFrame,
                     year: int | None = None) -> DataFrame:
    """Stored rows of the year; computed when the table is missing or has none."""
    if stored is not None and year is not None:
        stored = stored.where(F.col("ano_referencia") == year)
    # looked at before it is sorted, so the look stops at the first row
    if stored is None or stored.isEmpty():
        return benchmark_dynamic(registry, indicators, year)
    return benchmark_stored(stored)


def filter_benchmark(benchmark: DataFrame, sector: str | None = None) -> DataFrame:
    if sector is None:
        return benchmark
    return benchmark.where(F.col("cnae_divisao_descricao") == sector)


def benchmark_points(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        "cnae_divisao_descricao", "de_cnae", "cnae_secao", "media_liquidez_corrente_setor",
        "media_margem_liquida_setor", "qtd_empresas_setor", "media_roe_setor",
    )
