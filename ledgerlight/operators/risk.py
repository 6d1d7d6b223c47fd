"""High-risk companies, from the stored score table or computed from indicators."""

from pyspark.sql import DataFrame, functions as F

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.joins import attach_to_best, fan_out_left_join
from ledgerlight.operators.companies import registry_at

MEASURES = ["ativo_total", "receita_liquida", "liquidez_corrente", "endividamento_geral",
            "margem_liquida_perc"]


def _registry_details(registry: DataFrame, grain: str) -> DataFrame:
    details = registry.select(
        "cnpj", "ano_referencia", "nm_razao_social", "nm_fantasia", "cd_uf",
        R.sector_label().alias("setor"), "empresa_grande_porte",
    )
    return registry_at(details, grain).withColumnRenamed("ano_referencia", "periodo_cadastro")


def _with_registry(rows: DataFrame, registry: DataFrame, grain: str, order: list,
                   limit: int | None) -> DataFrame:
    """Left join on the company alone: every registry period of a company gives a row."""
    details = _registry_details(registry, grain)
    if limit is None:
        joined = fan_out_left_join(rows, details, "cnpj")
    else:
        rest = [F.asc_nulls_last(c) for c in rows.columns]
        details_order = [F.asc_nulls_last(c) for c in details.columns if c != "cnpj"]
        joined = attach_to_best(rows, details, ["cnpj"], order + rest, limit, details_order)

    def zero(name):
        return F.coalesce(name, F.lit(0))

    return joined.select(
        "cnpj",
        F.coalesce("nm_razao_social", F.lit("N/A")).alias("nm_razao_social"),
        F.coalesce("nm_fantasia", F.lit("")).alias("nm_fantasia"),
        F.coalesce("cd_uf", F.lit("N/A")).alias("cd_uf"),
        F.coalesce("setor", F.lit(R.UNCLASSIFIED)).alias("setor"),
        F.coalesce("empresa_grande_porte", F.lit("N")).alias("empresa_grande_porte"),
        F.col("score_risco_total").cast("double").alias("score_risco_total"),
        "classificacao_risco",
        zero("score_equacao_contabil").cast("double").alias("score_equacao_contabil"),
        zero("score_neaf").cast("double").alias("score_neaf"),
        zero("score_risco_financeiro").cast("double").alias("score_risco_financeiro"),
        zero("qtd_indicios_neaf").cast("bigint").alias("qtd_indicios_neaf"),
        N.millions(zero("ativo_total")).alias("ativo_milhoes"),
        N.millions(zero("receita_liquida")).alias("receita_milhoes"),
        N.round2(zero("liquidez_corrente")).alias("liquidez"),
        N.round2(zero("endividamento_geral")).alias("endividamento"),
        N.round2(zero("margem_liquida_perc")).alias("margem_liquida"),
        "prioridade_fiscalizacao", "ano_referencia", "periodo_cadastro",
    )


def high_risk(risk: DataFrame, registry: DataFrame, indicators: DataFrame,
              limit: int | None = 500, year: int | None = None,
              registry_grain: str = "all") -> DataFrame:
    """Companies scored 3 or more, by audit priority and score. ``limit=None`` keeps all."""
    scored = risk.where("score_risco_total >= 3")
    if year is not None:
        scored = scored.where(F.col("ano_referencia") == year)
    rows = scored.join(
        indicators.select("cnpj", "ano_referencia", *MEASURES), ["cnpj", "ano_referencia"], "left"
    ).withColumn(
        "prioridade_fiscalizacao",
        R.audit_priority(F.col("score_risco_total"), F.col("ativo_total")),
    )
    order = [F.asc("prioridade_fiscalizacao"), F.desc("score_risco_total"), F.asc("cnpj"),
             F.asc("ano_referencia")]
    return _with_registry(rows, registry, registry_grain, order, limit)


def risk_fallback(registry: DataFrame, indicators: DataFrame, limit: int | None = 500,
                  year: int | None = None, registry_grain: str = "all") -> DataFrame:
    """The same list from indicators alone, for when no score table is filled."""
    measures = [F.col(c) for c in MEASURES[2:]]
    rows = indicators.select("cnpj", "ano_referencia", *MEASURES)
    if year is not None:
        rows = rows.where(F.col("ano_referencia") == year)
    rows = (
        rows.where(R.financial_alert(*measures))
        .withColumn("score_risco_total", R.financial_score(*measures))
        .withColumn("classificacao_risco", R.risk_class(F.col("score_risco_total")))
        .withColumns({
            "score_equacao_contabil": F.lit(0), "score_neaf": F.lit(0),
            "score_risco_financeiro": F.lit(0), "qtd_indicios_neaf": F.lit(0),
            "prioridade_fiscalizacao": F.lit(3),
        })
    )
    order = [F.desc("score_risco_total"), F.desc_nulls_first("ativo_total"), F.asc("cnpj"),
             F.asc("ano_referencia")]
    return _with_registry(rows, registry, registry_grain, order, limit)


def high_risk_or_fallback(stored: DataFrame | None, registry: DataFrame, indicators: DataFrame,
                          limit: int | None = 500, year: int | None = None) -> DataFrame:
    """Stored scores, unless the table is missing or wholly empty.

    A filled table without rows for ``year`` gives an empty list, not the fallback.
    """
    if stored is None or stored.isEmpty():
        return risk_fallback(registry, indicators, limit, year)
    return high_risk(stored, registry, indicators, limit, year)


def filter_high_risk(rows: DataFrame, min_score: float = 5, state: str | None = None) -> DataFrame:
    rows = rows.where(F.col("score_risco_total") >= min_score)
    return rows if state is None else rows.where(F.col("cd_uf") == state)
