"""Indications of purchases that the supplier did not record as sales."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlight.functions import rules as R
from ledgerlight.functions.joins import attach_to_best, best_rows
from ledgerlight.operators.companies import registry_at


def purchases_without_sale(purchases: DataFrame, sales: DataFrame,
                           on: Sequence[str]) -> DataFrame:
    """Declared purchases with no sale recorded by the supplier under the same keys."""
    return purchases.join(sales.select(*on).distinct(), list(on), "left_anti")


def neaf_indications(indications: DataFrame, cnpj: str | None = None,
                     limit: int | None = 500) -> DataFrame:
    """Occurrences per company, description and complement, most frequent first."""
    if cnpj is not None:
        indications = indications.where(F.col("cnpj") == cnpj)
    keys = ["cnpj", "descricao_indicio", "complemento_indicio"]
    counted = indications.groupBy(*keys).agg(F.count("*").alias("qtd_ocorrencias"))
    return best_rows(
        counted, [F.desc("qtd_ocorrencias"), *[F.asc_nulls_last(k) for k in keys]], limit
    )


def neaf_scores(scores: DataFrame, registry: DataFrame, limit: int | None = 500,
                registry_grain: str = "all") -> DataFrame:
    """Scores with registry attributes; each registry period of a company repeats the row, or
    with ``registry_grain="latest"`` only the latest counts."""
    registry = registry_at(registry, registry_grain)
    filed = registry.select(
        "cnpj", F.col("ano_referencia").alias("periodo_cadastro"), "nm_razao_social",
        F.col("cnae_divisao_descricao").alias("setor"), "cd_uf",
    )
    detail_order = [F.asc_nulls_last(c) for c in filed.columns if c != "cnpj"]
    if limit is None:
        joined = scores.join(filed, "cnpj")
    else:
        known = scores.join(registry.select("cnpj").distinct(), "cnpj", "left_semi")
        order = [F.desc_nulls_first("score_risco_neaf"), F.asc("cnpj"),
                 *[F.asc_nulls_last(c) for c in scores.columns]]
        joined = attach_to_best(known, filed, ["cnpj"], order, limit, detail_order)
    return joined.select(
        "cnpj", "nm_razao_social", "setor", "cd_uf", "qtd_total_indicios",
        "qtd_tipos_indicios_distintos", "score_risco_neaf", "classificacao_risco_neaf",
        "periodo_cadastro",
    )


def filter_neaf(rows: DataFrame, risk_class: str | None = None, state: str | None = None,
                min_indications: int = 1) -> DataFrame:
    if risk_class is not None:
        rows = rows.where(F.col("classificacao_risco_neaf") == risk_class)
    if state is not None:
        rows = rows.where(F.col("cd_uf") == state)
    return rows.where(F.col("qtd_total_indicios") >= min_indications)


def neaf_by_sector(rows: DataFrame, limit: int | None = 10) -> DataFrame:
    totals = rows.where("setor IS NOT NULL").groupBy("setor").agg(
        F.sum("qtd_total_indicios").alias("qtd_indicios")
    )
    return best_rows(totals, [F.desc("qtd_indicios"), F.asc("setor")], limit)


def neaf_points(rows: DataFrame) -> DataFrame:
    return rows.select(
        "cnpj", "nm_razao_social", "setor", "cd_uf", "qtd_total_indicios",
        "qtd_tipos_indicios_distintos", "score_risco_neaf", "classificacao_risco_neaf",
    )


def build_neaf_scores(indications: DataFrame) -> DataFrame:
    """Total and distinct kinds per company; the score formula is our choice."""
    counted = indications.groupBy("cnpj").agg(
        F.count("*").alias("qtd_total_indicios"),
        F.countDistinct("descricao_indicio").alias("qtd_tipos_indicios_distintos"),
    )
    score = F.least(
        F.lit(10.0),
        F.col("qtd_total_indicios").cast("double") / 5 + F.col("qtd_tipos_indicios_distintos"),
    )
    return counted.withColumn("score_risco_neaf", score).withColumn(
        "classificacao_risco_neaf", R.neaf_class(F.col("score_risco_neaf"))
    )
