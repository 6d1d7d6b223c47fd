"""Chart of accounts, account balances, equation breaks and abrupt variations."""

from pyspark.sql import DataFrame, functions as F

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.joins import attach_to_best, best_rows, best_rows_per
from ledgerlight.functions.periods import months_of, period_in_year
from ledgerlight.operators.companies import registry_at

ACCOUNT = ["cd_conta", "nm_conta", "descricao_grupo_balanco", "cd_conta_referencial",
           "tipo_conta", "nivel_conta", "cd_conta_sint1", "nm_conta_sint1"]


def _usage_order() -> list:
    return [F.desc("qtd_empresas_usam"), *[F.asc_nulls_last(c) for c in ACCOUNT]]


def account_usage(chart: DataFrame, year: int | None = None, min_companies: int = 5,
                  limit: int | None = 200) -> DataFrame:
    """Analytic accounts by the number of companies using them."""
    rows = chart.where("tipo_conta = 'A'")
    if year is not None:
        rows = rows.where(months_of("ano_referencia", year))
    used = rows.groupBy(*ACCOUNT).agg(F.countDistinct("cnpj").alias("qtd_empresas_usam"))
    used = used.where(F.col("qtd_empresas_usam") >= min_companies)
    return best_rows(used, _usage_order(), limit)


def account_balance_stats(usage: DataFrame, balances: DataFrame,
                          year: int | None = None) -> DataFrame:
    """Usage rows with mean, total, least and greatest balance of the account.

    Balances are aggregated to one row per account before the join, so the join is between two
    account lists whatever the number of balances.
    """
    if year is not None:
        balances = balances.where(F.col("ano_referencia") == year)
    money = F.col("saldo_final_contabil")
    per_account = balances.groupBy("cd_conta").agg(
        (N.money_mean(money) / N.MILLION).alias("media_saldo_milhoes"),
        (F.sum(money).cast("double") / 1_000_000_000).alias("total_saldo_bilhoes"),
        (F.min(money).cast("double") / N.MILLION).alias("min_saldo_milhoes"),
        (F.max(money).cast("double") / N.MILLION).alias("max_saldo_milhoes"),
    )
    names = [c for c in per_account.columns if c != "cd_conta"]
    return usage.join(per_account, "cd_conta", "left").select(
        *ACCOUNT, "qtd_empresas_usam", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]
    )


def account_dispersion(accounts: DataFrame, limit: int | None = 20) -> DataFrame:
    """Accounts by the range of their balances relative to the mean."""
    rows = accounts.select(
        "cd_conta", "nm_conta", "media_saldo_milhoes", "min_saldo_milhoes", "max_saldo_milhoes",
        N.dispersion_percent(F.col("min_saldo_milhoes"), F.col("max_saldo_milhoes"),
                             F.col("media_saldo_milhoes")).alias("coef_variacao"),
    )
    return best_rows(rows, [F.desc("coef_variacao"), F.asc("cd_conta"), F.asc("nm_conta")], limit)


def filter_accounts(accounts: DataFrame, group: str | None = None, level: int | None = None,
                    min_companies: int = 10) -> DataFrame:
    if group is not None:
        accounts = accounts.where(F.col("descricao_grupo_balanco") == group)
    if level is not None:
        accounts = accounts.where(F.col("nivel_conta") == level)
    return accounts.where(F.col("qtd_empresas_usam") >= min_companies)


def search_accounts(accounts: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular expression over name and code; null matches nothing."""
    def found(name):
        return F.coalesce(F.col(name).rlike(f"(?i){pattern}"), F.lit(False))

    return accounts.where(found("nm_conta") | found("cd_conta"))


def accounts_by_group(accounts: DataFrame) -> DataFrame:
    group = F.col("descricao_grupo_balanco")
    return (
        accounts.where(group.isNotNull() & (group != ""))
        .groupBy(group.alias("grupo"))
        .agg(F.count("cd_conta").alias("qtd_contas"),
             F.sum("qtd_empresas_usam").alias("total_uso"))
        .where("qtd_contas > 0")
    )


def universal_accounts(accounts: DataFrame, share: float = 0.8,
                       limit: int | None = 10) -> DataFrame:
    """Accounts used by at least ``share`` of the most used account's companies."""
    most = accounts.agg(F.max("qtd_empresas_usam")).scalar()
    rows = accounts.where(F.col("qtd_empresas_usam") >= most * share)
    return best_rows(rows, _usage_order(), limit).select(
        "cd_conta", "nm_conta", "qtd_empresas_usam"
    )


def account_summary(accounts: DataFrame) -> DataFrame:
    """One row over the listed accounts."""
    first = F.struct(-F.col("qtd_empresas_usam"), "cd_conta", "nm_conta")
    return accounts.agg(
        F.count("*").alias("total_contas"),
        F.avg("qtd_empresas_usam").alias("media_empresas_conta"),
        F.sum("total_saldo_bilhoes").alias("total_saldo_bilhoes"),
        F.min_by("nm_conta", first).alias("conta_mais_usada"),
        F.max("qtd_empresas_usam").alias("uso_maximo"),
    )


def account_balances(balances: DataFrame, account: str | None = None, year: int | None = None,
                     limit: int | None = 1000) -> DataFrame:
    """Newest balances of one account, or of every account."""
    if year is not None:
        balances = balances.where(F.col("ano_referencia") == year)
    columns = ["cnpj", "cd_conta", "saldo_final_contabil", "data_fim_periodo"]
    order = [F.desc_nulls_first("data_fim_periodo"), F.asc("cnpj"),
             F.asc_nulls_last("saldo_final_contabil")]
    if account is None:
        return best_rows_per(balances.select(*columns), ["cd_conta"], order, limit)
    rows = balances.where(F.col("cd_conta") == account).select(*columns)
    return best_rows(rows, order, limit)


def equation_anomalies(equation: DataFrame, registry: DataFrame, year: int | None = None,
                       limit: int | None = 500) -> DataFrame:
    """Filings whose assets differ from liabilities plus equity."""
    rows = equation.where("classificacao_inconsistencia != 'OK'")
    if year is not None:
        rows = rows.where(period_in_year("ano_referencia", year))
    filed = registry.select("cnpj", "ano_referencia", "nm_razao_social",
                            R.sector_label().alias("setor"), "cd_uf")
    rows = rows.join(filed, ["cnpj", "ano_referencia"]).select(
        "cnpj", "nm_razao_social", "setor", "cd_uf", "ano_referencia", "data_fim_periodo",
        "ativo_total", "passivo_pl_total", "diferenca_absoluta", "percentual_diferenca",
        "classificacao_inconsistencia", "score_risco_equacao",
    )
    order = [F.desc_nulls_first("score_risco_equacao"),
             F.abs("diferenca_absoluta").desc_nulls_first(), F.asc("cnpj"),
             F.asc("ano_referencia")]
    return best_rows(rows, order, limit)


def variation_anomalies(variations: DataFrame, registry: DataFrame, year: int | None = None,
                        limit: int | None = 500, registry_grain: str = "all") -> DataFrame:
    """Account variations in the three anomalous classes.

    The join is on the company alone, so each registry period of a company repeats the row;
    ``registry_grain="latest"`` keeps the latest period only.
    """
    registry = registry_at(registry, registry_grain)
    rows = variations.where(F.col("classificacao_variacao").isin(R.VARIATION_CLASSES))
    if year is not None:
        rows = rows.where(F.col("ano_referencia") == year)
    filed = registry.select("cnpj", F.col("ano_referencia").alias("periodo_cadastro"),
                            "nm_razao_social", R.sector_label().alias("setor"), "cd_uf")
    order = [F.desc_nulls_first("score_risco_variacao"),
             F.abs("variacao_percentual").desc_nulls_first(), F.asc("cnpj"), F.asc("cd_conta"),
             F.asc("ano_referencia")]
    detail_order = [F.asc_nulls_last(c) for c in filed.columns if c != "cnpj"]
    if limit is None:
        joined = rows.join(filed, "cnpj")
    else:
        # Only companies with a registry row take part; after that the inner join drops none.
        rows = rows.join(registry.select("cnpj").distinct(), "cnpj", "left_semi")
        rest = [F.asc_nulls_last(c) for c in rows.columns]
        joined = attach_to_best(rows, filed, ["cnpj"], order + rest, limit, detail_order)
    return joined.select(
        "cnpj", "nm_razao_social", "setor", "cd_uf", "cd_conta", "ano_referencia",
        "saldo_anterior", "saldo_atual", "variacao_absoluta", "variacao_percentual",
        "classificacao_variacao", "score_risco_variacao", "periodo_cadastro",
    )
