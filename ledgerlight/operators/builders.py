"""Builders of the derived tables from statements, accounts and documents."""

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight import schemas as S
from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.functions.periods import year_of
from ledgerlight.operators.companies import latest_rows


def build_balance(lines: DataFrame) -> DataFrame:
    """Balance sheets from posted lines ``(cnpj, ano_referencia, data_fim_periodo, grupo, valor)``.

    ``grupo`` is one of ativo_circulante, ativo_nao_circulante, passivo_circulante,
    passivo_nao_circulante and patrimonio_liquido.
    """
    totals = _by_group(lines, ["ativo_circulante", "ativo_nao_circulante",
                               "passivo_circulante", "passivo_nao_circulante",
                               "patrimonio_liquido"])
    return S.conform(with_balance_totals(totals), S.BALANCE)


def with_balance_totals(rows: DataFrame) -> DataFrame:
    assets = F.col("ativo_circulante") + F.col("ativo_nao_circulante")
    liabilities = F.col("passivo_circulante") + F.col("passivo_nao_circulante")
    return rows.withColumns({
        "ativo_total": assets,
        "passivo_total": liabilities,
        "passivo_pl_total": liabilities + F.col("patrimonio_liquido"),
    })


def build_income(lines: DataFrame) -> DataFrame:
    """Income statements from posted lines of receita_bruta, deducoes_receita, custos_totais
    and despesas_totais, all posted as positive amounts."""
    totals = _by_group(lines, ["receita_bruta", "deducoes_receita", "custos_totais",
                               "despesas_totais"])
    return S.conform(with_income_totals(totals), S.INCOME)


def with_income_totals(rows: DataFrame) -> DataFrame:
    net = F.col("receita_bruta") - F.col("deducoes_receita")
    gross = net - F.col("custos_totais")
    return rows.withColumns({
        "receita_liquida": net,
        "lucro_bruto": gross,
        "resultado_liquido": gross - F.col("despesas_totais"),
    })


def _by_group(lines: DataFrame, groups: list[str]) -> DataFrame:
    return lines.groupBy("cnpj", "ano_referencia", "data_fim_periodo").agg(*[
        F.coalesce(F.sum(F.when(F.col("grupo") == g, F.col("valor"))), F.lit(0))
        .cast(S.MONEY).alias(g)
        for g in groups
    ])


def _closing(statement: DataFrame, ties: list[str]) -> DataFrame:
    """Last statement of each company and year, with YYYY as its period."""
    order = ["data_fim_periodo", "periodo"]
    rows = statement.withColumn("periodo", F.col("ano_referencia")).withColumn(
        "ano_referencia", year_of("ano_referencia")
    )
    return latest_rows(rows, ["cnpj", "ano_referencia"], order, ties).drop(*order)


def build_indicators(balance: DataFrame, income: DataFrame) -> DataFrame:
    """Yearly ratios from the closing balance sheet and income statement."""
    rows = _closing(balance, ["ativo_total", "passivo_total"]).join(
        _closing(income, ["receita_liquida", "resultado_liquido"]),
        ["cnpj", "ano_referencia"], "full",
    )
    c = F.col
    return S.conform(rows.withColumns({
        "liquidez_corrente": N.ratio(c("ativo_circulante"), c("passivo_circulante")),
        "liquidez_geral": N.ratio(c("ativo_total"), c("passivo_total")),
        "endividamento_geral": N.ratio(c("passivo_total"), c("ativo_total")),
        "composicao_endividamento": N.ratio(c("passivo_circulante"), c("passivo_total")),
        "margem_liquida_perc": N.percent(c("resultado_liquido"), c("receita_liquida")),
        "margem_bruta_perc": N.percent(c("lucro_bruto"), c("receita_liquida")),
        "roa_retorno_ativo_perc": N.percent(c("resultado_liquido"), c("ativo_total")),
        "roe_retorno_patrimonio_perc": N.percent(c("resultado_liquido"),
                                                 c("patrimonio_liquido")),
    }), S.INDICATORS)


def build_equation_check(balance: DataFrame) -> DataFrame:
    """Gap between assets and liabilities plus equity, in money and percent of assets."""
    gap = F.abs(F.col("ativo_total") - F.col("passivo_pl_total"))
    rows = balance.withColumn("diferenca_absoluta", gap).withColumn(
        "percentual_diferenca",
        F.when(gap == 0, F.lit(0.0)).otherwise(
            N.percent(F.col("diferenca_absoluta"), F.abs("ativo_total"))
        ),
    )
    label = R.equation_class(F.col("diferenca_absoluta"), F.col("percentual_diferenca"))
    return S.conform(
        rows.withColumn("classificacao_inconsistencia", label).withColumn(
            "score_risco_equacao", R.equation_score(F.col("classificacao_inconsistencia"))
        ),
        S.EQUATION,
    )


def build_variations(balances: DataFrame) -> DataFrame:
    """Change of every account against the previous period the company reported it.

    Balances are added up to one row per company, account and year first, so a window group
    holds one row per year of a single account.
    """
    yearly = balances.groupBy("cnpj", "cd_conta", "ano_referencia").agg(
        F.sum("saldo_final_contabil").alias("saldo_atual")
    )
    history = Window.partitionBy("cnpj", "cd_conta").orderBy("ano_referencia")
    rows = yearly.withColumn("saldo_anterior", F.lag("saldo_atual").over(history)).where(
        "saldo_anterior IS NOT NULL"
    )
    change = F.col("saldo_atual") - F.col("saldo_anterior")
    rows = rows.withColumn("variacao_absoluta", change).withColumn(
        "variacao_percentual", N.percent(change, F.abs("saldo_anterior"))
    )
    label = R.variation_class(F.col("variacao_percentual"))
    return S.conform(
        rows.withColumn("classificacao_variacao", label).withColumn(
            "score_risco_variacao", R.variation_score(F.col("classificacao_variacao"))
        ),
        S.VARIATIONS,
    )


def build_risk_scores(indicators: DataFrame, equation: DataFrame,
                      neaf_scores: DataFrame) -> DataFrame:
    """Consolidated 0-10 score per company and year; the weights are our choice.

    Half the financial score, a quarter of the year's worst equation score and a quarter of the
    company's NEAF score.
    """
    financial = R.financial_score(*[
        F.col(c) for c in ("liquidez_corrente", "endividamento_geral", "margem_liquida_perc")
    ])
    worst = equation.groupBy("cnpj", year_of("ano_referencia").alias("ano_referencia")).agg(
        F.max("score_risco_equacao").alias("score_equacao_contabil")
    )
    neaf = neaf_scores.select(
        "cnpj", F.col("score_risco_neaf").alias("score_neaf"),
        F.col("qtd_total_indicios").alias("qtd_indicios_neaf"),
    )
    total = F.least(
        F.lit(10.0),
        F.col("score_risco_financeiro") * 0.5
        + F.coalesce("score_equacao_contabil", F.lit(0.0)) * 0.25
        + F.coalesce("score_neaf", F.lit(0.0)) * 0.25,
    )
    rows = (
        indicators.select("cnpj", "ano_referencia",
                          financial.cast("double").alias("score_risco_financeiro"))
        .join(worst, ["cnpj", "ano_referencia"], "left")
        .join(neaf, "cnpj", "left")
        .withColumn("score_risco_total", total)
        .withColumn("classificacao_risco", R.risk_class(F.col("score_risco_total")))
    )
    return S.conform(rows, S.RISK)
