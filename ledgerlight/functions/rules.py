"""Risk rules, bands and labels. The thresholds and labels are fixed values."""

from pyspark.sql import Column, functions as F

UNCLASSIFIED = "Não Classificado"
LARGE_ASSETS = 100_000_000


def sector_label() -> Column:
    """Division description, else activity description, else the unclassified label."""
    return F.coalesce("cnae_divisao_descricao", "de_cnae", F.lit(UNCLASSIFIED))


def financial_score(liquidity: Column, debt: Column, margin: Column) -> Column:
    """0-9 points from three indicators; a null indicator adds nothing."""
    return (
        F.when(liquidity < 0.5, 3).when(liquidity < 1.0, 2).otherwise(0)
        + F.when(debt > 0.9, 3).when(debt > 0.7, 2).otherwise(0)
        + F.when(margin < -10, 3).when(margin < 0, 1).otherwise(0)
    )


def financial_alert(liquidity: Column, debt: Column, margin: Column) -> Column:
    return (liquidity < 1.0) | (debt > 0.7) | (margin < 0)


def risk_class(score: Column) -> Column:
    return (
        F.when(score >= 7, "Muito Alto")
        .when(score >= 5, "Alto")
        .when(score >= 3, "Médio")
        .otherwise("Baixo")
    )


def audit_priority(score: Column, assets: Column) -> Column:
    """1 (both a top score and large assets) to 5."""
    top, large = score >= 7, F.coalesce(assets, F.lit(0)) >= LARGE_ASSETS
    return (
        F.when(top & large, 1)
        .when(top | large, 2)
        .when(score >= 5, 3)
        .when(score >= 3, 4)
        .otherwise(5)
    )


def risk_band(score: Column) -> Column:
    return F.when(score >= 7, "Alto").when(score >= 5, "Médio").otherwise("Baixo")


def risk_alert(score: Column) -> Column:
    return (
        F.when(score >= 7, "ALERTA CRÍTICO")
        .when(score >= 5, "ALERTA ALTO")
        .otherwise("RISCO CONTROLADO")
    )


def ml_priority(score: Column) -> Column:
    """Right-closed bins (0,5] (5,8] (8,11] (11,100]; outside them null."""
    return (
        F.when((score > 0) & (score <= 5), "Baixa")
        .when((score > 5) & (score <= 8), "Média")
        .when((score > 8) & (score <= 11), "Alta")
        .when((score > 11) & (score <= 100), "Crítica")
    )


def deviation_status(value: Column, mean: Column, deviation: Column,
                     ideal_min: Column, ideal_max: Column) -> Column:
    return (
        F.when((value == 0) & (mean == 0), "Sem dados")
        .when(value.between(ideal_min, ideal_max), "Normal")
        .when(F.abs(deviation) > 50, "Anômalo (>50% de desvio)")
        .when(F.abs(deviation) > 25, "Atenção (>25% de desvio)")
        .otherwise("Levemente diferente")
    )


# Label -> (column, suspicious rows, sort ascending)
SUSPICIOUS = {
    "Liquidez Corrente": ("liquidez_corrente", lambda c: c < 0.5, True),
    "Endividamento Geral": ("endividamento_geral", lambda c: c > 0.8, False),
    "Margem Líquida": ("margem_liquida_perc", lambda c: c < -10, True),
    "ROA": ("roa_retorno_ativo_perc", lambda c: c < -10, True),
    "ROE": ("roe_retorno_patrimonio_perc", lambda c: c < -20, True),
}

# Label, company column, sector mean column, ideal minimum, ideal maximum
COMPARED = [
    ("Liquidez Corrente", "liquidez_corrente", "media_liquidez", 1.0, 2.0),
    ("Endividamento Geral", "endividamento_geral", "media_endividamento", 0.0, 0.5),
    ("Margem Líquida (%)", "margem_liquida_perc", "media_margem_liquida", 5.0, 100.0),
    ("ROA (%)", "roa_retorno_ativo_perc", "media_roa", 5.0, 100.0),
    ("ROE (%)", "roe_retorno_patrimonio_perc", "media_roe", 10.0, 100.0),
]

# Indicator name -> sector column, and benchmark indicator name -> benchmark column
SECTOR_COLUMNS = {
    "Liquidez Corrente": "media_liquidez",
    "Endividamento Geral": "media_endividamento",
    "Margem Líquida": "media_margem_liquida",
    "ROA": "media_roa",
    "ROE": "media_roe",
}
BENCHMARK_COLUMNS = {
    "Ativo Total Médio": "media_ativo_total_setor",
    "Receita Líquida Média": "media_receita_liquida_setor",
    "Liquidez Corrente": "media_liquidez_corrente_setor",
    "Endividamento": "media_endividamento_setor",
    "Margem Líquida": "media_margem_liquida_setor",
    "ROE": "media_roe_setor",
}

VARIATION_CLASSES = ["Variação Extrema", "Variação Muito Alta", "Variação Alta"]


def equation_class(gap: Column, gap_percent: Column) -> Column:
    """Bands of our choice; a gap on zero assets has no percent and is critical."""
    return (
        F.when((gap == 0) | (gap_percent <= 0.01), "OK")
        .when(gap_percent <= 1, "Diferença Mínima")
        .when(gap_percent <= 5, "Moderada")
        .when(gap_percent <= 20, "Alta")
        .otherwise("Crítica")
    )


def equation_score(label: Column) -> Column:
    return (
        F.when(label == "OK", 0.0)
        .when(label == "Diferença Mínima", 1.0)
        .when(label == "Moderada", 3.0)
        .when(label == "Alta", 6.0)
        .otherwise(10.0)
    )


def variation_class(change_percent: Column) -> Column:
    """Flagged above +100 % or below -50 %; the two upper bands are our choice."""
    return (
        F.when(change_percent.isNull(), "Sem Base")
        .when(change_percent > 500, "Variação Extrema")
        .when(change_percent > 200, "Variação Muito Alta")
        .when((change_percent > 100) | (change_percent < -50), "Variação Alta")
        .otherwise("Normal")
    )


def variation_score(label: Column) -> Column:
    return (
        F.when(label == "Variação Extrema", 10.0)
        .when(label == "Variação Muito Alta", 7.0)
        .when(label == "Variação Alta", 5.0)
        .otherwise(0.0)
    )


def neaf_class(score: Column) -> Column:
    return (
        F.when(score >= 8, "CRÍTICO")
        .when(score >= 5, "ALTO")
        .when(score >= 3, "MODERADO")
        .otherwise("BAIXO")
    )
