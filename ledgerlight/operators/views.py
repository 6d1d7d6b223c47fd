"""Presentation views: the columns and headings each page shows."""

from pyspark.sql import DataFrame, functions as F

# Column -> heading, in display order.
HEADINGS = {
    "balance": {
        "data_fim_periodo": "Período", "ativo_total": "Ativo Total",
        "ativo_circulante": "Ativo Circ.", "ativo_nao_circulante": "Ativo Não Circ.",
        "passivo_total": "Passivo Total", "passivo_circulante": "Passivo Circ.",
        "passivo_nao_circulante": "Passivo Não Circ.",
        "patrimonio_liquido": "Patrimônio Líquido",
    },
    "income": {
        "data_fim_periodo": "Período", "receita_bruta": "Receita Bruta",
        "deducoes_receita": "Deduções", "receita_liquida": "Receita Líq.",
        "custos_totais": "Custos", "despesas_totais": "Despesas",
        "lucro_bruto": "Lucro Bruto", "resultado_liquido": "Resultado Líq.",
    },
    "suspicious": {
        "nm_razao_social": "Razão Social", "cd_uf": "UF", "setor": "Setor",
        "valor_indicador": "Indicador", "media_setor": "Média Setor",
        "desvio_setor": "Desvio Setor", "ativo_milhoes": "Ativo (R$M)",
        "receita_milhoes": "Receita (R$M)", "score_risco_total": "Score Risco",
    },
    "accounts": {
        "cd_conta": "Código", "nm_conta": "Nome da Conta",
        "descricao_grupo_balanco": "Grupo", "nivel_conta": "Nível",
        "qtd_empresas_usam": "Qtd Empresas", "media_saldo_milhoes": "Média Saldo (R$M)",
        "min_saldo_milhoes": "Min Saldo (R$M)", "max_saldo_milhoes": "Max Saldo (R$M)",
        "total_saldo_bilhoes": "Total (R$B)",
    },
    "neaf": {
        "nm_razao_social": "Razão Social", "cnpj": "CNPJ", "setor": "Setor", "cd_uf": "UF",
        "qtd_total_indicios": "Total Indícios",
        "qtd_tipos_indicios_distintos": "Tipos Indícios", "score_risco_neaf": "Score Risco",
        "classificacao_risco_neaf": "Classificação",
    },
    "equation": {
        "nm_razao_social": "Razão Social", "cnpj": "CNPJ", "setor": "Setor", "cd_uf": "UF",
        "ativo_total": "Ativo Total", "passivo_pl_total": "Passivo + PL",
        "diferenca_absoluta": "Diferença", "percentual_diferenca": "% Diferença",
        "classificacao_inconsistencia": "Classificação", "score_risco_equacao": "Score",
    },
    "variation": {
        "nm_razao_social": "Razão Social", "cnpj": "CNPJ", "setor": "Setor",
        "cd_conta": "Conta", "saldo_anterior": "Saldo Anterior", "saldo_atual": "Saldo Atual",
        "variacao_absoluta": "Variação Abs.", "variacao_percentual": "Variação %",
        "classificacao_variacao": "Classificação", "score_risco_variacao": "Score",
    },
    "benchmark": {
        "cnae_divisao_descricao": "Setor", "qtd_empresas_setor": "Qtd Empresas",
        "media_ativo_total_setor": "Ativo Médio",
        "media_receita_liquida_setor": "Receita Média",
        "media_liquidez_corrente_setor": "Liquidez", "media_endividamento_setor": "Endividamento",
        "media_margem_liquida_setor": "Margem Líquida %", "media_roe_setor": "ROE %",
    },
}


def as_view(df: DataFrame, name: str, **headings: str) -> DataFrame:
    """Select a page's columns under their headings; ``column="Heading"`` replaces one."""
    shown = {**HEADINGS[name], **headings}
    return df.select([F.col(c).alias(h) for c, h in shown.items()])


def amount_text(column: str, digits: int = 2):
    """Money or count with thousands separators, for text exports."""
    return F.format_number(F.col(column), digits)


def short_text(column: str, length: int):
    return F.substring(column, 1, length)


def key_suffix(column: str, length: int = 4):
    return F.right(F.col(column), F.lit(length))


def file_label(text: str) -> str:
    return text.lower().replace(" ", "_")


def label_column(column: str):
    """``file_label`` of a column."""
    return F.replace(F.lower(F.col(column)), F.lit(" "), F.lit("_"))
