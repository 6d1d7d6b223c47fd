"""Declared schemas of the twelve filing tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "m": MONEY,
    "d": T.DoubleType(),
    "t": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Table names, columns and types of the warehouse.
REGISTRY = "ecd_empresas_cadastro"
INDICATORS = "ecd_indicadores_financeiros"
BALANCE = "ecd_balanco_patrimonial"
INCOME = "ecd_dre"
CHART = "ecd_plano_contas"
ACCOUNT_BALANCES = "ecd_saldos_contas_v2"
RISK = "ecd_score_risco_consolidado"
NEAF_INDICATIONS = "ecd_neaf_indicios"
NEAF_SCORES = "ecd_neaf_score_risco"
EQUATION = "ecd_inconsistencias_equacao"
VARIATIONS = "ecd_inconsistencias_variacoes"
BENCHMARK = "ecd_benchmark_setorial"

SCHEMAS = {
    REGISTRY: _schema(
        "cnpj s, ano_referencia i, nm_razao_social s, nm_fantasia s, cd_uf s, cd_cnae s, "
        "de_cnae s, cnae_secao s, cnae_secao_descricao s, cnae_divisao s, "
        "cnae_divisao_descricao s, empresa_grande_porte s, tipo_ecd s, "
        "nm_natureza_juridica_sefaz s, nm_reg_apuracao s, sn_simples_nacional_rfb s"
    ),
    INDICATORS: _schema(
        "cnpj s, ano_referencia i, ativo_total m, ativo_circulante m, ativo_nao_circulante m, "
        "passivo_total m, passivo_circulante m, passivo_nao_circulante m, "
        "patrimonio_liquido m, receita_liquida m, lucro_bruto m, resultado_liquido m, "
        "custos_totais m, despesas_totais m, liquidez_corrente d, liquidez_geral d, "
        "endividamento_geral d, composicao_endividamento d, margem_liquida_perc d, "
        "margem_bruta_perc d, roa_retorno_ativo_perc d, roe_retorno_patrimonio_perc d"
    ),
    BALANCE: _schema(
        "cnpj s, ano_referencia i, data_fim_periodo t, ativo_total m, ativo_circulante m, "
        "ativo_nao_circulante m, passivo_total m, passivo_circulante m, "
        "passivo_nao_circulante m, patrimonio_liquido m, passivo_pl_total m"
    ),
    INCOME: _schema(
        "cnpj s, ano_referencia i, data_fim_periodo t, receita_bruta m, deducoes_receita m, "
        "receita_liquida m, custos_totais m, despesas_totais m, lucro_bruto m, "
        "resultado_liquido m"
    ),
    CHART: _schema(
        "cnpj s, ano_referencia i, cd_conta s, nm_conta s, descricao_grupo_balanco s, "
        "cd_conta_referencial s, tipo_conta s, nivel_conta i, cd_conta_sint1 s, "
        "nm_conta_sint1 s"
    ),
    ACCOUNT_BALANCES: _schema(
        "cnpj s, cd_conta s, ano_referencia i, saldo_final_contabil m, data_fim_periodo t"
    ),
    RISK: _schema(
        "cnpj s, ano_referencia i, score_risco_total d, classificacao_risco s, "
        "score_equacao_contabil d, score_neaf d, score_risco_financeiro d, "
        "qtd_indicios_neaf l"
    ),
    NEAF_INDICATIONS: _schema("cnpj s, descricao_indicio s, complemento_indicio s"),
    NEAF_SCORES: _schema(
        "cnpj s, qtd_total_indicios l, qtd_tipos_indicios_distintos l, score_risco_neaf d, "
        "classificacao_risco_neaf s"
    ),
    EQUATION: _schema(
        "cnpj s, ano_referencia i, data_fim_periodo t, ativo_total m, passivo_pl_total m, "
        "diferenca_absoluta m, percentual_diferenca d, classificacao_inconsistencia s, "
        "score_risco_equacao d"
    ),
    VARIATIONS: _schema(
        "cnpj s, cd_conta s, ano_referencia i, saldo_anterior m, saldo_atual m, "
        "variacao_absoluta m, variacao_percentual d, classificacao_variacao s, "
        "score_risco_variacao d"
    ),
    BENCHMARK: _schema(
        "cd_cnae s, de_cnae s, cnae_secao s, cnae_secao_descricao s, cnae_divisao s, "
        "cnae_divisao_descricao s, ano_referencia i, qtd_empresas_setor l, "
        "media_ativo_total_setor d, media_receita_liquida_setor d, "
        "media_resultado_liquido_setor d, media_liquidez_corrente_setor d, "
        "media_endividamento_setor d, media_margem_liquida_setor d, media_roe_setor d, "
        "min_liquidez_setor d, max_liquidez_setor d, min_margem_liquida_setor d, "
        "max_margem_liquida_setor d"
    ),
}


def conform(df, table: str):
    """Select a table's columns in schema order, cast to the declared types."""
    return df.selectExpr(*[
        f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMAS[table]
    ])
