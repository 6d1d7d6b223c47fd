"""The filing tables as SQL over the order tables, for the DuckDB side of the checks.

Each entry is one common table expression; ``with_tables`` puts the ones a query names, and the
ones those name, in front of it.
"""

import re

SECTOR = "COALESCE(ec.cnae_divisao_descricao, ec.de_cnae, 'Não Classificado')"
SECTOR_TWO = "COALESCE(ec.cnae_divisao_descricao, ec.de_cnae)"
# Fixed values of the risk rules: measure, bound, side on which it counts, points.
LIMITS = [
    ("liquidez_corrente", -1, 0.5, 3), ("liquidez_corrente", -1, 1.0, 2),
    ("endividamento_geral", 1, 0.9, 3), ("endividamento_geral", 1, 0.7, 2),
    ("margem_liquida_perc", -1, -10, 3), ("margem_liquida_perc", -1, 0, 1),
]
# Least score and label of each class.
CLASSES = [(7, "Muito Alto"), (5, "Alto"), (3, "Médio"), (None, "Baixo")]


def financial_points(row: str) -> str:
    """Points of an indicator row: of each measure the most that any of its limits gives."""
    def most(name):
        given = ", ".join(f"({side}, {bound}, {points})" for m, side, bound, points in LIMITS if m == name)
        return (f"COALESCE((SELECT max(p) FROM (VALUES {given}) AS limits(side, bound, p) "
                f"WHERE side * {row}.{name} > side * bound), 0)")
    return " + ".join(most(name) for name in dict.fromkeys(m for m, *_ in LIMITS))


FINANCIAL = f"({financial_points('ind')})"


def risk_class(score: str) -> str:
    """The label of the highest class whose least score is reached."""
    given = ", ".join(f"({'NULL' if least is None else least}, '{label}')" for least, label in CLASSES)
    return (f"(SELECT arg_max(label, COALESCE(least, -1)) FROM (VALUES {given}) AS classes(least, label) "
            f"WHERE least IS NULL OR {score} >= least)")


def millions(money: str) -> str:
    return f"CAST(ROUND({money} * 0.000001, 2) AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


TABLES = {
    "ord": """
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) * 100 + 12 AS INTEGER) AS periodo,
               lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj, o_orderstatus,
               o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS preco
        FROM orders""",
    "registry": """
        SELECT f.cnpj, f.periodo AS ano_referencia, c_name AS nm_razao_social,
               CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS nm_fantasia,
               n_name AS cd_uf, CAST(NULL AS VARCHAR) AS cd_cnae,
               CASE WHEN c_custkey % 49 <> 0 THEN c_mktsegment || ' / ' || r_name END AS de_cnae,
               CAST(r_regionkey AS VARCHAR) AS cnae_secao, r_name AS cnae_secao_descricao,
               CASE WHEN c_custkey % 7 <> 0 THEN substr(c_mktsegment, 1, 3) END AS cnae_divisao,
               CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS cnae_divisao_descricao,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_acctbal >= 5000 THEN 'S'
                    ELSE 'N' END AS empresa_grande_porte,
               CAST(NULL AS VARCHAR) AS tipo_ecd,
               CAST(NULL AS VARCHAR) AS nm_natureza_juridica_sefaz,
               CAST(NULL AS VARCHAR) AS nm_reg_apuracao,
               CAST(NULL AS VARCHAR) AS sn_simples_nacional_rfb
        FROM (SELECT DISTINCT o_custkey, cnpj, periodo FROM ord) f
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "sums": """
        SELECT o_custkey, cnpj, periodo,
          CAST(CAST(COALESCE(SUM(CASE WHEN o_orderstatus = 'F' THEN preco END), 0)
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS ativo_circulante,
          CAST(CAST(COALESCE(SUM(CASE WHEN o_orderstatus = 'P' THEN preco END), 0)
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS ativo_nao_circulante,
          CAST(CAST(COALESCE(SUM(CASE WHEN o_orderstatus = 'O' THEN preco END), 0)
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS passivo_circulante,
          CAST(CAST(COALESCE(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN preco END), 0)
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS passivo_nao_circulante
        FROM ord GROUP BY o_custkey, cnpj, periodo""",
    "balance": """
        SELECT cnpj, periodo AS ano_referencia,
               make_date(CAST(periodo // 100 AS INTEGER), 12, 31) AS data_fim_periodo,
               ativo_circulante + ativo_nao_circulante AS ativo_total, ativo_circulante,
               ativo_nao_circulante,
               passivo_circulante + passivo_nao_circulante AS passivo_total,
               passivo_circulante, passivo_nao_circulante,
               ativo_circulante + ativo_nao_circulante - passivo_circulante
                 - passivo_nao_circulante AS patrimonio_liquido,
               ativo_circulante + ativo_nao_circulante + CASE WHEN c_custkey % 10 = 0
                 THEN CAST(abs(CAST(c_acctbal AS DECIMAL(14,2))) * 100 AS DECIMAL(18,2))
                 ELSE 0 END AS passivo_pl_total
        FROM sums JOIN customer ON o_custkey = c_custkey""",
    "gross": """
        SELECT cnpj, periodo,
          CAST(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(16,2)) * 100
               AS DECIMAL(18,2)) AS receita_bruta,
          CAST(CAST(SUM(ROUND(CAST(l_extendedprice AS DECIMAL(14,2))
                              * CAST(abs(l_discount) AS DECIMAL(4,2)), 2))
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS deducoes_receita,
          CAST(CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R'
                                      THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0)
               AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2)) AS despesas_totais
        FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY cnpj, periodo""",
    "income": """
        SELECT cnpj, periodo AS ano_referencia,
               make_date(CAST(periodo // 100 AS INTEGER), 12, 31) AS data_fim_periodo,
               receita_bruta, deducoes_receita,
               receita_bruta - deducoes_receita AS receita_liquida,
               CAST(receita_bruta * 0.60 AS DECIMAL(18,2)) AS custos_totais, despesas_totais,
               receita_bruta - deducoes_receita - CAST(receita_bruta * 0.60 AS DECIMAL(18,2))
                 AS lucro_bruto,
               receita_bruta - deducoes_receita - CAST(receita_bruta * 0.60 AS DECIMAL(18,2))
                 - despesas_totais AS resultado_liquido
        FROM gross""",
    "indicators": f"""
        SELECT b.cnpj, CAST(b.ano_referencia // 100 AS INTEGER) AS ano_referencia,
               ativo_total, ativo_circulante, ativo_nao_circulante, passivo_total,
               passivo_circulante, passivo_nao_circulante, patrimonio_liquido, receita_liquida,
               lucro_bruto, resultado_liquido, custos_totais, despesas_totais,
               {_ratio('ativo_circulante', 'passivo_circulante')} AS liquidez_corrente,
               {_ratio('ativo_total', 'passivo_total')} AS liquidez_geral,
               {_ratio('passivo_total', 'ativo_total')} AS endividamento_geral,
               {_ratio('passivo_circulante', 'passivo_total')} AS composicao_endividamento,
               {_ratio('resultado_liquido', 'receita_liquida')} * 100 AS margem_liquida_perc,
               {_ratio('lucro_bruto', 'receita_liquida')} * 100 AS margem_bruta_perc,
               {_ratio('resultado_liquido', 'ativo_total')} * 100 AS roa_retorno_ativo_perc,
               {_ratio('resultado_liquido', 'patrimonio_liquido')} * 100
                 AS roe_retorno_patrimonio_perc
        FROM balance b LEFT JOIN income i
          ON b.cnpj = i.cnpj AND b.ano_referencia = i.ano_referencia""",
    "posted": """
        SELECT cnpj, periodo, p_brand || '.' || p_type AS cd_conta,
               p_type || ' ' || p_brand AS nm_conta, p_type AS descricao_grupo_balanco,
               p_type AS cd_conta_referencial,
               CASE WHEN p_brand LIKE '%0' THEN 'S' ELSE 'A' END AS tipo_conta,
               CAST(1 + length(p_type) % 5 AS INTEGER) AS nivel_conta,
               p_brand AS cd_conta_sint1, p_brand AS nm_conta_sint1,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS valor
        FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "chart": """
        SELECT DISTINCT cnpj, periodo AS ano_referencia, cd_conta, nm_conta,
               descricao_grupo_balanco, cd_conta_referencial, tipo_conta, nivel_conta,
               cd_conta_sint1, nm_conta_sint1 FROM posted""",
    "account_balances": """
        SELECT cnpj, cd_conta, CAST(periodo // 100 AS INTEGER) AS ano_referencia,
               CAST(CAST(SUM(valor) AS DECIMAL(16,2)) * 100 AS DECIMAL(18,2))
                 AS saldo_final_contabil,
               make_date(CAST(periodo // 100 AS INTEGER), 12, 31) AS data_fim_periodo
        FROM posted GROUP BY cnpj, cd_conta, periodo""",
    "neaf_indications": """
        SELECT cnpj, 'Compra sem venda registrada - ' || l.l_returnflag AS descricao_indicio,
               'Fornecedor ' || CAST(l.l_suppkey AS VARCHAR) AS complemento_indicio
        FROM lineitem l JOIN ord ON l.l_orderkey = o_orderkey
        WHERE NOT EXISTS (
          SELECT 1 FROM lineitem s
          WHERE (s.l_orderkey + s.l_linenumber) % 20 <> 0 AND s.l_orderkey = l.l_orderkey
            AND s.l_linenumber = l.l_linenumber AND s.l_suppkey = l.l_suppkey)""",
    "neaf_points": """
        SELECT cnpj, COUNT(*) AS qtd_total_indicios,
               COUNT(DISTINCT descricao_indicio) AS qtd_tipos_indicios_distintos,
               LEAST(CAST(10 AS DOUBLE), CAST(COUNT(*) AS DOUBLE) / 5
                     + COUNT(DISTINCT descricao_indicio)) AS score_risco_neaf
        FROM neaf_indications GROUP BY cnpj""",
    "neaf_scores": """
        SELECT *, CASE WHEN score_risco_neaf >= 8 THEN 'CRÍTICO'
                       WHEN score_risco_neaf >= 5 THEN 'ALTO'
                       WHEN score_risco_neaf >= 3 THEN 'MODERADO'
                       ELSE 'BAIXO' END AS classificacao_risco_neaf
        FROM neaf_points""",
    "gaps": """
        SELECT cnpj, ano_referencia, data_fim_periodo, ativo_total, passivo_pl_total,
               abs(ativo_total - passivo_pl_total) AS diferenca_absoluta,
               CASE WHEN ativo_total = passivo_pl_total THEN CAST(0 AS DOUBLE)
                    ELSE CAST(abs(ativo_total - passivo_pl_total) AS DOUBLE)
                         / NULLIF(CAST(abs(ativo_total) AS DOUBLE), 0) * 100
               END AS percentual_diferenca
        FROM balance""",
    "equation_classes": """
        SELECT *, CASE WHEN diferenca_absoluta = 0 OR percentual_diferenca <= 0.01 THEN 'OK'
                       WHEN percentual_diferenca <= 1 THEN 'Diferença Mínima'
                       WHEN percentual_diferenca <= 5 THEN 'Moderada'
                       WHEN percentual_diferenca <= 20 THEN 'Alta'
                       ELSE 'Crítica' END AS classificacao_inconsistencia
        FROM gaps""",
    "equation": """
        SELECT *, CAST(CASE classificacao_inconsistencia WHEN 'OK' THEN 0
                       WHEN 'Diferença Mínima' THEN 1 WHEN 'Moderada' THEN 3
                       WHEN 'Alta' THEN 6 ELSE 10 END AS DOUBLE) AS score_risco_equacao
        FROM equation_classes""",
    "changes": """
        SELECT cnpj, cd_conta, ano_referencia,
               LAG(saldo_final_contabil) OVER (PARTITION BY cnpj, cd_conta
                                               ORDER BY ano_referencia) AS saldo_anterior,
               saldo_final_contabil AS saldo_atual
        FROM account_balances""",
    "change_percents": """
        SELECT *, saldo_atual - saldo_anterior AS variacao_absoluta,
               CAST(saldo_atual - saldo_anterior AS DOUBLE)
                 / NULLIF(CAST(abs(saldo_anterior) AS DOUBLE), 0) * 100 AS variacao_percentual
        FROM changes WHERE saldo_anterior IS NOT NULL""",
    "change_classes": """
        SELECT *, CASE WHEN variacao_percentual IS NULL THEN 'Sem Base'
                       WHEN variacao_percentual > 500 THEN 'Variação Extrema'
                       WHEN variacao_percentual > 200 THEN 'Variação Muito Alta'
                       WHEN variacao_percentual > 100 OR variacao_percentual < -50
                         THEN 'Variação Alta'
                       ELSE 'Normal' END AS classificacao_variacao
        FROM change_percents""",
    "variations": """
        SELECT *, CAST(CASE classificacao_variacao WHEN 'Variação Extrema' THEN 10
                       WHEN 'Variação Muito Alta' THEN 7 WHEN 'Variação Alta' THEN 5
                       ELSE 0 END AS DOUBLE) AS score_risco_variacao
        FROM change_classes""",
    "risk_parts": f"""
        SELECT ind.cnpj, ind.ano_referencia, e.score_equacao_contabil,
               n.score_risco_neaf AS score_neaf,
               CAST({FINANCIAL} AS DOUBLE) AS score_risco_financeiro,
               n.qtd_total_indicios AS qtd_indicios_neaf
        FROM indicators ind
        LEFT JOIN (SELECT cnpj, ano_referencia // 100 AS ano,
                          MAX(score_risco_equacao) AS score_equacao_contabil
                   FROM equation GROUP BY ALL) e
          ON ind.cnpj = e.cnpj AND ind.ano_referencia = e.ano
        LEFT JOIN neaf_scores n ON ind.cnpj = n.cnpj""",
    "risk_totals": """
        SELECT *, LEAST(CAST(10 AS DOUBLE),
                        score_risco_financeiro * CAST(0.5 AS DOUBLE)
                        + COALESCE(score_equacao_contabil, 0) * CAST(0.25 AS DOUBLE)
                        + COALESCE(score_neaf, 0) * CAST(0.25 AS DOUBLE)) AS score_risco_total
        FROM risk_parts""",
    "risk": f"""
        SELECT cnpj, ano_referencia, score_risco_total,
               {risk_class('score_risco_total')} AS classificacao_risco,
               score_equacao_contabil, score_neaf, score_risco_financeiro, qtd_indicios_neaf
        FROM risk_totals""",
}


def _named(sql: str, tables: dict[str, str]) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [t for t in tables if t in words]


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the tables it names, directly or through other tables."""
    tables = {**TABLES, **(extra or {})}
    needed, pending = set(), _named(sql, tables)
    while pending:
        table = pending.pop()
        if table not in needed:
            needed.add(table)
            pending += [t for t in _named(tables[table], tables) if t != table]
    parts = [f"{t} AS ({tables[t]})" for t in tables if t in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
