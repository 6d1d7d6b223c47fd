"""DuckDB SQL for every registered query that SQL can express."""

from ledgerlight.plans.oracle_tables import (
    FINANCIAL, SECTOR, SECTOR_TWO, millions, risk_class, with_tables,
)

YEAR = 1998


def rounded(value: str, digits: int = 2) -> str:
    """ROUND without negative zero."""
    return (f"CASE WHEN ROUND({value}, {digits}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE ROUND({value}, {digits}) END")


J1 = """registry ec JOIN indicators ind
    ON ec.cnpj = ind.cnpj AND ec.ano_referencia // 100 = ind.ano_referencia"""


def _sector_aggregate(group: str, where: str = "") -> str:
    return f"""
    SELECT {group}, COUNT(DISTINCT ec.cnpj) AS qtd_empresas,
      ROUND(AVG(ind.ativo_total) / 1000000, 2) AS media_ativo_milhoes,
      ROUND(AVG(ind.receita_liquida) / 1000000, 2) AS media_receita_milhoes,
      ROUND(AVG(ind.liquidez_corrente), 2) AS media_liquidez,
      ROUND(AVG(ind.endividamento_geral), 2) AS media_endividamento,
      {rounded('AVG(ind.margem_liquida_perc)')} AS media_margem_liquida,
      {rounded('AVG(ind.roa_retorno_ativo_perc)')} AS media_roa,
      {rounded('AVG(ind.roe_retorno_patrimonio_perc)')} AS media_roe
    FROM {J1} {where} GROUP BY ALL HAVING COUNT(DISTINCT ec.cnpj) > 0"""


def _sectors(year=None, cut="") -> str:
    where = f"WHERE ind.ano_referencia = {year}" if year else ""
    return _sector_aggregate(f"{SECTOR} AS setor", where) + f"""
    ORDER BY qtd_empresas DESC, setor {cut}"""


# What stands for a missing registry field, and digits of the shown measures.
MISSING = {"nm_razao_social": "N/A", "nm_fantasia": "", "cd_uf": "N/A", "setor": "Não Classificado",
           "empresa_grande_porte": "N"}
IN_MILLIONS = {"ativo_milhoes": "ativo_total", "receita_milhoes": "receita_liquida"}
TWO_DIGITS = {"liquidez": "liquidez_corrente", "endividamento": "endividamento_geral",
              "margem_liquida": "margem_liquida_perc"}
# Priority, least score, least assets.
PRIORITIES = [(1, 7, 100000000), (2, 7, None), (2, None, 100000000), (3, 5, None), (4, 3, None)]
# Companies whose liquidity, debt or margin is beyond these are listed without a score.
DOUBTFUL = "liquidez_corrente < 1.0 OR endividamento_geral > 0.7 OR margem_liquida_perc < 0"


def _companies_named() -> str:
    """Registry rows reduced to what the risk lists show of a company."""
    fields = {c: f"ec.{c}" for c in MISSING} | {"setor": SECTOR_TWO}
    shown = ", ".join(f"{value} AS {name}" for name, value in fields.items())
    return f"SELECT cnpj, {shown}, ec.ano_referencia AS periodo_cadastro FROM registry ec"


def _measures_shown() -> str:
    """Indicator rows with their measures as shown, missing ones as 0."""
    shown = [f"{millions(f'COALESCE({c}, 0)')} AS {name}" for name, c in IN_MILLIONS.items()]
    shown += [f"{rounded(f'COALESCE({c}, 0)')} AS {name}" for name, c in TWO_DIGITS.items()]
    return (f"SELECT cnpj, ano_referencia, {', '.join(shown)}, COALESCE(ativo_total, 0) AS ativo, "
            f"ativo_total, {FINANCIAL} AS pontos, {DOUBTFUL} AS duvidosa FROM indicators ind")


def _risk_columns(scores: dict[str, str]) -> str:
    """Columns of a risk list: company, given scores, measures, keys; in any order."""
    names = [f"COALESCE(c.{name}, '{other}') AS {name}" for name, other in MISSING.items()]
    zero = {name: "0" for name in (*IN_MILLIONS, *TWO_DIGITS)}
    measures = [f"COALESCE(m.{name}, {other}) AS {name}" for name, other in zero.items()]
    given = [f"{value} AS {name}" for name, value in scores.items()]
    return ", ".join(names + given + measures + ["c.periodo_cadastro"])


def _high_risk(limit=None, year=None) -> str:
    rules = ", ".join(f"({p}, {least or 'NULL'}, {assets or 'NULL'})" for p, least, assets in PRIORITIES)
    when = f"AND ano_referencia = {year}" if year else ""
    scores = {name: f"COALESCE(r.{name}, 0)" for name in (
        "score_equacao_contabil", "score_neaf", "score_risco_financeiro", "qtd_indicios_neaf")}
    return f"""
    SELECT * EXCLUDE (ativo) REPLACE (CAST((
        SELECT min(p) FROM (VALUES {rules}) AS rules(p, least, assets)
        WHERE (least IS NULL OR score_risco_total >= least) AND (assets IS NULL OR ativo >= assets)
      ) AS INTEGER) AS prioridade_fiscalizacao)
    FROM (
      SELECT r.cnpj, r.ano_referencia, r.score_risco_total, r.classificacao_risco,
        COALESCE(m.ativo, 0) AS ativo, 0 AS prioridade_fiscalizacao, {_risk_columns(scores)}
      FROM (SELECT * FROM risk WHERE score_risco_total >= 3 {when}) r
      LEFT JOIN ({_measures_shown()}) m USING (cnpj, ano_referencia)
      LEFT JOIN ({_companies_named()}) c USING (cnpj))
    ORDER BY prioridade_fiscalizacao, score_risco_total DESC, cnpj, ano_referencia,
             periodo_cadastro {'' if limit is None else f'LIMIT {limit}'}"""


def _fallback(year=None) -> str:
    when = f"AND m.ano_referencia = {year}" if year else ""
    scores = {
        "score_risco_total": "CAST(m.pontos AS DOUBLE)", "classificacao_risco": risk_class("m.pontos"),
        "score_equacao_contabil": "0.0::DOUBLE", "score_neaf": "0.0::DOUBLE",
        "score_risco_financeiro": "0.0::DOUBLE", "qtd_indicios_neaf": "0::BIGINT",
        "prioridade_fiscalizacao": "3::INTEGER"}
    return f"""
    SELECT m.cnpj, m.ano_referencia, {_risk_columns(scores)}
    FROM ({_measures_shown()}) m LEFT JOIN ({_companies_named()}) c USING (cnpj)
    WHERE m.duvidosa {when}
    ORDER BY m.pontos DESC, m.ativo_total DESC NULLS FIRST, m.cnpj, m.ano_referencia,
             c.periodo_cadastro
    LIMIT 500"""


# The classification fields of a sector, with what stands for a missing one.
SECTOR_FIELDS = {"cd_cnae": ("cnae_divisao", "N/A"), "de_cnae": ("de_cnae", "Não Classificado"),
                 "cnae_secao": ("cnae_secao", "N/A"),
                 "cnae_secao_descricao": ("cnae_secao_descricao", "Não Classificado"),
                 "cnae_divisao": ("cnae_divisao", "N/A")}
BENCHMARK_KEYS = ", ".join(
    f"COALESCE(ec.{c}, '{other}') AS {name}" for name, (c, other) in SECTOR_FIELDS.items()
) + f", {SECTOR} AS cnae_divisao_descricao"
BENCHMARK_MEANS = {
    "ativo_total_setor": "ativo_total", "receita_liquida_setor": "receita_liquida",
    "resultado_liquido_setor": "resultado_liquido",
    "liquidez_corrente_setor": "liquidez_corrente", "endividamento_setor": "endividamento_geral",
    "margem_liquida_setor": "margem_liquida_perc", "roe_setor": "roe_retorno_patrimonio_perc",
}


def _money_mean(column: str) -> str:
    """Mean of a decimal rounded half up to cents, in whole cents."""
    total = f"SUM(CAST({column} * 100 AS HUGEINT))"
    count = f"COUNT({column})"
    return (f"CAST(CASE WHEN {total} < 0 THEN -1 ELSE 1 END * "
            f"((2 * abs({total}) + {count}) // NULLIF(2 * {count}, 0)) AS DOUBLE) / 100")


def _benchmark_mean(column: str) -> str:
    if column in ("ativo_total", "receita_liquida", "resultado_liquido"):
        return _money_mean(f"ind.{column}")
    return rounded(f"AVG(ind.{column})")


BENCHMARK_FIGURES = "COUNT(DISTINCT ec.cnpj) AS qtd_empresas_setor, " + ", ".join(
    f"{_benchmark_mean(c)} AS media_{n}" for n, c in BENCHMARK_MEANS.items()
) + f""",
      ROUND(MIN(ind.liquidez_corrente), 2) AS min_liquidez_setor,
      ROUND(MAX(ind.liquidez_corrente), 2) AS max_liquidez_setor,
      {rounded('MIN(ind.margem_liquida_perc)')} AS min_margem_liquida_setor,
      {rounded('MAX(ind.margem_liquida_perc)')} AS max_margem_liquida_setor"""
BENCHMARK_ORDER = """qtd_empresas_setor DESC, cd_cnae, de_cnae, cnae_secao,
      cnae_secao_descricao, cnae_divisao, cnae_divisao_descricao"""


def _benchmark_dynamic(year=None, cut="", registry="registry") -> str:
    where = f"WHERE ind.ano_referencia = {year}" if year else ""
    return f"""
    SELECT {BENCHMARK_KEYS}, CAST({year or 2024} AS INTEGER) AS ano_referencia,
      {BENCHMARK_FIGURES}
    FROM indicators ind LEFT JOIN {registry} ec ON ind.cnpj = ec.cnpj {where}
    GROUP BY ALL HAVING COUNT(DISTINCT ec.cnpj) >= 3
    ORDER BY {BENCHMARK_ORDER} {cut}"""


def _benchmark_by_year(extra: str = "") -> str:
    return f"""
    SELECT {BENCHMARK_KEYS}, ind.ano_referencia, {BENCHMARK_FIGURES} {extra}
    FROM indicators ind LEFT JOIN registry ec ON ind.cnpj = ec.cnpj
    GROUP BY ALL HAVING COUNT(DISTINCT ec.cnpj) >= 3"""


SUSPICIOUS = {
    "liquidity": ("liquidez_corrente", "< 0.5", "ASC NULLS LAST"),
    "debt": ("endividamento_geral", "> 0.8", "DESC NULLS FIRST"),
    "margin": ("margem_liquida_perc", "< -10", "ASC NULLS LAST"),
    "roa": ("roa_retorno_ativo_perc", "< -10", "ASC NULLS LAST"),
    "roe": ("roe_retorno_patrimonio_perc", "< -20", "ASC NULLS LAST"),
}


def _suspicious(name: str, cut: str = "", year=None, population="filtered") -> str:
    column, test, order = SUSPICIOUS[name]
    when = f"AND ind.ano_referencia = {year}" if year else ""
    base = f"(ind.{column} {test})" if population == "filtered" else "TRUE"
    return f"""
    SELECT p.cnpj, p.nm_razao_social, p.cd_uf, p.setor, {rounded('p.valor')} AS valor_indicador,
      {millions('p.ativo_total')} AS ativo_milhoes,
      {millions('p.receita_liquida')} AS receita_milhoes, sr.score_risco_total,
      {rounded('p.media')} AS media_setor, {rounded('p.valor - p.media')} AS desvio_setor,
      p.periodo_cadastro
    FROM (
      SELECT ec.cnpj, ec.nm_razao_social, ec.cd_uf, {SECTOR} AS setor, ind.{column} AS valor,
        ind.ativo_total, ind.receita_liquida, ec.ano_referencia AS periodo_cadastro,
        ind.ano_referencia AS ano, ind.{column} {test} AS fora,
        AVG(ind.{column}) FILTER ({base}) OVER (PARTITION BY {SECTOR}) AS media
      FROM {J1} WHERE TRUE {when}) p
    LEFT JOIN risk sr ON p.cnpj = sr.cnpj AND p.ano = sr.ano_referencia
    WHERE p.fora
    ORDER BY valor_indicador {order}, p.cnpj, p.periodo_cadastro {cut}"""


# Fields of an account, and how many companies must use one that is listed.
ACCOUNT = ["cd_conta", "nm_conta", "descricao_grupo_balanco", "cd_conta_referencial", "tipo_conta",
           "nivel_conta", "cd_conta_sint1", "nm_conta_sint1"]
LEAST_USERS = 5


def _usage(year=None, cut="") -> str:
    when = f"AND ano_referencia // 100 = {year}" if year else ""
    return f"""
    SELECT {', '.join(ACCOUNT)}, COUNT(cnpj) AS qtd_empresas_usam
    FROM (SELECT DISTINCT {', '.join(ACCOUNT)}, cnpj FROM chart WHERE tipo_conta = 'A' {when})
    GROUP BY ALL HAVING COUNT(cnpj) >= {LEAST_USERS}
    ORDER BY qtd_empresas_usam DESC, cd_conta, nm_conta {cut}"""


def _listed(table: str, columns: list[str], order: list[str], on: str, sector: str = SECTOR,
            registry: str = "registry", where: str = "", cut: str = "", period: bool = True) -> str:
    """Rows of a table beside their companies; money as doubles."""
    money = {"ativo_total", "passivo_pl_total", "diferenca_absoluta", "saldo_anterior",
             "saldo_atual", "variacao_absoluta"}
    shown = [f"CAST(x.{c} AS DOUBLE) AS {c}" if c in money else
             f"CAST(x.{c} AS VARCHAR) AS {c}" if c.startswith("data_") else f"x.{c}" for c in columns]
    company = ["ec.nm_razao_social", f"{sector} AS setor", "ec.cd_uf"]
    company += ["ec.ano_referencia AS periodo_cadastro"] if period else []
    return f"""
    SELECT {', '.join(shown + company)} FROM {registry} ec JOIN {table} x ON {on}
    {f'WHERE {where}' if where else ''} ORDER BY {', '.join(order)} {cut}"""


def _equation_list(where: str = "", cut: str = "") -> str:
    return _listed(
        "equation", ["cnpj", "ano_referencia", "data_fim_periodo", "ativo_total", "passivo_pl_total",
                     "diferenca_absoluta", "percentual_diferenca", "classificacao_inconsistencia",
                     "score_risco_equacao"],
        ["x.score_risco_equacao DESC", "abs(x.diferenca_absoluta) DESC", "x.cnpj", "x.ano_referencia"],
        "x.cnpj = ec.cnpj AND x.ano_referencia = ec.ano_referencia", period=False,
        where=f"x.classificacao_inconsistencia <> 'OK' {where}", cut=cut)


def _variation_list(registry: str = "registry", where: str = "", cut: str = "") -> str:
    return _listed(
        "variations", ["cnpj", "cd_conta", "ano_referencia", "saldo_anterior", "saldo_atual",
                       "variacao_absoluta", "variacao_percentual", "classificacao_variacao",
                       "score_risco_variacao"],
        ["x.score_risco_variacao DESC", "abs(x.variacao_percentual) DESC", "x.cnpj", "x.cd_conta",
         "x.ano_referencia", "ec.ano_referencia"], "x.cnpj = ec.cnpj", registry=registry,
        where="x.classificacao_variacao IN (SELECT 'Variação ' || g FROM "
              f"(VALUES ('Extrema'), ('Muito Alta'), ('Alta')) AS grades(g)) {where}", cut=cut)


def _neaf_list(registry: str = "registry", cut: str = "") -> str:
    return _listed(
        "neaf_scores", ["cnpj", "qtd_total_indicios", "qtd_tipos_indicios_distintos",
                        "score_risco_neaf", "classificacao_risco_neaf"],
        ["x.score_risco_neaf DESC", "x.cnpj", "ec.ano_referencia"], "x.cnpj = ec.cnpj",
        sector="ec.cnae_divisao_descricao", registry=registry, cut=cut)


COMPANIES = f"""
    SELECT {SECTOR_TWO} AS setor, ec.cnpj, ec.nm_razao_social, ec.nm_fantasia, ec.cd_uf,
      ec.empresa_grande_porte, {millions('ind.ativo_total')} AS ativo_milhoes,
      {millions('ind.receita_liquida')} AS receita_milhoes,
      ROUND(ind.liquidez_corrente, 2) AS liquidez,
      {rounded('ind.margem_liquida_perc')} AS margem_liquida, sr.score_risco_total,
      sr.classificacao_risco, ec.ano_referencia AS periodo_cadastro
    FROM {J1} LEFT JOIN risk sr
      ON ec.cnpj = sr.cnpj AND ec.ano_referencia // 100 = sr.ano_referencia
    WHERE {SECTOR_TWO} IS NOT NULL {{where}} {{cut}}"""
LARGEST = f"""QUALIFY ROW_NUMBER() OVER (PARTITION BY {SECTOR_TWO} ORDER BY
      ind.ativo_total DESC NULLS FIRST, ec.cnpj, ec.ano_referencia) <= 200"""

# Whole lists; totals, frequencies, filters, searches and rankings are taken from them.
LISTS = {
    "sector_list": _sectors(),
    "sector_year": _sector_aggregate(f"{SECTOR} AS setor, ind.ano_referencia"),
    "risk_all": _high_risk(),
    "fallback_list": _fallback(),
    "companies_list": COMPANIES.format(where="", cut=""),
    "suspects": _suspicious("liquidity"),
    "usage_list": _usage(),
    "account_list": """
      SELECT u.*, COALESCE(s.media, 0) AS media_saldo_milhoes,
        COALESCE(s.total, 0) AS total_saldo_bilhoes, COALESCE(s.menor, 0) AS min_saldo_milhoes,
        COALESCE(s.maior, 0) AS max_saldo_milhoes
      FROM usage_list u LEFT JOIN (
        SELECT cd_conta, CAST(SUM(saldo_final_contabil) AS DOUBLE) / COUNT(*) / 1000000 AS media,
          CAST(SUM(saldo_final_contabil) AS DOUBLE) / 1000000000 AS total,
          CAST(MIN(saldo_final_contabil) AS DOUBLE) / 1000000 AS menor,
          CAST(MAX(saldo_final_contabil) AS DOUBLE) / 1000000 AS maior
        FROM account_balances GROUP BY cd_conta) s ON u.cd_conta = s.cd_conta""",
    "account_shown": "SELECT * FROM account_list WHERE qtd_empresas_usam >= 10",
    "neaf_list": _neaf_list(registry="registry", cut=""),
    "equation_list": _equation_list(where="", cut=""),
    "variation_list": _variation_list(registry="registry", where="", cut=""),
    "benchmark_list": _benchmark_dynamic(),
    "stored_benchmark": _benchmark_by_year(),
    "latest_measures": """
      SELECT * FROM indicators
      QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj ORDER BY ano_referencia DESC) = 1""",
    "latest_filed": """
      SELECT * FROM registry
      QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj ORDER BY ano_referencia DESC) = 1""",
    "latest_risk": """
      SELECT * FROM risk
      QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj ORDER BY ano_referencia DESC) = 1""",
    "compared_base": """
      SELECT ind.cnpj, ind.ano_referencia, s.setor, s.qtd_empresas, v.indicador,
        COALESCE(v.valor, 0) AS valor_empresa, COALESCE(v.media, 0) AS media_setor,
        CAST(v.lo AS DOUBLE) AS ideal_min, CAST(v.hi AS DOUBLE) AS ideal_max
      FROM latest_measures ind JOIN latest_filed ec ON ind.cnpj = ec.cnpj
      JOIN sector_year s ON s.setor = ec.cnae_divisao_descricao
        AND s.ano_referencia = ind.ano_referencia,
      LATERAL (VALUES
        ('Liquidez Corrente', ind.liquidez_corrente, s.media_liquidez, 1, 2),
        ('Endividamento Geral', ind.endividamento_geral, s.media_endividamento, 0, 0.5),
        ('Margem Líquida (%)', ind.margem_liquida_perc, s.media_margem_liquida, 5, 100),
        ('ROA (%)', ind.roa_retorno_ativo_perc, s.media_roa, 5, 100),
        ('ROE (%)', ind.roe_retorno_patrimonio_perc, s.media_roe, 10, 100)
      ) v(indicador, valor, media, lo, hi)""",
    "deviations": """
      SELECT *, CASE WHEN media_setor = 0 THEN CAST(0 AS DOUBLE)
        ELSE (valor_empresa - media_setor) / abs(media_setor) * 100 END AS desvio_perc
      FROM compared_base""",
    "sector_long": """
      SELECT s.setor, v.indicador, v.valor FROM sector_list s,
      LATERAL (VALUES ('Liquidez Corrente', s.media_liquidez),
        ('Endividamento Geral', s.media_endividamento),
        ('Margem Líquida', s.media_margem_liquida), ('ROA', s.media_roa),
        ('ROE', s.media_roe)) v(indicador, valor)""",
    "sector_filled": "SELECT setor, indicador, COALESCE(valor, 0) AS valor FROM sector_long",
    "boxes": """
      SELECT indicador, quantile_cont(valor, 0.25) AS q1, quantile_cont(valor, 0.5) AS mediana,
        quantile_cont(valor, 0.75) AS q3 FROM sector_filled GROUP BY indicador""",
    "fences": """
      SELECT *, q1 - (q3 - q1) * CAST(1.5 AS DOUBLE) AS cerca_inferior,
        q3 + (q3 - q1) * CAST(1.5 AS DOUBLE) AS cerca_superior FROM boxes""",
}


def _q(sql: str) -> str:
    return with_tables(sql, LISTS)


def _top(table: str, column: str, k: int, ties: str) -> str:
    return _q(f"""SELECT * REPLACE (COALESCE(CAST({column} AS DOUBLE), 0) AS {column})
        FROM {table} ORDER BY COALESCE(CAST({column} AS DOUBLE), 0) DESC, {ties} LIMIT {k}""")


def _frequency(table: str, column: str, tail: str = "", by: str = "") -> str:
    return _q(f"""SELECT {by}{column}, COUNT(*) AS quantidade FROM {table}
        WHERE {column} IS NOT NULL GROUP BY ALL {tail}""")


BALANCE_MONEY = ["ativo_total", "ativo_circulante", "ativo_nao_circulante", "passivo_total",
                 "passivo_circulante", "passivo_nao_circulante", "patrimonio_liquido",
                 "passivo_pl_total"]
INCOME_MONEY = ["receita_bruta", "deducoes_receita", "receita_liquida", "custos_totais",
                "despesas_totais", "lucro_bruto", "resultado_liquido"]
INDICATOR_MONEY = ["ativo_total", "ativo_circulante", "ativo_nao_circulante", "passivo_total",
                   "passivo_circulante", "passivo_nao_circulante", "patrimonio_liquido",
                   "receita_liquida", "lucro_bruto", "resultado_liquido", "custos_totais",
                   "despesas_totais"]
VARIATION_MONEY = ["saldo_anterior", "saldo_atual", "variacao_absoluta"]


def _plain(money: list[str], date: bool = False) -> str:
    """``*`` with money as double and dates as text."""
    parts = [f"CAST({c} AS DOUBLE) AS {c}" for c in money]
    if date:
        parts.append("CAST(data_fim_periodo AS VARCHAR) AS data_fim_periodo")
    return f"* REPLACE ({', '.join(parts)})"


def _latest(table: str, money: list[str]) -> str:
    return _q(f"""SELECT {_plain(money, True)}, strftime(data_fim_periodo, '%m/%Y') AS mes
        FROM {table} QUALIFY ROW_NUMBER() OVER (PARTITION BY cnpj
          ORDER BY data_fim_periodo DESC, ano_referencia DESC) = 1""")


def _kpi(table: str, figures: str) -> str:
    return _q(f"SELECT {figures} FROM {table}")


def _benchmark_top(column: str) -> str:
    return _top("benchmark_list", column, 15, BENCHMARK_ORDER.split(",", 1)[1])


FEATURES = """score_risco_total, score_equacao_contabil, score_neaf, ativo_milhoes,
    receita_milhoes, liquidez, endividamento, margem_liquida"""


def _scaled() -> str:
    parts = ", ".join(
        rounded(f"({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({c}) OVER (), 0), 1)", 6)
        + f" AS {c}_padronizado" for c in FEATURES.replace("\n", " ").replace(" ", "").split(",")
    )
    return _q(f"SELECT cnpj, ano_referencia, periodo_cadastro, {parts} FROM risk_all")


def _given() -> str:
    """The list under a model given by a rule and four centres, in the order of FEATURES."""
    names = FEATURES.replace("\n", " ").replace(" ", "").split(",")
    centres = [
        [3, 0, 0, 10, 5, 1, 0.5, 5], [5, 1, 1, 100, 50, 0.8, 0.7, 0],
        [8, 2, 2, 500, 200, 0.3, 0.9, -20], [10, 5, 5, 1000, 800, 2, 0.1, 10],
    ]
    far = ", ".join(
        " + ".join(f"pow(CAST({c} AS DOUBLE) - CAST({x} AS DOUBLE), 2)" for c, x in zip(names, centre))
        for centre in centres)
    return f"""
    SELECT *, CASE WHEN score_ml_total > 0 AND score_ml_total <= 5 THEN 'Baixa'
      WHEN score_ml_total > 5 AND score_ml_total <= 8 THEN 'Média'
      WHEN score_ml_total > 8 AND score_ml_total <= 11 THEN 'Alta'
      WHEN score_ml_total > 11 AND score_ml_total <= 100 THEN 'Crítica' END AS prioridade_ml
    FROM (
      SELECT * EXCLUDE (longe), CAST(list_position(longe, list_min(longe)) - 1 AS INTEGER) AS cluster_ml,
        CAST(CASE WHEN score_risco_total >= 7 THEN 5 ELSE 0 END AS INTEGER) AS score_ml_anomalia,
        CASE WHEN score_risco_total >= 7 THEN 5 ELSE 0 END + score_risco_total AS score_ml_total
      FROM (SELECT *, [{far}] AS longe FROM risk_all))"""


# The trees of the given forest, as conditions; path length over the expected one.
GIVEN_TREES = [
    """CASE WHEN score_risco_total < 5 THEN CASE WHEN ativo_milhoes < 100 THEN 0.75 ELSE 0.625 END
       WHEN liquidez < 1 THEN CASE WHEN endividamento < 0.7::DOUBLE THEN 0.5 ELSE 0.375 END
       ELSE 0.5625 END""",
    """CASE WHEN receita_milhoes < 50 THEN CASE WHEN margem_liquida < 0 THEN 0.4375
         WHEN liquidez < 0.5 THEN 0.5 ELSE 1 END
       WHEN score_risco_total < 7 THEN 0.625 ELSE 0.25 END""",
    """CASE WHEN endividamento < 0.5 THEN CASE WHEN score_neaf < 1 THEN 0.625 ELSE 0.4375 END
       WHEN ativo_milhoes < 0.25 THEN 0.125 WHEN margem_liquida < 10 THEN 0.5625
       WHEN receita_milhoes < 1000 THEN 0.375 ELSE 0.15625 END""",
]


def _forest_scores() -> str:
    names = FEATURES.replace("\n", " ").replace(" ", "").split(",")
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    path = " + ".join(f"CAST({tree} AS DOUBLE)" for tree in GIVEN_TREES)
    return f"""SELECT cnpj, ano_referencia, periodo_cadastro,
        CASE WHEN {known} THEN ROUND(pow(2::DOUBLE, -({path}) / 3), 9) END AS score_anomalia
      FROM risk_all"""


def _ordered(table: str, order: str) -> str:
    return _q(f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS posicao FROM {table}")


def _view(table: str, **headings: str) -> str:
    shown = ", ".join(f'{c} AS "{h}"' for c, h in headings.items())
    return _q(f"SELECT {shown} FROM {table}")


def oracle_sql() -> dict[str, str]:
    sql = {
        "overview_summary": _q("""
            SELECT COUNT(DISTINCT cnpj) AS total_empresas,
              COUNT(DISTINCT ano_referencia) AS total_anos,
              MAX(ano_referencia) AS ano_mais_recente,
              COUNT(DISTINCT cnae_divisao) AS total_setores,
              COUNT(DISTINCT cd_uf) AS total_estados
            FROM registry WHERE ano_referencia > 0"""),
        "sector_indicators": _q(_sectors(cut="LIMIT 50")),
        "sector_indicators_year": _q(_sectors(YEAR, "LIMIT 50")),
        "export_csv": _q(_sectors(cut="LIMIT 50")),
        "companies_by_sector": _q(COMPANIES.format(where="", cut=LARGEST)),
        "company_profile_registry": _q("SELECT * FROM latest_filed WHERE length(cnpj) = 14"),
        "company_profile_indicators": _q(f"SELECT {_plain(INDICATOR_MONEY)} FROM indicators"),
        "company_profile_balance": _q(f"SELECT {_plain(BALANCE_MONEY, True)} FROM balance"),
        "company_profile_income": _q(f"SELECT {_plain(INCOME_MONEY, True)} FROM income"),
        "company_profile_risk": _q("SELECT * FROM risk"),
        "latest_registry": _q("SELECT * FROM latest_filed"),
        "latest_balance": _latest("balance", BALANCE_MONEY),
        "latest_income": _latest("income", INCOME_MONEY),
        "balance_series": _q("""
            SELECT cnpj, CAST(data_fim_periodo AS VARCHAR) AS data_fim_periodo,
              CAST(ativo_total AS DOUBLE) AS ativo_total,
              CAST(passivo_total AS DOUBLE) AS passivo_total,
              CAST(patrimonio_liquido AS DOUBLE) AS patrimonio_liquido FROM balance"""),
        "income_series": _q("""
            SELECT cnpj, CAST(data_fim_periodo AS VARCHAR) AS data_fim_periodo,
              CAST(receita_liquida AS DOUBLE) AS receita_liquida,
              CAST(custos_totais AS DOUBLE) AS custos_totais,
              CAST(despesas_totais AS DOUBLE) AS despesas_totais,
              CAST(resultado_liquido AS DOUBLE) AS resultado_liquido FROM income"""),
        "available_years": _q("""
            SELECT DISTINCT CAST(ano_referencia // 100 AS INTEGER) AS ano FROM balance"""),
        "indicator_trend": _q("""
            SELECT i.cnpj, i.ano_referencia AS ano, v.indicador, v.valor FROM indicators i,
            LATERAL (VALUES ('liquidez_corrente', i.liquidez_corrente),
              ('endividamento_geral', i.endividamento_geral),
              ('margem_liquida_perc', i.margem_liquida_perc),
              ('roe_retorno_patrimonio_perc', i.roe_retorno_patrimonio_perc)
            ) v(indicador, valor)"""),
        "risk_trend": _q("""
            SELECT cnpj, ano_referencia AS ano, score_risco_total, score_equacao_contabil,
              score_neaf FROM risk QUALIFY COUNT(*) OVER (PARTITION BY cnpj) > 1"""),
        "risk_components": _q("""
            SELECT r.cnpj, r.ano_referencia, v.componente, v.pontuacao FROM latest_risk r,
            LATERAL (VALUES ('Equação Contábil', r.score_equacao_contabil),
              ('NEAF', r.score_neaf), ('Risco Financeiro', r.score_risco_financeiro)
            ) v(componente, pontuacao)"""),
        "risk_band": _q("""
            SELECT cnpj, ano_referencia, score_risco_total, classificacao_risco,
              CASE WHEN score_risco_total >= 7 THEN 'Alto' WHEN score_risco_total >= 5
                THEN 'Médio' ELSE 'Baixo' END AS faixa,
              CASE WHEN score_risco_total >= 7 THEN 'ALERTA CRÍTICO'
                WHEN score_risco_total >= 5 THEN 'ALERTA ALTO'
                ELSE 'RISCO CONTROLADO' END AS alerta,
              CAST(COALESCE(qtd_indicios_neaf, 0) AS INTEGER) AS indicios FROM latest_risk"""),
        "company_vs_sector": _q("""
            SELECT *, CASE WHEN valor_empresa = 0 AND media_setor = 0 THEN 'Sem dados'
                WHEN valor_empresa BETWEEN ideal_min AND ideal_max THEN 'Normal'
                WHEN abs(desvio_perc) > 50 THEN 'Anômalo (>50% de desvio)'
                WHEN abs(desvio_perc) > 25 THEN 'Atenção (>25% de desvio)'
                ELSE 'Levemente diferente' END AS status FROM deviations"""),
        "company_profile_radar": _q("""
            SELECT cnpj, ano_referencia, setor, indicador,
              CASE WHEN lo = hi THEN CAST(50 AS DOUBLE)
                ELSE (valor_empresa - lo) / (hi - lo) * 100 END AS empresa_norm,
              CASE WHEN lo = hi THEN CAST(50 AS DOUBLE)
                ELSE (media_setor - lo) / (hi - lo) * 100 END AS setor_norm
            FROM (SELECT *, LEAST(valor_empresa, media_setor, 0) AS lo,
                    GREATEST(valor_empresa, media_setor, ideal_max) AS hi
                  FROM compared_base)"""),
        "high_risk": _q(_high_risk(500)),
        "high_risk_year": _q(_high_risk(500, YEAR)),
        "risk_fallback_year": _q(_fallback(YEAR)),
        "risk_fallback": _q("SELECT * FROM fallback_list"),
        "source_fallback": _q(f"""
            SELECT 'tabela preenchida' AS caso, * FROM ({_high_risk(500)})
            UNION ALL BY NAME SELECT 'tabela vazia' AS caso, * FROM fallback_list
            UNION ALL BY NAME SELECT 'tabela ausente' AS caso, * FROM fallback_list"""),
        "high_risk_filtered": _q("""
            SELECT * FROM risk_all WHERE score_risco_total >= 5 AND cd_uf = 'NATION_7'"""),
        "account_usage": _q(_usage(cut="LIMIT 200")),
        "account_usage_year": _q(_usage(YEAR, "LIMIT 200")),
        "account_balance_stats": _q("SELECT * FROM account_list"),
        "account_dispersion": _q("""
            SELECT cd_conta, nm_conta, media_saldo_milhoes, min_saldo_milhoes, max_saldo_milhoes,
              COALESCE((max_saldo_milhoes - min_saldo_milhoes)
                / NULLIF(abs(media_saldo_milhoes), 0) * 100, 0) AS coef_variacao
            FROM account_list ORDER BY coef_variacao DESC, cd_conta, nm_conta LIMIT 20"""),
        "accounts_filtered": _q("""
            SELECT * FROM account_list WHERE descricao_grupo_balanco = 'ECONOMY'
              AND nivel_conta = 3 AND qtd_empresas_usam >= 10"""),
        "account_search": _q("""
            SELECT * FROM account_list
            WHERE COALESCE(regexp_matches(nm_conta, 'promo.*1|#2[0-4]', 'i'), FALSE)
               OR COALESCE(regexp_matches(cd_conta, 'promo.*1|#2[0-4]', 'i'), FALSE)"""),
        "accounts_by_group": _q("""
            SELECT descricao_grupo_balanco AS grupo, COUNT(cd_conta) AS qtd_contas,
              CAST(SUM(qtd_empresas_usam) AS BIGINT) AS total_uso FROM account_shown
            WHERE descricao_grupo_balanco IS NOT NULL AND descricao_grupo_balanco != ''
            GROUP BY descricao_grupo_balanco HAVING COUNT(cd_conta) > 0"""),
        "universal_accounts": _q("""
            SELECT cd_conta, nm_conta, qtd_empresas_usam FROM account_shown
            WHERE qtd_empresas_usam >= (SELECT MAX(qtd_empresas_usam) FROM account_shown) * 0.8
            ORDER BY qtd_empresas_usam DESC, cd_conta, nm_conta LIMIT 10"""),
        "account_summary": _kpi("account_shown", """COUNT(*) AS total_contas,
            ROUND(AVG(qtd_empresas_usam), 8) AS media_empresas_conta,
            ROUND(SUM(total_saldo_bilhoes), 8) AS total_saldo_bilhoes,
            (SELECT nm_conta FROM account_shown
             ORDER BY qtd_empresas_usam DESC, cd_conta, nm_conta LIMIT 1) AS conta_mais_usada,
            MAX(qtd_empresas_usam) AS uso_maximo"""),
        "account_balances": _q("""
            SELECT cnpj, cd_conta, CAST(saldo_final_contabil AS DOUBLE) AS saldo_final_contabil,
              CAST(data_fim_periodo AS VARCHAR) AS data_fim_periodo FROM account_balances
            QUALIFY ROW_NUMBER() OVER (PARTITION BY cd_conta ORDER BY
              account_balances.data_fim_periodo DESC, cnpj,
              account_balances.saldo_final_contabil) <= 1000"""),
        "neaf_indications": _q("""
            SELECT cnpj, descricao_indicio, complemento_indicio, COUNT(*) AS qtd_ocorrencias
            FROM neaf_indications GROUP BY cnpj, descricao_indicio, complemento_indicio
            ORDER BY qtd_ocorrencias DESC, cnpj, descricao_indicio, complemento_indicio
            LIMIT 500"""),
        "neaf_scores": _q(_neaf_list(registry="registry", cut="LIMIT 500")),
        "neaf_scores_latest": _q(_neaf_list(registry="latest_filed", cut="LIMIT 500")),
        "neaf_filtered": _q("""
            SELECT * FROM neaf_list WHERE classificacao_risco_neaf = 'MODERADO'
              AND cd_uf = 'NATION_3' AND qtd_total_indicios >= 1"""),
        "neaf_by_sector": _q("""
            SELECT setor, CAST(SUM(qtd_total_indicios) AS BIGINT) AS qtd_indicios FROM neaf_list
            WHERE setor IS NOT NULL GROUP BY setor ORDER BY qtd_indicios DESC, setor LIMIT 10"""),
        "points_neaf": _q("SELECT * EXCLUDE (periodo_cadastro) FROM neaf_list"),
        "equation_anomalies": _q(_equation_list(where="", cut="LIMIT 500")),
        "equation_anomalies_year": _q(_equation_list(
            where=f"AND x.ano_referencia // 100 = {YEAR}", cut="LIMIT 500")),
        "variation_anomalies": _q(_variation_list(
            registry="registry", where="", cut="LIMIT 500")),
        "variation_anomalies_year": _q(_variation_list(
            registry="registry", where=f"AND x.ano_referencia = {YEAR}", cut="LIMIT 500")),
        "variation_anomalies_latest": _q(_variation_list(
            registry="latest_filed", where="", cut="LIMIT 500")),
        "benchmark_dynamic": _q(_benchmark_dynamic(cut="LIMIT 100")),
        "benchmark_dynamic_latest": _q(_benchmark_dynamic(cut="LIMIT 100", registry="latest_filed")),
        "benchmark_dynamic_year": _q(_benchmark_dynamic(YEAR, "LIMIT 100")),
        "benchmark_stored": _q("SELECT * FROM stored_benchmark"),
        "sector_benchmark": _q(f"""
            SELECT 'ano gravado' AS caso, * FROM stored_benchmark WHERE ano_referencia = {YEAR}
            UNION ALL SELECT 'ano sem linhas' AS caso, *
            FROM ({_benchmark_dynamic(YEAR + 1, "LIMIT 100")})"""),
        "benchmark_filtered": _q("""
            SELECT * FROM benchmark_list WHERE cnae_divisao_descricao = 'MACHINERY'"""),
        "points_benchmark": _q("""
            SELECT cnae_divisao_descricao, de_cnae, cnae_secao, media_liquidez_corrente_setor,
              media_margem_liquida_setor, qtd_empresas_setor, media_roe_setor
            FROM benchmark_list"""),
        "build_benchmark": _q(_benchmark_by_year("".join(
            f", ROUND(STDDEV_SAMP(CAST(ind.{c} AS DOUBLE)), 2) AS desvio_padrao_{n}"
            for n, c in BENCHMARK_MEANS.items()))),
        "build_indicators": _q(f"SELECT {_plain(INDICATOR_MONEY)} FROM indicators"),
        "build_balance": _q(f"""
            SELECT * REPLACE (CAST(passivo_total + patrimonio_liquido AS DOUBLE)
              AS passivo_pl_total) FROM (SELECT {_plain(BALANCE_MONEY, True)} FROM balance)"""),
        "build_income": _q(f"SELECT {_plain(INCOME_MONEY, True)} FROM income"),
        "build_equation_check": _q(f"""
            SELECT {_plain(['ativo_total', 'passivo_pl_total', 'diferenca_absoluta'], True)}
            FROM equation"""),
        "build_variations": _q(f"SELECT {_plain(VARIATION_MONEY)} FROM variations"),
        "build_neaf_indications": _q("SELECT * FROM neaf_indications"),
        "build_neaf_score": _q("SELECT * FROM neaf_scores"),
        "build_risk_score": _q("SELECT * FROM risk"),
        "distinct_values": _q("""
            SELECT 'cd_uf' AS campo, cd_uf AS valor FROM registry WHERE cd_uf IS NOT NULL
            UNION SELECT 'cnae_divisao_descricao', cnae_divisao_descricao FROM registry
              WHERE cnae_divisao_descricao IS NOT NULL
            UNION SELECT 'empresa_grande_porte', empresa_grande_porte FROM registry
              WHERE empresa_grande_porte IS NOT NULL"""),
        "clean_table": _q("""
            SELECT cnpj, ano_referencia,
              COALESCE(nm_fantasia, '') AS nm_fantasia,
              COALESCE(cnae_divisao_descricao, '') AS cnae_divisao_descricao,
              CAST(cnae_secao AS DOUBLE) AS cnae_secao,
              COALESCE(CAST(receita_texto AS DOUBLE), 0) AS receita_texto,
              COALESCE(liquidez_corrente, 0) AS liquidez_corrente
            FROM (SELECT ec.cnpj, ind.ano_referencia, ec.nm_fantasia, ec.cnae_divisao_descricao,
                    ec.cnae_secao, CAST(ind.receita_liquida AS VARCHAR) AS receita_texto,
                    ind.liquidez_corrente
                  FROM registry ec JOIN indicators ind ON ec.cnpj = ind.cnpj
                    AND ec.ano_referencia // 100 = ind.ano_referencia)"""),
        "view_balance": _view(
            f"(SELECT {_plain(BALANCE_MONEY, True)} FROM balance)",
            data_fim_periodo="Período", ativo_total="Ativo Total", ativo_circulante="Ativo Circ.",
            ativo_nao_circulante="Ativo Não Circ.", passivo_total="Passivo Total",
            passivo_circulante="Passivo Circ.", passivo_nao_circulante="Passivo Não Circ.",
            patrimonio_liquido="Patrimônio Líquido"),
        "view_income": _view(
            f"(SELECT {_plain(INCOME_MONEY, True)} FROM income)",
            data_fim_periodo="Período", receita_bruta="Receita Bruta",
            deducoes_receita="Deduções", receita_liquida="Receita Líq.", custos_totais="Custos",
            despesas_totais="Despesas", lucro_bruto="Lucro Bruto",
            resultado_liquido="Resultado Líq."),
        "view_variation": _view(
            f"({_variation_list(registry='registry', where='', cut='LIMIT 500')})",
            nm_razao_social="Razão Social", cnpj="CNPJ", setor="Setor", cd_conta="Conta",
            saldo_anterior="Saldo Anterior", saldo_atual="Saldo Atual",
            variacao_absoluta="Variação Abs.", variacao_percentual="Variação %",
            classificacao_variacao="Classificação", score_risco_variacao="Score"),
        **{f"one_company_{name}": _q(f"""SELECT {columns} FROM {table}
              WHERE cnpj = (SELECT MIN(cnpj) FROM registry)""")
           for name, table, columns in (
               ("registry", "latest_filed", "*"),
               ("indicators", "indicators", _plain(INDICATOR_MONEY)),
               ("balance", "balance", _plain(BALANCE_MONEY, True)),
               ("income", "income", _plain(INCOME_MONEY, True)), ("risk", "risk", "*"))},
        "one_sector": _q(COMPANIES.format(
            where=f"AND {SECTOR_TWO} = 'MACHINERY' AND ind.ano_referencia = {YEAR}", cut=LARGEST)),
        "one_account": _q(f"""
            SELECT cnpj, cd_conta, CAST(saldo_final_contabil AS DOUBLE) AS saldo_final_contabil,
              CAST(data_fim_periodo AS VARCHAR) AS data_fim_periodo FROM account_balances
            WHERE cd_conta = (SELECT MIN(cd_conta) FROM account_balances)
              AND ano_referencia = {YEAR}
            ORDER BY account_balances.data_fim_periodo DESC, cnpj,
              account_balances.saldo_final_contabil LIMIT 1000"""),
        "one_neaf_company": _q("""
            SELECT cnpj, descricao_indicio, complemento_indicio, COUNT(*) AS qtd_ocorrencias
            FROM neaf_indications WHERE cnpj = (SELECT MIN(cnpj) FROM neaf_indications)
            GROUP BY ALL ORDER BY qtd_ocorrencias DESC, cnpj, descricao_indicio,
              complemento_indicio LIMIT 500"""),
        "suspicious_year": _q(_suspicious("liquidity", "LIMIT 100", YEAR)),
        "suspicious_sector_population": _q(
            _suspicious("liquidity", "LIMIT 100", population="sector")),
        "text_forms": _q("""
            SELECT cnpj, ano_referencia, right(cnpj, 4) AS sufixo,
              format('{:,.2f}', CAST(ativo_total AS DOUBLE)) AS ativo_texto,
              COALESCE(isfinite(liquidez_corrente), FALSE) AS finito FROM indicators"""),
        "file_labels": _q("""
            SELECT cnpj, ano_referencia, replace(lower(nm_razao_social), ' ', '_') AS rotulo,
              substr(nm_razao_social, 1, 10) AS curto
            FROM registry WHERE nm_razao_social IS NOT NULL"""),
        "priority_bands": _q("""
            SELECT cnpj, ano_referencia, score, CASE WHEN score > 0 AND score <= 5 THEN 'Baixa'
              WHEN score > 5 AND score <= 8 THEN 'Média' WHEN score > 8 AND score <= 11 THEN 'Alta'
              WHEN score > 11 AND score <= 100 THEN 'Crítica' END AS prioridade_ml
            FROM (SELECT cnpj, ano_referencia, score_risco_total
                    + COALESCE(score_risco_financeiro, 0) AS score FROM risk)"""),
        "ml_features": _q(f"""
            SELECT cnpj, ano_referencia, periodo_cadastro, {FEATURES} FROM risk_all"""),
        "ml_scaled": _scaled(),
        "given_priority": _q(_given()),
        "forest_scores": _q(_forest_scores()),
        "bucketed_variations": _q("SELECT * FROM variation_list"),
        "ordered_sectors": _ordered("sector_list", "qtd_empresas DESC, setor"),
        "ordered_high_risk": _ordered("risk_all", """prioridade_fiscalizacao,
            score_risco_total DESC NULLS FIRST, cnpj, ano_referencia, periodo_cadastro"""),
        "ordered_equation": _ordered("equation_list", """score_risco_equacao DESC NULLS FIRST,
            abs(diferenca_absoluta) DESC NULLS FIRST, cnpj, ano_referencia"""),
        "ordered_variations": _ordered("variation_list", """score_risco_variacao DESC NULLS FIRST,
            abs(variacao_percentual) DESC NULLS FIRST, cnpj, cd_conta, ano_referencia, periodo_cadastro"""),
        "ordered_neaf": _ordered("neaf_list",
                                 "score_risco_neaf DESC NULLS FIRST, cnpj, periodo_cadastro"),
        "given_summary": _kpi(f"({_given()})", """
            COUNT(*) FILTER (score_ml_anomalia = 5) AS anomalias,
            COUNT(*) FILTER (prioridade_ml = 'Crítica') AS criticas,
            COUNT(*) FILTER (prioridade_ml = 'Alta') AS altas,
            COUNT(DISTINCT cluster_ml) AS clusters"""),
        "given_top": _q(f"""
            SELECT cnpj, nm_razao_social, setor, cd_uf, score_ml_total, prioridade_ml,
              score_risco_total, ativo_milhoes, receita_milhoes, liquidez, endividamento
            FROM ({_given()})
            ORDER BY score_ml_total DESC, cnpj, ano_referencia, periodo_cadastro LIMIT 50"""),
        "given_points": _q(f"""
            SELECT cnpj, nm_razao_social, setor, cd_uf, ativo_milhoes, score_risco_total,
              score_ml_total, prioridade_ml FROM ({_given()})"""),
        "freq_given_priority": _frequency(f"({_given()})", "prioridade_ml"),
        "freq_given_cluster": _frequency(f"({_given()})", "cluster_ml"),
        "kpi_overview": _kpi("sector_list", """
            CAST(SUM(qtd_empresas) AS BIGINT) AS total_empresas,
            ROUND(AVG(media_ativo_milhoes), 8) AS media_ativo,
            ROUND(AVG(media_receita_milhoes), 8) AS media_receita,
            ROUND(AVG(media_liquidez), 8) AS media_liquidez,
            CASE WHEN AVG(media_liquidez) > 1 THEN 'Saudável' ELSE 'Atenção' END AS situacao"""),
        "kpi_high_risk": _q("""
            SELECT COUNT(*) AS empresas_listadas,
              ROUND(COALESCE(AVG(score_risco_total), 0), 8) AS score_medio,
              COUNT(*) FILTER (prioridade_fiscalizacao = 1) AS prioridade_critica,
              ROUND(COALESCE(SUM(ativo_milhoes), 0), 8) AS ativo_total_milhoes
            FROM risk_all WHERE score_risco_total >= 5"""),
        "kpi_accounts": _kpi("account_list", """COUNT(*) AS contas_analisadas,
            ROUND(AVG(qtd_empresas_usam), 8) AS media_empresas_conta,
            ROUND(SUM(total_saldo_bilhoes), 8) AS total_saldo_bilhoes,
            MAX(qtd_empresas_usam) AS conta_mais_usada"""),
        "kpi_neaf": _kpi("neaf_list", """COUNT(*) AS total_empresas,
            CAST(SUM(qtd_total_indicios) AS BIGINT) AS total_indicios,
            ROUND(AVG(score_risco_neaf), 8) AS media_score,
            COUNT(*) FILTER (classificacao_risco_neaf = 'CRÍTICO') AS criticos"""),
        "kpi_equation": _kpi("equation_list", """COUNT(*) AS total_inconsistencias,
            ROUND(AVG(percentual_diferenca), 8) AS media_percentual,
            COUNT(*) FILTER (classificacao_inconsistencia = 'Crítica') AS criticas,
            ROUND(AVG(score_risco_equacao), 8) AS media_score"""),
        "kpi_variation": _kpi("variation_list", """COUNT(*) AS total_variacoes,
            COUNT(DISTINCT cnpj) AS empresas_afetadas,
            COUNT(*) FILTER (classificacao_variacao = 'Variação Extrema') AS criticas,
            ROUND(AVG(abs(variacao_percentual)), 8) AS variacao_media"""),
        "kpi_benchmark": _kpi("benchmark_list", """COUNT(*) AS total_setores,
            CAST(SUM(qtd_empresas_setor) AS BIGINT) AS total_empresas,
            ROUND(AVG(media_liquidez_corrente_setor), 8) AS media_liquidez,
            ROUND(AVG(media_margem_liquida_setor), 8) AS media_margem"""),
        "indicator_stats": _q("""
            SELECT indicador, ROUND(AVG(valor), 8) AS media, ROUND(MEDIAN(valor), 8) AS mediana,
              ROUND(STDDEV_SAMP(valor), 8) AS desvio_padrao, MAX(valor) AS maximo,
              ROUND(quantile_cont(valor, 0.1), 8) AS p10,
              ROUND(quantile_cont(valor, 0.9), 8) AS p90
            FROM sector_long GROUP BY indicador"""),
        "indicator_histogram": _q("""
            SELECT indicador, faixa, COUNT(*) AS quantidade,
              ROUND(lo + faixa * ((hi - lo) / 30), 8) AS inicio,
              ROUND(lo + (faixa + 1) * ((hi - lo) / 30), 8) AS fim
            FROM (SELECT indicador, lo, hi, CAST(LEAST(COALESCE(
                    floor((valor - lo) * 30 / NULLIF(hi - lo, 0)), 0), 29) AS INTEGER) AS faixa
                  FROM sector_filled JOIN (SELECT indicador, MIN(valor) AS lo, MAX(valor) AS hi
                    FROM sector_filled GROUP BY indicador) USING (indicador))
            GROUP BY indicador, faixa, lo, hi"""),
        "indicator_box": _q("""
            SELECT indicador, ROUND(q1, 8) AS q1, ROUND(mediana, 8) AS mediana,
              ROUND(q3, 8) AS q3, ROUND(cerca_inferior, 8) AS cerca_inferior,
              ROUND(cerca_superior, 8) AS cerca_superior,
              MIN(valor) FILTER (valor BETWEEN cerca_inferior AND cerca_superior) AS minimo,
              MAX(valor) FILTER (valor BETWEEN cerca_inferior AND cerca_superior) AS maximo,
              COUNT(*) FILTER (NOT valor BETWEEN cerca_inferior AND cerca_superior) AS atipicos
            FROM sector_filled JOIN fences USING (indicador)
            GROUP BY indicador, q1, mediana, q3, cerca_inferior, cerca_superior"""),
        "freq_size": _frequency("companies_list", "empresa_grande_porte", by="setor, "),
        "freq_risk_class": _frequency("companies_list", "classificacao_risco", by="setor, "),
        "freq_risk_list": _frequency("risk_all", "classificacao_risco"),
        "freq_priority": _frequency("risk_all", "prioridade_fiscalizacao"),
        "freq_account_level": _frequency("account_shown", "nivel_conta"),
        "freq_state": _frequency("suspects", "cd_uf"),
        "freq_neaf_class": _frequency("neaf_list", "classificacao_risco_neaf"),
        "freq_equation_class": _frequency("equation_list", "classificacao_inconsistencia"),
        "freq_variation_class": _frequency("variation_list", "classificacao_variacao"),
        "freq_sector_suspicious": _frequency(
            "suspects", "setor", "ORDER BY quantidade DESC, setor LIMIT 10"),
        "freq_sector_variation": _frequency(
            "variation_list", "setor", "ORDER BY quantidade DESC, setor LIMIT 10"),
        "top_companies_assets": _q("""
            SELECT * REPLACE (COALESCE(ativo_milhoes, 0) AS ativo_milhoes) FROM companies_list
            QUALIFY ROW_NUMBER() OVER (PARTITION BY setor ORDER BY
              COALESCE(companies_list.ativo_milhoes, 0) DESC, cnpj, periodo_cadastro) <= 15"""),
        "top_accounts_usage": _top("account_shown", "qtd_empresas_usam", 20,
                                   "cd_conta, nm_conta"),
        "top_accounts_balance": _top("account_shown", "total_saldo_bilhoes", 20,
                                     "cd_conta, nm_conta"),
        "top_equation_gap": _top("equation_list", "diferenca_absoluta", 15,
                                 "cnpj, ano_referencia"),
        "top_benchmark_companies": _benchmark_top("qtd_empresas_setor"),
        "top_suspicious": _q("""SELECT * FROM suspects
            ORDER BY valor_indicador ASC NULLS LAST, cnpj, periodo_cadastro LIMIT 20"""),
        "view_suspicious": _view(
            f"({_suspicious('liquidity', 'LIMIT 100')})", nm_razao_social="Razão Social", cd_uf="UF", setor="Setor",
            valor_indicador="Liquidez Corrente", media_setor="Média Setor",
            desvio_setor="Desvio Setor", ativo_milhoes="Ativo (R$M)",
            receita_milhoes="Receita (R$M)", score_risco_total="Score Risco"),
        "view_accounts": _view(
            "account_shown", cd_conta="Código", nm_conta="Nome da Conta",
            descricao_grupo_balanco="Grupo", nivel_conta="Nível",
            qtd_empresas_usam="Qtd Empresas", media_saldo_milhoes="Média Saldo (R$M)",
            min_saldo_milhoes="Min Saldo (R$M)", max_saldo_milhoes="Max Saldo (R$M)",
            total_saldo_bilhoes="Total (R$B)"),
        "view_neaf": _view(
            f"({_neaf_list(registry='registry', cut='LIMIT 500')})", nm_razao_social="Razão Social", cnpj="CNPJ", setor="Setor", cd_uf="UF",
            qtd_total_indicios="Total Indícios", qtd_tipos_indicios_distintos="Tipos Indícios",
            score_risco_neaf="Score Risco", classificacao_risco_neaf="Classificação"),
        "view_equation": _view(
            f"({_equation_list(where='', cut='LIMIT 500')})", nm_razao_social="Razão Social", cnpj="CNPJ", setor="Setor",
            cd_uf="UF", ativo_total="Ativo Total", passivo_pl_total="Passivo + PL",
            diferenca_absoluta="Diferença", percentual_diferenca="% Diferença",
            classificacao_inconsistencia="Classificação", score_risco_equacao="Score"),
        "view_benchmark": _view(
            f"({_benchmark_dynamic(cut='LIMIT 100')})", cnae_divisao_descricao="Setor", qtd_empresas_setor="Qtd Empresas",
            media_ativo_total_setor="Ativo Médio", media_receita_liquida_setor="Receita Média",
            media_liquidez_corrente_setor="Liquidez", media_endividamento_setor="Endividamento",
            media_margem_liquida_setor="Margem Líquida %", media_roe_setor="ROE %"),
    }
    for name in SUSPICIOUS:
        sql[f"suspicious_{name}"] = _q(_suspicious(name, "LIMIT 100"))
    for key, column in {"companies": "qtd_empresas", "assets": "media_ativo_milhoes",
                        "liquidity": "media_liquidez", "debt": "media_endividamento",
                        "margin": "media_margem_liquida", "roa": "media_roa",
                        "roe": "media_roe"}.items():
        sql[f"top_sectors_{key}"] = _top("sector_list", column, 15, "setor")
    for key, column in {"assets": "media_ativo_total_setor",
                        "revenue": "media_receita_liquida_setor",
                        "liquidity": "media_liquidez_corrente_setor",
                        "debt": "media_endividamento_setor",
                        "margin": "media_margem_liquida_setor",
                        "roe": "media_roe_setor"}.items():
        sql[f"top_benchmark_{key}"] = _benchmark_top(column)
    return sql
