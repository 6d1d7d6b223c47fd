import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from filing_helpers import dicts
from ledgerlight import schemas as S
from ledgerlight.operators import (
    benchmark, builders, clean, companies, ledger, neaf, risk, sectors, stats, views,
)
from ledgerlight.sources import sinks, tables

A, B, C = ("0" * 13 + d for d in "123")


@pytest.fixture(scope="module")
def registry(table):
    return table(S.REGISTRY, [
        {"cnpj": A, "ano_referencia": 202301, "cnae_divisao_descricao": "X", "cd_uf": "SC"},
        {"cnpj": A, "ano_referencia": 202306, "cnae_divisao_descricao": "X", "cd_uf": "SC"},
        {"cnpj": A, "ano_referencia": 202401, "cnae_divisao_descricao": "X", "cd_uf": "PR",
         "nm_razao_social": "Nova"},
        {"cnpj": B, "ano_referencia": 202401, "de_cnae": "Y"},
        {"cnpj": C, "ano_referencia": 202401},
    ])


@pytest.fixture(scope="module")
def indicators(table):
    return table(S.INDICATORS, [
        {"cnpj": A, "ano_referencia": 2023, "ativo_total": 10_000_000, "liquidez_corrente": 0.4,
         "endividamento_geral": 0.95, "margem_liquida_perc": -20},
        {"cnpj": A, "ano_referencia": 2024, "ativo_total": 30_000_000, "liquidez_corrente": 2},
        {"cnpj": B, "ano_referencia": 2024, "ativo_total": 5_000_000, "liquidez_corrente": 0.6},
        {"cnpj": C, "ano_referencia": 2024, "liquidez_corrente": 0.2},
    ])


@pytest.fixture(scope="module")
def scores(table):
    return table(S.RISK, [
        {"cnpj": A, "ano_referencia": 2023, "score_risco_total": 7.5, "classificacao_risco": "Muito Alto"},
        {"cnpj": B, "ano_referencia": 2024, "score_risco_total": 3.0, "classificacao_risco": "Médio"},
        {"cnpj": "9" * 14, "ano_referencia": 2024, "score_risco_total": 4.0},
    ])


def test_sector_mean_counts_every_registry_row(registry, indicators):
    rows = {r["setor"]: r for r in dicts(sectors.sector_indicators(registry, indicators))}
    # two registry rows in 2023 and one in 2024: (10 + 10 + 30) / 3
    assert rows["X"]["qtd_empresas"] == 1 and rows["X"]["media_ativo_milhoes"] == 16.67
    assert rows["Y"]["media_liquidez"] == 0.6
    assert rows["Não Classificado"]["media_ativo_milhoes"] is None
    assert len(dicts(sectors.sector_indicators(registry, indicators, year=2023))) == 1


def test_unclassified_belongs_to_no_sector(registry, indicators, scores):
    assert not dicts(sectors.companies_by_sector(registry, indicators, scores, "Não Classificado"))
    found = dicts(sectors.companies_by_sector(registry, indicators, scores))
    assert {r["setor"] for r in found} == {"X", "Y"}
    one = dicts(sectors.companies_by_sector(registry, indicators, scores, "X"))
    assert [(r["ativo_milhoes"], r["score_risco_total"]) for r in one] == [
        (30.0, None), (10.0, 7.5), (10.0, 7.5)]
    assert sorted(map(str, one)) == sorted(str(r) for r in found if r["setor"] == "X")


def test_registry_fan_out_and_grain(registry, indicators, scores):
    every = dicts(risk.high_risk(scores, registry, indicators))
    assert [r["cnpj"] for r in every] == [A, A, A, "9" * 14, B]
    assert every[3]["nm_razao_social"] == "N/A" and every[3]["periodo_cadastro"] is None
    latest = dicts(risk.high_risk(scores, registry, indicators, registry_grain="latest"))
    assert [(r["cnpj"], r["cd_uf"]) for r in latest][0] == (A, "PR") and len(latest) == 3
    whole = dicts(risk.high_risk(scores, registry, indicators, limit=None))
    assert sorted(map(str, whole)) == sorted(map(str, every))
    with pytest.raises(ValueError):
        risk.high_risk(scores, registry, indicators, registry_grain="month")


def test_fallback_rows(registry, indicators):
    rows = dicts(risk.risk_fallback(registry, indicators))
    assert [(r["cnpj"], r["score_risco_total"]) for r in rows] == [
        (A, 9.0), (A, 9.0), (A, 9.0), (C, 3.0), (B, 2.0)]
    assert {r["prioridade_fiscalizacao"] for r in rows} == {3}


def test_fallback_only_for_a_missing_or_empty_table(registry, indicators, scores):
    def run(stored, year=None):
        return dicts(risk.high_risk_or_fallback(stored, registry, indicators, year=year))

    computed = dicts(risk.risk_fallback(registry, indicators))
    assert run(None) == computed and run(scores.where("false")) == computed
    assert run(scores, 2050) == []


def test_benchmark_falls_back_by_year(table, registry, indicators):
    stored = table(S.BENCHMARK, [{"cd_cnae": "1", "ano_referencia": 2023, "qtd_empresas_setor": 9}])
    kept = dicts(benchmark.sector_benchmark(stored, registry, indicators, 2023))
    assert [r["cd_cnae"] for r in kept] == ["1"]
    assert dicts(benchmark.sector_benchmark(stored, registry, indicators, 2024)) == []
    loose = benchmark.benchmark_dynamic(registry, indicators, 2024, min_companies=1)
    assert {r["ano_referencia"] for r in dicts(loose)} == {2024}


def test_benchmark_equals_the_full_pairing(table, registry, indicators):
    rows = dicts(benchmark.benchmark_dynamic(registry, indicators, min_companies=1))
    x = next(r for r in rows if r["cnae_divisao_descricao"] == "X")
    # three registry rows pair with both years
    assert x["media_ativo_total_setor"] == 20_000_000 and x["media_liquidez_corrente_setor"] == 1.2
    assert x["qtd_empresas_setor"] == 1 and x["ano_referencia"] == 2024
    lone = table(S.INDICATORS, [{"cnpj": "8" * 14, "ano_referencia": 2024, "ativo_total": 1}])
    assert dicts(benchmark.benchmark_dynamic(registry, lone, min_companies=1)) == []


def test_suspicious_limit_and_population(registry, indicators, scores):
    args = (registry, indicators, scores, "Liquidez Corrente")
    best = dicts(sectors.suspicious_companies(*args))
    assert [(r["cnpj"], r["valor_indicador"]) for r in best] == [(C, 0.2), (A, 0.4), (A, 0.4)]
    assert sorted(map(str, dicts(sectors.suspicious_companies(*args, limit=None)))) == sorted(
        map(str, best))
    assert best[1]["media_setor"] == 0.4 and best[1]["desvio_setor"] == 0.0
    whole = dicts(sectors.suspicious_companies(*args, population="sector"))
    assert whole[1]["media_setor"] == 0.93


def test_company_against_sector(registry, indicators):
    rows = {(r["cnpj"], r["indicador"]): r for r in dicts(
        sectors.company_vs_sector(registry, indicators))}
    assert set(c for c, _ in rows) == {A}
    assert rows[A, "Liquidez Corrente"]["status"] == "Normal"
    assert rows[A, "ROE (%)"]["status"] == "Sem dados"


def test_profile(spark, table, registry, indicators, scores):
    empty = {n: table(t, []) for n, t in tables.NAMES.items()}
    filled = tables.FilingTables(**{**empty, "registry": registry, "indicators": indicators,
                                    "risk": scores})
    one = companies.company_profile(filled, A)
    assert [r["cd_uf"] for r in dicts(one["registry"])] == ["PR"]
    assert [r["ano_referencia"] for r in dicts(one["indicators"])] == [2024, 2023]
    assert one["balance"].isEmpty()
    assert companies.company_profile(filled)["registry"].count() == 3
    with pytest.raises(ValueError):
        companies.company_profile(filled, "123")


def test_overview(registry):
    exact = dicts(companies.overview_summary(registry))[0]
    assert (exact["total_empresas"], exact["total_anos"], exact["ano_mais_recente"]) == (
        3, 3, 202401)
    assert dicts(companies.overview_summary(registry, approx=True))[0]["total_empresas"] == 3


def test_years_are_distinct_after_the_division(registry):
    assert [r["ano"] for r in dicts(companies.available_years(registry))] == [2024, 2023]


def test_statement_views(table):
    rows = table(S.BALANCE, [
        {"cnpj": A, "ano_referencia": p, "data_fim_periodo": d, "ativo_total": v}
        for p, d, v in [(202311, "2023-11-30", 1), (202312, "2023-12-31", 2),
                        (202401, "2024-01-31", 3)]
    ])
    assert [r["mes"] for r in dicts(companies.latest_statement(rows))] == ["01/2024"]
    assert [r["mes"] for r in dicts(companies.latest_statement(rows, 2023))] == ["12/2023"]
    assert len(dicts(companies.balance_series(rows, 2023))) == 2
    shown = views.as_view(rows, "balance")
    assert shown.columns[2] == "Ativo Circ."


def test_risk_history(scores, table):
    more = scores.union(table(S.RISK, [
        {"cnpj": A, "ano_referencia": 2024, "score_risco_total": 5.0}]))
    assert [r["ano"] for r in dicts(companies.risk_trend(more))] == [2023, 2024]
    band = {r["cnpj"]: r for r in dicts(companies.risk_bands(more))}
    assert band[A]["faixa"] == "Médio" and band[B]["alerta"] == "RISCO CONTROLADO"


def chart_rows(account, companies_, kind="A", **other):
    return [{"cnpj": f"{i:014d}", "ano_referencia": 202401, "cd_conta": account,
             "nm_conta": f"Conta {account}", "tipo_conta": kind, **other}
            for i in range(companies_)]


def test_account_usage_needs_five_companies(table):
    chart = table(S.CHART, chart_rows("1", 5) + chart_rows("2", 4) + chart_rows("3", 9, "S")
                  + chart_rows("1", 5))
    used = dicts(ledger.account_usage(chart))
    assert [(r["cd_conta"], r["qtd_empresas_usam"]) for r in used] == [("1", 5)]
    assert dicts(ledger.account_usage(chart, 2023)) == []


def test_account_statistics(table):
    chart = table(S.CHART, chart_rows("1", 6) + chart_rows("2", 5))
    balances = table(S.ACCOUNT_BALANCES, [
        {"cnpj": A, "cd_conta": "1", "ano_referencia": 2024, "saldo_final_contabil": v,
         "data_fim_periodo": "2024-12-31"} for v in (-1_000_000, 3_000_000)
    ])
    rows = ledger.account_balance_stats(ledger.account_usage(chart), balances)
    got = {r["cd_conta"]: r for r in dicts(rows)}
    assert (got["1"]["media_saldo_milhoes"], got["1"]["total_saldo_bilhoes"]) == (1.0, 0.002)
    assert got["2"]["max_saldo_milhoes"] == 0.0
    spread = dicts(ledger.account_dispersion(rows))
    assert [(r["cd_conta"], r["coef_variacao"]) for r in spread] == [("1", 400.0), ("2", 0.0)]
    assert [r["cd_conta"] for r in dicts(ledger.universal_accounts(rows))] == ["1", "2"]
    assert [r["cd_conta"] for r in dicts(ledger.universal_accounts(rows, 0.9))] == ["1"]
    summary = dicts(ledger.account_summary(rows))[0]
    assert summary["conta_mais_usada"] == "Conta 1" and summary["uso_maximo"] == 6
    newest = dicts(ledger.account_balances(balances, "1", limit=1))
    assert newest[0]["saldo_final_contabil"] == Decimal("-1000000.00")


def test_account_search_is_a_regular_expression(spark):
    df = spark.createDataFrame(
        [("Caixa", "9"), ("x", "caixa.1"), ("BANCO", "2"), (None, None), (None, "CAXX")],
        "nm_conta string, cd_conta string")
    assert len(dicts(ledger.search_accounts(df, "ca.x"))) == 3
    assert len(dicts(ledger.search_accounts(df, "banco"))) == 1


def test_groups_without_name_are_left_out(spark):
    df = spark.createDataFrame([("G", "1", 5), ("", "2", 5), (None, "3", 5), ("G", "4", 2)],
                               "descricao_grupo_balanco string, cd_conta string, "
                               "qtd_empresas_usam long")
    assert dicts(ledger.accounts_by_group(df)) == [
        {"grupo": "G", "qtd_contas": 2, "total_uso": 7}]


def test_equation_classes(table, registry):
    balance = table(S.BALANCE, [
        {"cnpj": A, "ano_referencia": 202401, "ativo_total": a, "passivo_pl_total": p}
        for a, p in [(100, 100), (0, 0), (0, 5), (10_000, 9_999), (100, 99), (100, 95), (100, 80),
                     (100, 79), (-100, -99)]
    ])
    check = builders.build_equation_check(balance)
    labels = [r["classificacao_inconsistencia"] for r in dicts(check)]
    assert labels == ["OK", "OK", "Crítica", "OK", "Diferença Mínima", "Moderada", "Alta",
                      "Crítica", "Diferença Mínima"]
    listed = dicts(ledger.equation_anomalies(check, registry, 2024))
    assert len(listed) == 6 and listed[0]["diferenca_absoluta"] == Decimal("21.00")
    assert dicts(ledger.equation_anomalies(check, registry, 2023)) == []


def test_equation_gap_is_absolute(table):
    balance = table(S.BALANCE, [
        {"cnpj": A, "ano_referencia": 202401, "ativo_total": a, "passivo_pl_total": p}
        for a, p in [(100, 70), (70, 100), (10, 90)]])
    gaps = [r["diferenca_absoluta"] for r in dicts(builders.build_equation_check(balance))]
    assert sorted(gaps) == [Decimal("30.00"), Decimal("30.00"), Decimal("80.00")]


def test_benchmark_deviations_keep_small_spreads(spark, table):
    """Values whose squares leave no digits for their spread."""
    import statistics

    from ledgerlight.operators import benchmark
    companies = [f"{i:014d}" for i in range(1000)]
    registry = table(S.REGISTRY, [
        {"cnpj": c, "ano_referencia": 202401, "cnae_divisao": "1", "de_cnae": "x"} for c in companies])
    indicators = table(S.INDICATORS, [
        {"cnpj": c, "ano_referencia": 2024, "ativo_total": Decimal(5_000_000_000 + i % 2),
         "liquidez_corrente": 5e6 + (i % 2) / 100} for i, c in enumerate(companies)])
    row = benchmark.build_benchmark(registry, indicators).collect()[0]
    assert row["desvio_padrao_ativo_total_setor"] == pytest.approx(
        statistics.stdev([i % 2 for i in range(1000)]), rel=1e-9)
    assert row["desvio_padrao_liquidez_corrente_setor"] == pytest.approx(
        statistics.stdev([5e6 + (i % 2) / 100 for i in range(1000)]), rel=1e-6)


def test_whole_set_figures_do_not_follow_the_list_limit(spark, table):
    rows = [{"cnpj": f"{i:014d}", "ano_referencia": 202401, "ativo_total": 100, "passivo_pl_total": 10}
            for i in range(620)]
    check = builders.build_equation_check(table(S.BALANCE, rows))
    registry = table(S.REGISTRY, [{"cnpj": r["cnpj"], "ano_referencia": 202401} for r in rows])
    assert ledger.equation_anomalies(check, registry).count() == 500
    assert ledger.equation_anomalies(check, registry, limit=None).count() == 620


def test_operators_without_a_risk_table(registry, indicators):
    from ledgerlight.operators import sectors
    rows = dicts(sectors.companies_by_sector(registry, indicators, None))
    assert rows and all(r["score_risco_total"] is None for r in rows)
    for limit in (None, 5):
        found = sectors.suspicious_companies(registry, indicators, None, "Liquidez Corrente", limit=limit)
        assert all(r["score_risco_total"] is None for r in dicts(found))


def test_variations_use_the_previous_reported_year(table, registry):
    rows = [(2020, 100), (2022, 700), (2023, 700), (2024, 349), (2025, 0), (2026, 5)]
    balances = table(S.ACCOUNT_BALANCES, [
        {"cnpj": A, "cd_conta": "1", "ano_referencia": y, "saldo_final_contabil": v}
        for y, v in rows])
    changes = builders.build_variations(balances)
    got = {r["ano_referencia"]: (r["variacao_percentual"], r["classificacao_variacao"])
           for r in dicts(changes)}
    assert got[2022] == (600.0, "Variação Extrema") and got[2023] == (0.0, "Normal")
    assert got[2024][1] == "Variação Alta" and got[2025] == (-100.0, "Variação Alta")
    assert got[2026] == (None, "Sem Base") and 2020 not in got
    listed = dicts(ledger.variation_anomalies(changes, registry))
    assert len(listed) == 9  # three anomalies, three registry periods
    every = dicts(ledger.variation_anomalies(changes, registry, limit=None))
    assert sorted(map(str, every)) == sorted(map(str, listed))


def test_neaf(spark, table, registry):
    purchases = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "b")],
                                      "doc int, line int, who string")
    sales = spark.createDataFrame([(2, 1), (2, 1)], "doc int, line int")
    assert neaf.purchases_without_sale(purchases, sales, ["doc", "line"]).count() == 2
    found = table(S.NEAF_INDICATIONS, [
        {"cnpj": A, "descricao_indicio": d, "complemento_indicio": "f"} for d in "xxyyy"
    ] + [{"cnpj": "7" * 14, "descricao_indicio": "x"}])
    scored = neaf.build_neaf_scores(found)
    score = {r["cnpj"]: r for r in dicts(scored)}[A]
    assert (score["score_risco_neaf"], score["classificacao_risco_neaf"]) == (3.0, "MODERADO")
    rows = neaf.neaf_scores(scored, registry)
    assert [r["cnpj"] for r in dicts(rows)] == [A, A, A]
    assert dicts(neaf.neaf_by_sector(rows)) == [{"setor": "X", "qtd_indicios": 15}]
    assert neaf.filter_neaf(rows, state="PR").count() == 1
    assert dicts(neaf.neaf_indications(found, A))[0]["qtd_ocorrencias"] == 3


def test_indicators_use_the_closing_statement(table):
    balance = table(S.BALANCE, [
        {"cnpj": A, "ano_referencia": 202311, "data_fim_periodo": "2023-11-30",
         "ativo_circulante": 1, "passivo_circulante": 1, "ativo_total": 1, "passivo_total": 1},
        {"cnpj": A, "ano_referencia": 202312, "data_fim_periodo": "2023-12-31",
         "ativo_circulante": 3, "passivo_circulante": 2, "ativo_total": 4, "passivo_total": 0,
         "patrimonio_liquido": 0},
    ])
    income = table(S.INCOME, [
        {"cnpj": A, "ano_referencia": 202312, "data_fim_periodo": "2023-12-31",
         "receita_liquida": 8, "lucro_bruto": 4, "resultado_liquido": -2},
        {"cnpj": B, "ano_referencia": 202312, "data_fim_periodo": "2023-12-31"},
    ])
    got = {r["cnpj"]: r for r in dicts(builders.build_indicators(balance, income))}
    a = got[A]
    assert (a["liquidez_corrente"], a["liquidez_geral"], a["endividamento_geral"]) == (
        1.5, None, 0.0)
    assert (a["margem_liquida_perc"], a["roa_retorno_ativo_perc"],
            a["roe_retorno_patrimonio_perc"]) == (-25.0, -50.0, None)
    assert got[B]["ativo_total"] is None


def test_statements_from_posted_lines(spark):
    day = datetime.date(2024, 12, 31)
    lines = spark.createDataFrame(
        [(A, 202412, day, g, Decimal(v)) for g, v in
         [("ativo_circulante", "5.00"), ("ativo_circulante", "1.50"), ("patrimonio_liquido", "2"),
          ("passivo_circulante", "4.50")]],
        "cnpj string, ano_referencia int, data_fim_periodo date, grupo string, "
        "valor decimal(12,2)")
    sheet = dicts(builders.build_balance(lines))[0]
    assert sheet["ativo_total"] == sheet["passivo_pl_total"] == Decimal("6.50")
    posts = spark.createDataFrame(
        [(A, 202412, day, g, Decimal(v)) for g, v in
         [("receita_bruta", "10"), ("deducoes_receita", "1"), ("custos_totais", "4"),
          ("despesas_totais", "2.5")]], lines.schema)
    assert dicts(builders.build_income(posts))[0]["resultado_liquido"] == Decimal("2.50")


def test_consolidated_score(table, indicators):
    equation = table(S.EQUATION, [
        {"cnpj": A, "ano_referencia": 202303, "score_risco_equacao": 3},
        {"cnpj": A, "ano_referencia": 202312, "score_risco_equacao": 10}])
    points = table(S.NEAF_SCORES, [{"cnpj": A, "score_risco_neaf": 4, "qtd_total_indicios": 6}])
    got = {(r["cnpj"], r["ano_referencia"]): r for r in dicts(
        builders.build_risk_scores(indicators, equation, points))}
    assert got[A, 2023]["score_risco_total"] == 9 * 0.5 + 10 * 0.25 + 4 * 0.25
    assert got[A, 2023]["classificacao_risco"] == "Muito Alto"
    assert got[B, 2024]["score_risco_total"] == 1.0 and got[B, 2024]["score_neaf"] is None


def test_clean_table(spark):
    df = spark.createDataFrame(
        [("1", "x", None, None, float("nan")), (" 2.5", None, "", None, None),
         ("-3e2", "1", "7", None, 4.0)],
        "a string, b string, `c.d` string, e string, f double")
    rows = dicts(clean.clean_table(df))
    assert [r["a"] for r in rows] == [1.0, 2.5, -300.0]
    assert [r["b"] for r in rows] == ["x", "", "1"]
    assert [r["c.d"] for r in rows] == [0.0, 0.0, 7.0]
    assert [r["e"] for r in rows] == [0.0, 0.0, 0.0] and [r["f"] for r in rows] == [0.0, 0.0, 4.0]
    key = spark.createDataFrame([("00012",), (None,)], "k string")
    assert [r["k"] for r in dicts(clean.clean_table(key, keep=["k"]))] == ["00012", ""]
    suffix = spark.createDataFrame([("1d",)], "a string")
    assert dicts(clean.clean_table(suffix)) == [{"a": "1d"}]


def test_statistics(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcde", [1.0, 2.0, 3.0, 4.0, 100.0])],
                               "setor string, v double")
    one = dicts(stats.indicator_stats(df, {"V": "v"}))[0]
    assert (one["media"], one["mediana"], one["maximo"]) == (22.0, 3.0, 100.0)
    assert one["p90"] == pytest.approx(61.6)
    box = dicts(stats.indicator_box(df, {"V": "v"}))[0]
    assert (box["q1"], box["q3"], box["atipicos"], box["maximo"]) == (2.0, 4.0, 1, 4.0)
    bins = {r["faixa"]: r["quantidade"] for r in dicts(stats.indicator_histogram(df, {"V": "v"}))}
    assert bins == {0: 4, 29: 1}
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "setor string, v double")
    assert dicts(stats.indicator_histogram(flat, {"V": "v"}))[0]["quantidade"] == 2


def test_ties_are_cut_by_the_key(spark):
    df = spark.createDataFrame([(k, 1.0) for k in "edcba"], "k string, v double")
    assert [r["k"] for r in dicts(stats.top_k(df, "v", 3, ["k"]))] == ["a", "b", "c"]
    counted = stats.frequency(df.unionByName(df.limit(0)), "v")
    assert dicts(counted) == [{"v": 1.0, "quantidade": 5}]


def test_empty_page_totals(spark, scores):
    nothing = scores.where("false").select(
        "score_risco_total", F.lit(1).alias("prioridade_fiscalizacao"),
        F.lit(0.0).alias("ativo_milhoes"))
    assert list(dicts(stats.kpi_high_risk(nothing))[0].values()) == [0, 0.0, 0, 0.0]


def test_exports(spark, tmp_path, registry):
    day = datetime.date(2024, 3, 9)
    path = sinks.export_csv(registry.select("cnpj", "cd_uf"), str(tmp_path), "Alto Risco", day)
    assert path.endswith("/alto_risco_20240309.csv")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 5 and back.columns == ["cnpj", "cd_uf"]
    sinks.write_partitioned(registry, f"{tmp_path}/t", "ano_referencia")
    assert spark.read.parquet(f"{tmp_path}/t").where("ano_referencia = 202401").count() == 3


def test_folder_source_round_trip(spark, tmp_path, table, registry):
    for name in tables.NAMES.values():
        (registry if name == S.REGISTRY else table(name, [])).write.parquet(f"{tmp_path}/{name}")
    found = tables.from_folder(spark, str(tmp_path))
    assert found.registry.schema == S.SCHEMAS[S.REGISTRY] and found.registry.count() == 5
    plan = found.registry.where(F.col("cnpj") == A)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(cnpj", plan)


def test_missing_catalog_table(spark):
    assert tables.read_catalog_table(spark, "default", "no_such_table") is None
    with pytest.raises(LookupError):
        tables.from_catalog(spark, "default")


def test_text_helpers(spark):
    df = spark.createDataFrame([("Empresa de Nome Comprido", A, 1234567.891)],
                               "n string, c string, v double")
    got = df.select(views.short_text("n", 7).alias("s"), views.key_suffix("c").alias("k"),
                    views.amount_text("v").alias("t")).first()
    assert tuple(got) == ("Empresa", "0001", "1,234,567.89")
    assert views.file_label("Margem Líquida") == "margem_líquida"
