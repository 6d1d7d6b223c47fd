"""Registered queries: every operator over the filing tables derived from an order folder."""

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlight.functions import numeric as N, rules as R
from ledgerlight.operators import (
    benchmark as B, boxes, builders, clean, companies as C, ledger as L, ml, neaf, risk as K,
    sectors as S, stats as A, views,
)
from ledgerlight.operators.forest import Forest
from ledgerlight.operators.ordering import numbered
from ledgerlight.schemas import SCHEMAS, BENCHMARK
from ledgerlight.sources import layout, sinks
from ledgerlight.sources.orders import OrderFilings, order_filings

YEAR = 1998
Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Money as double and dates as text, so that two engines' results compare directly.

    ``digits`` rounds doubles whose last bits depend on the order of a sum.
    """
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(f.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DoubleType) and digits is not None:
            column = F.round(column, digits)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def _over(build: Callable[[OrderFilings], DataFrame], digits: int | None = None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(order_filings(spark, folder)), digits)

    return query


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` written once, for a query that reads them several times: below them lie joins of all
    order tables. A session without a shared folder computes them again."""
    try:
        path = sinks.scratch_path(rows.sparkSession, "rows")
    except RuntimeError:
        return rows
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _stored(t: OrderFilings, **tables: list[str] | None) -> OrderFilings:
    """The filings with these tables written once, in this order; what is derived from them reads
    them there. A list names the columns that are needed."""
    kept = type(t)(t.spark, t.folder)
    for name, columns in tables.items():
        rows = getattr(kept, name)()
        kept.plans[name] = _written(rows.select(*columns) if columns else rows)
    return kept


# Lists that pages start from. Totals, frequencies, filters, searches and rankings take them whole;
# only a displayed list is cut.

def _sectors(t, year=None, limit=None):
    return S.sector_indicators(t.registry(), t.indicators(), year, limit)


def _companies(t, limit=None):
    return S.companies_by_sector(t.registry(), t.indicators(), t.risk(), limit=limit)


def _suspicious(t, indicator="Liquidez Corrente", limit=None, year=None, population="filtered"):
    return S.suspicious_companies(
        t.registry(), t.indicators(), t.risk(), indicator, year, limit, population)


def _high_risk(t, limit=None, year=None):
    return K.high_risk(t.risk(), t.registry(), t.indicators(), limit, year)


def _accounts(t):
    return L.account_balance_stats(L.account_usage(t.chart(), limit=None), t.account_balances())


def _shown_accounts(t):
    return L.filter_accounts(_accounts(t))


def _neaf(t, limit=None, grain="all"):
    return neaf.neaf_scores(t.neaf_scores(), t.registry(), limit, grain)


def _equation(t, year=None, limit=None):
    return L.equation_anomalies(t.equation(), t.registry(), year, limit)


def _variations(t, limit=None, year=None, grain="all"):
    return L.variation_anomalies(t.variations(), t.registry(), year, limit, grain)


def _benchmark(t, year=None, limit=None, grain="all"):
    return B.benchmark_dynamic(
        t.registry(), t.indicators(), year, limit=limit, registry_grain=grain)


def _compared(t):
    return S.company_vs_sector(t.registry(), t.indicators())


def _first(df: DataFrame, column: str) -> str:
    """The smallest key, for the queries about one."""
    return df.agg(F.min(column)).first()[0]


# Queries with several parts

def _profile(part: str) -> Query:
    return _over(lambda t: C.company_profile(t.tables())[part])


def _case(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("caso"), "*")


def _source_fallback(t):
    t = _stored(t, registry=None, indicators=["cnpj", "ano_referencia", *K.MEASURES], risk=None)
    risk, registry, indicators = t.risk(), t.registry(), t.indicators()
    parts = {
        "tabela preenchida": risk, "tabela vazia": risk.where(F.lit(False)),
        "tabela ausente": None,
    }
    lists = [_case(K.high_risk_or_fallback(stored, registry, indicators), name)
             for name, stored in parts.items()]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def _sector_benchmark(t):
    measured = ["cnpj", "ano_referencia", *sorted(set(B.MEANS.values()))]
    t = _stored(t, registry=None, indicators=measured, benchmark=None)
    registry, indicators = t.registry(), t.indicators()
    stored = t.benchmark().where(F.col("ano_referencia") == YEAR)
    found = B.sector_benchmark(stored, registry, indicators, YEAR)
    computed = B.sector_benchmark(stored, registry, indicators, YEAR + 1)
    return _case(found, "ano gravado").unionByName(_case(computed, "ano sem linhas"))


def _clean_table(t):
    filed = S.registry_by_year(t.registry()).select(
        "cnpj", "ano_referencia", "nm_fantasia", "cnae_divisao_descricao", "cnae_secao"
    )
    measured = t.indicators().select(
        "cnpj", "ano_referencia", F.col("receita_liquida").cast("string").alias("receita_texto"),
        "liquidez_corrente",
    )
    return clean.clean_table(filed.join(measured, ["cnpj", "ano_referencia"]), keep=["cnpj"])


def _export_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sectors(order_filings(spark, folder), limit=50)
    path = sinks.export_csv(rows, sinks.scratch_path(spark, "export"), "Setores")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def _build_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    t = order_filings(spark, folder)
    deviations = [n.replace("media_", "desvio_padrao_") for n in B.MEANS]
    rows = B.build_benchmark(t.registry(), t.indicators()).select(
        *SCHEMAS[BENCHMARK].fieldNames(), *deviations)
    return plain(rows.select(*[
        F.round(c, 2).alias(c) if c in deviations else c for c in rows.columns
    ]))


def _priority_bands(t):
    score = F.col("score_risco_total") + F.coalesce("score_risco_financeiro", F.lit(0.0))
    return t.risk().select("cnpj", "ano_referencia", score.alias("score")).withColumn(
        "prioridade_ml", R.ml_priority(F.col("score"))
    )


def _ml_rows(t):
    return _high_risk(t, limit=None)


def _feature_rows(t):
    """What models are fitted on and label: the keys and the features of every row."""
    return _written(_ml_rows(t).select("cnpj", "ano_referencia", "periodo_cadastro", *ml.FEATURES))


def _modelled(t, *columns):
    """The rows, cut to ``columns`` if there are any, and both models, fitted once for a folder's tables."""
    rows = _ml_rows(t)
    rows = rows.select(*columns, *ml.FEATURES) if columns else rows
    if not hasattr(t, "fitted_priority"):
        rows = _written(rows)
        t.fitted_priority = ml.fit_priority_model(rows)
    return rows, t.fitted_priority


def _prioritised(t):
    return ml.prioritise(*_modelled(t))


def _cluster_labels(t):
    rows, model = _modelled(t, "cnpj", "ano_referencia", "periodo_cadastro")
    return model.clusters.label(rows)


#: Centres, in the order of the features, of a model that is given instead of fitted.
GIVEN_CENTRES = [
    [3.0, 0.0, 0.0, 10.0, 5.0, 1.0, 0.5, 5.0], [5.0, 1.0, 1.0, 100.0, 50.0, 0.8, 0.7, 0.0],
    [8.0, 2.0, 2.0, 500.0, 200.0, 0.3, 0.9, -20.0], [10.0, 5.0, 5.0, 1000.0, 800.0, 2.0, 0.1, 10.0],
]


class GivenModel:
    """Anomalies from a score of seven, clusters around given centres: what SQL can state."""

    def label(self, rows: DataFrame) -> DataFrame:
        clusters = ml.ClusterModel(ml.Scaler([0.0] * 8, [1.0] * 8), GIVEN_CENTRES)
        return clusters.label(rows).withColumn("score_anomalia", F.col("score_risco_total")).withColumn(
            "anomalia", F.when(F.col("score_risco_total") >= 7, -1).otherwise(1))


def _given(t):
    return ml.prioritise(_ml_rows(t), GivenModel())


#: Trees of a forest that is given instead of fitted: (feature, split, below, not below) or a path
#: length, with the expected length of each.
GIVEN_TREES = [
    (4.0, (0, 5.0, (3, 100.0, 3.0, 2.5), (5, 1.0, (6, 0.7, 2.0, 1.5), 2.25))),
    (4.0, (4, 50.0, (7, 0.0, 1.75, (5, 0.5, 2.0, 4.0)), (0, 7.0, 2.5, 1.0))),
    (8.0, (6, 0.5, (2, 1.0, 5.0, 3.5), (3, 0.25, 1.0, (7, 10.0, 4.5, (4, 1000.0, 3.0, 1.25))))),
]


def given_forest() -> Forest:
    trees = []
    for _, root in GIVEN_TREES:
        nodes, pending = [None], [(0, root)]
        while pending:
            at, tree = pending.pop()
            if not isinstance(tree, tuple):
                nodes[at] = (-1, 0.0, -1, -1, tree)
                continue
            feature, split, *sides = tree
            nodes[at] = (feature, split, len(nodes), len(nodes) + 1, 0.0)
            pending += [(len(nodes) + k, side) for k, side in enumerate(sides)]
            nodes += [None, None]
        trees.append(nodes)
    most = max(map(len, trees))
    filled = [nodes + [(-1, 0.0, -1, -1, 0.0)] * (most - len(nodes)) for nodes in trees]
    kinds = (np.int32, float, np.int32, np.int32, float)
    return Forest(*(np.array([[n[k] for n in nodes] for nodes in filled], dtype=kind)
                    for k, kind in enumerate(kinds)), np.array([e for e, _ in GIVEN_TREES]))


def _forest_scores(t):
    rows = _ml_rows(t).select("cnpj", "ano_referencia", "periodo_cadastro", *ml.FEATURES)
    found = boxes.leaf_boxes(rows.sparkSession, given_forest(), ml.FEATURES)
    scored = boxes.score_by_boxes(rows, found, ml.FEATURES, len(GIVEN_TREES))
    return scored.select("cnpj", "ano_referencia", "periodo_cadastro", "score_anomalia")


def _by_company(t):
    """The variations and the registry, laid out by company."""
    spark = t.spark
    variations, registry = _written(t.variations()), _written(t.registry())  # counted, then laid out
    buckets = layout.bucket_count(max(variations.count(), registry.count()))
    return [layout.write_by_company(df, f"{name}_{uuid.uuid4().hex}", sinks.scratch_path(spark, name), buckets)
            for name, df in (("variations", variations), ("registry", registry))]


def _bucketed_variations(t):
    return L.variation_anomalies(*_by_company(t), limit=None)


def _down(*names):
    return [F.desc_nulls_first(n) for n in names]


def _up(*names):
    return [F.asc_nulls_last(n) for n in names]


#: Whole lists with the place of every row in their displayed order.
ORDERED = {
    "sectors": lambda t: numbered(_sectors(t), _down("qtd_empresas") + _up("setor")),
    "high_risk": lambda t: numbered(
        _high_risk(t), _up("prioridade_fiscalizacao") + _down("score_risco_total")
        + _up("cnpj", "ano_referencia", "periodo_cadastro")),
    "equation": lambda t: numbered(
        _equation(t), _down("score_risco_equacao") + [F.abs("diferenca_absoluta").desc_nulls_first()]
        + _up("cnpj", "ano_referencia")),
    "variations": lambda t: numbered(
        _variations(t), _down("score_risco_variacao") + [F.abs("variacao_percentual").desc_nulls_first()]
        + _up("cnpj", "cd_conta", "ano_referencia", "periodo_cadastro")),
    "neaf": lambda t: numbered(_neaf(t), _down("score_risco_neaf") + _up("cnpj", "periodo_cadastro")),
}


def _ml_scaled(t):
    return ml.ml_scaled(_feature_rows(t))


def _ml_anomaly(t):
    rows = _feature_rows(t)
    return ml.fit_anomaly_model(rows).label(rows).select(
        "cnpj", "ano_referencia", "periodo_cadastro", "score_anomalia", "anomalia"
    )


def _ml_clusters(t):
    rows = _feature_rows(t)
    return ml.fit_cluster_model(rows).label(rows).select(
        "cnpj", "ano_referencia", "periodo_cadastro", "cluster"
    )


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "overview_summary": _over(lambda t: C.overview_summary(t.registry())),
        "sector_indicators": _over(lambda t: _sectors(t, limit=50)),
        "sector_indicators_year": _over(lambda t: _sectors(t, YEAR, 50)),
        "companies_by_sector": _over(lambda t: _companies(t, 200)),
        **{f"company_profile_{part}": _profile(part)
           for part in ("registry", "indicators", "balance", "income", "risk")},
        "latest_registry": _over(
            lambda t: C.latest_rows(t.registry(), ["cnpj"], ["ano_referencia"])),
        "latest_balance": _over(lambda t: C.latest_statement(t.balance())),
        "latest_income": _over(lambda t: C.latest_statement(t.income())),
        "balance_series": _over(lambda t: C.balance_series(t.balance())),
        "income_series": _over(lambda t: C.income_series(t.income())),
        "available_years": _over(lambda t: C.available_years(t.balance())),
        "indicator_trend": _over(lambda t: C.indicator_trend(t.indicators())),
        "risk_trend": _over(lambda t: C.risk_trend(t.risk())),
        "risk_components": _over(lambda t: C.risk_components(t.risk())),
        "risk_band": _over(lambda t: C.risk_bands(t.risk())),
        "company_vs_sector": _over(_compared),
        "company_profile_radar": _over(lambda t: S.company_profile_radar(_compared(t))),
        **{f"suspicious_{key}": _over(lambda t, name=name: _suspicious(t, name, 100))
           for key, name in zip(("liquidity", "debt", "margin", "roa", "roe"), R.SUSPICIOUS)},
        "high_risk": _over(lambda t: _high_risk(t, 500)),
        "high_risk_filtered": _over(
            lambda t: K.filter_high_risk(_high_risk(t), 5, "NATION_7")),
        "risk_fallback": _over(lambda t: K.risk_fallback(t.registry(), t.indicators())),
        "source_fallback": _over(_source_fallback),
        "account_usage": _over(lambda t: L.account_usage(t.chart())),
        "account_usage_year": _over(lambda t: L.account_usage(t.chart(), YEAR)),
        "account_balance_stats": _over(_accounts),
        "account_dispersion": _over(lambda t: L.account_dispersion(_accounts(t))),
        "accounts_filtered": _over(
            lambda t: L.filter_accounts(_accounts(t), "ECONOMY", 3, 10)),
        "account_search": _over(
            lambda t: L.search_accounts(_accounts(t), "promo.*1|#2[0-4]")),
        "accounts_by_group": _over(lambda t: L.accounts_by_group(_shown_accounts(t))),
        "universal_accounts": _over(lambda t: L.universal_accounts(_shown_accounts(t))),
        "account_summary": _over(lambda t: L.account_summary(_shown_accounts(t)), 8),
        "account_balances": _over(lambda t: L.account_balances(t.account_balances())),
        "equation_anomalies": _over(lambda t: _equation(t, limit=500)),
        "equation_anomalies_year": _over(lambda t: _equation(t, YEAR, 500)),
        "variation_anomalies": _over(lambda t: _variations(t, 500)),
        "neaf_indications": _over(lambda t: neaf.neaf_indications(t.neaf_indications())),
        "neaf_scores": _over(lambda t: _neaf(t, 500)),
        "neaf_filtered": _over(lambda t: neaf.filter_neaf(_neaf(t), "MODERADO", "NATION_3")),
        "neaf_by_sector": _over(lambda t: neaf.neaf_by_sector(_neaf(t))),
        "points_neaf": _over(lambda t: neaf.neaf_points(_neaf(t))),
        "benchmark_dynamic": _over(lambda t: _benchmark(t, limit=100)),
        "benchmark_dynamic_year": _over(lambda t: _benchmark(t, YEAR, 100)),
        "benchmark_stored": _over(lambda t: B.benchmark_stored(t.benchmark())),
        "sector_benchmark": _over(_sector_benchmark),
        "benchmark_filtered": _over(lambda t: B.filter_benchmark(_benchmark(t), "MACHINERY")),
        "points_benchmark": _over(lambda t: B.benchmark_points(_benchmark(t))),
        "build_indicators": _over(lambda t: t.indicators()),
        "build_balance": _over(lambda t: builders.build_balance(t.balance_lines())),
        "build_income": _over(lambda t: builders.build_income(t.income_lines())),
        "build_equation_check": _over(lambda t: t.equation()),
        "build_variations": _over(lambda t: t.variations()),
        "build_neaf_indications": _over(lambda t: t.neaf_indications()),
        "build_neaf_score": _over(lambda t: t.neaf_scores()),
        "build_risk_score": _over(lambda t: t.risk()),
        "build_benchmark": _build_benchmark,
        "distinct_values": _over(lambda t: A.distinct_values(
            t.registry(), ["cd_uf", "cnae_divisao_descricao", "empresa_grande_porte"])),
        "clean_table": _over(_clean_table),
        "text_forms": _over(lambda t: t.indicators().select(
            "cnpj", "ano_referencia", views.key_suffix("cnpj").alias("sufixo"),
            views.amount_text("ativo_total").alias("ativo_texto"),
            N.is_finite(F.col("liquidez_corrente")).alias("finito"))),
        "file_labels": _over(lambda t: t.registry().where("nm_razao_social IS NOT NULL").select(
            "cnpj", "ano_referencia", views.label_column("nm_razao_social").alias("rotulo"),
            views.short_text("nm_razao_social", 10).alias("curto"))),
        "export_csv": _export_csv,
        "kpi_overview": _over(lambda t: A.kpi_overview(_sectors(t)), 8),
        "kpi_high_risk": _over(
            lambda t: A.kpi_high_risk(K.filter_high_risk(_high_risk(t))), 8),
        "kpi_accounts": _over(lambda t: A.kpi_accounts(_accounts(t)), 8),
        "kpi_neaf": _over(lambda t: A.kpi_neaf(_neaf(t)), 8),
        "kpi_equation": _over(lambda t: A.kpi_equation(_equation(t)), 8),
        "kpi_variation": _over(lambda t: A.kpi_variation(_variations(t)), 8),
        "kpi_benchmark": _over(lambda t: A.kpi_benchmark(_benchmark(t)), 8),
        "indicator_stats": _over(lambda t: A.indicator_stats(_sectors(t)), 8),
        "indicator_histogram": _over(lambda t: A.indicator_histogram(_sectors(t)), 8),
        "indicator_box": _over(lambda t: A.indicator_box(_sectors(t)), 8),
        "freq_size": _over(
            lambda t: A.frequency(_companies(t), "empresa_grande_porte", ["setor"])),
        "freq_risk_class": _over(
            lambda t: A.frequency(_companies(t), "classificacao_risco", ["setor"])),
        "freq_risk_list": _over(
            lambda t: A.frequency(_high_risk(t), "classificacao_risco")),
        "freq_priority": _over(lambda t: A.frequency(
            _high_risk(t), "prioridade_fiscalizacao", order="value")),
        "freq_account_level": _over(
            lambda t: A.frequency(_shown_accounts(t), "nivel_conta", order="value")),
        "freq_state": _over(lambda t: A.frequency(_suspicious(t), "cd_uf")),
        "freq_sector_suspicious": _over(lambda t: A.frequency(_suspicious(t), "setor", top=10)),
        "freq_neaf_class": _over(lambda t: A.frequency(_neaf(t), "classificacao_risco_neaf")),
        "freq_equation_class": _over(
            lambda t: A.frequency(_equation(t), "classificacao_inconsistencia")),
        "freq_variation_class": _over(
            lambda t: A.frequency(_variations(t), "classificacao_variacao")),
        "freq_sector_variation": _over(lambda t: A.frequency(_variations(t), "setor", top=10)),
        "top_companies_assets": _over(lambda t: A.top_k_per(
            _companies(t), ["setor"], "ativo_milhoes", 15, ["cnpj", "periodo_cadastro"])),
        "top_accounts_usage": _over(lambda t: A.top_k(
            _shown_accounts(t), "qtd_empresas_usam", 20, ["cd_conta", "nm_conta"])),
        "top_accounts_balance": _over(lambda t: A.top_k(
            _shown_accounts(t), "total_saldo_bilhoes", 20, ["cd_conta", "nm_conta"])),
        "top_equation_gap": _over(lambda t: A.top_k(
            _equation(t), "diferenca_absoluta", 15, ["cnpj", "ano_referencia"])),
        "top_benchmark_companies": _over(lambda t: A.top_k(
            _benchmark(t), "qtd_empresas_setor", 15, B.KEYS)),
        "top_suspicious": _over(lambda t: _suspicious(t, limit=20)),
        "view_suspicious": _over(lambda t: views.as_view(
            _suspicious(t, limit=100), "suspicious", valor_indicador="Liquidez Corrente")),
        "view_accounts": _over(lambda t: views.as_view(_shown_accounts(t), "accounts")),
        "view_neaf": _over(lambda t: views.as_view(_neaf(t, 500), "neaf")),
        "view_equation": _over(lambda t: views.as_view(_equation(t, limit=500), "equation")),
        "view_benchmark": _over(lambda t: views.as_view(_benchmark(t, limit=100), "benchmark")),
        "view_balance": _over(lambda t: views.as_view(t.balance(), "balance")),
        "view_income": _over(lambda t: views.as_view(t.income(), "income")),
        "view_variation": _over(lambda t: views.as_view(_variations(t, 500), "variation")),
        **{f"one_company_{part}": _over(lambda t, part=part: C.company_profile(
            t.tables(), _first(t.registry(), "cnpj"))[part])
           for part in ("registry", "indicators", "balance", "income", "risk")},
        "one_sector": _over(lambda t: S.companies_by_sector(
            t.registry(), t.indicators(), t.risk(), sector="MACHINERY", year=YEAR)),
        "one_account": _over(lambda t: L.account_balances(
            t.account_balances(), _first(t.account_balances(), "cd_conta"), YEAR)),
        "one_neaf_company": _over(lambda t: neaf.neaf_indications(
            t.neaf_indications(), _first(t.neaf_indications(), "cnpj"))),
        "high_risk_year": _over(lambda t: _high_risk(t, 500, YEAR)),
        "risk_fallback_year": _over(lambda t: K.risk_fallback(
            t.registry(), t.indicators(), year=YEAR)),
        "variation_anomalies_year": _over(lambda t: _variations(t, 500, YEAR)),
        "suspicious_year": _over(lambda t: _suspicious(t, limit=100, year=YEAR)),
        "suspicious_sector_population": _over(
            lambda t: _suspicious(t, limit=100, population="sector")),
        "neaf_scores_latest": _over(lambda t: _neaf(t, 500, "latest")),
        "variation_anomalies_latest": _over(lambda t: _variations(t, 500, grain="latest")),
        "benchmark_dynamic_latest": _over(lambda t: _benchmark(t, limit=100, grain="latest")),
        "priority_bands": _over(_priority_bands),
        "ml_features": _over(lambda t: ml.ml_features(_ml_rows(t))),
        "ml_scaled": _over(_ml_scaled, 6),
        "forest_scores": _over(_forest_scores, 9),
        "bucketed_variations": _over(_bucketed_variations),
        **{f"ordered_{name}": _over(build) for name, build in ORDERED.items()},
        "ml_anomaly": _over(_ml_anomaly),
        "ml_clusters": _over(_ml_clusters),
        "ml_priority": _over(_prioritised),
        "given_priority": _over(_given),
        "given_summary": _over(lambda t: ml.ml_summary(_given(t))),
        "given_top": _over(lambda t: ml.ml_top(_given(t))),
        "given_points": _over(lambda t: ml.ml_points(_given(t))),
        "freq_given_priority": _over(lambda t: A.frequency(_given(t), "prioridade_ml")),
        "freq_given_cluster": _over(lambda t: A.frequency(_given(t), "cluster_ml")),
        "ml_summary": _over(lambda t: ml.ml_summary(_prioritised(t))),
        "ml_top": _over(lambda t: ml.ml_top(_prioritised(t))),
        "points_ml": _over(lambda t: ml.ml_points(_prioritised(t))),
        "freq_ml_priority": _over(lambda t: A.frequency(_prioritised(t), "prioridade_ml")),
        "freq_cluster": _over(lambda t: A.frequency(_cluster_labels(t), "cluster")),
    }
    sector_columns = {
        "companies": "qtd_empresas", "assets": "media_ativo_milhoes",
        "liquidity": "media_liquidez", "debt": "media_endividamento",
        "margin": "media_margem_liquida", "roa": "media_roa", "roe": "media_roe",
    }
    for key, column in sector_columns.items():
        found[f"top_sectors_{key}"] = _over(
            lambda t, column=column: A.top_k(_sectors(t), column, 15, ["setor"]))
    for key, column in zip(("assets", "revenue", "liquidity", "debt", "margin", "roe"),
                           R.BENCHMARK_COLUMNS.values()):
        found[f"top_benchmark_{key}"] = _over(
            lambda t, column=column: A.top_k(_benchmark(t), column, 15, B.KEYS))
    return found


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _sectors(order_filings(spark, folder))
