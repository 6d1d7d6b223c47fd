"""Filing tables derived from order tables (region ... lineitem), for tests and benchmarks.

The figures carry no accounting meaning; the mapping gives every rule, null and join of the
operators something to work on. Nothing is sampled: each table is one Spark plan over the whole
order tables.
"""

from decimal import Decimal
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight import schemas as S
from ledgerlight.operators import builders, neaf
from ledgerlight.operators.benchmark import build_benchmark
from ledgerlight.sources.tables import FilingTables

SCALE = 100
KEYS = ["cnpj", "ano_referencia"]
SALE_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey"]


# One line's price. Sums of it are DECIMAL(18,2), which Spark adds up as long integers.
PRICE = "decimal(8,2)"


def _price(column):
    return column.cast(PRICE)


def _cnpj(column: str):
    return F.lpad(F.col(column).cast("string"), 14, "0").alias("cnpj")


def _year_end(period: str):
    return F.make_date(F.expr(f"{period} div 100"), F.lit(12), F.lit(31))


# Declared, so that reading starts no job to infer them.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def once(method):
    """Build a frame's plan on first use and hand out the same plan after that."""
    name = method.__name__

    @wraps(method)
    def planned(self):
        if name not in self.plans:
            self.plans[name] = method(self)
        return self.plans[name]

    return planned


class OrderFilings:
    """Lazy derivations: plans are kept, data is not."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.plans = spark, folder, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    @once
    def _orders(self) -> DataFrame:
        """Orders with the buyer's key and a December period of the order year."""
        period = F.year("o_orderdate") * 100 + 12
        return self.raw("orders").select(
            "o_orderkey", "o_custkey", period.cast("int").alias("ano_referencia"),
            "o_orderstatus", "o_orderpriority", _price(F.col("o_totalprice")).alias("preco"),
        )

    @once
    def registry(self) -> DataFrame:
        filed = self._orders().select("o_custkey", "ano_referencia").distinct()
        place = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        customers = self.raw("customer").join(
            place, F.col("c_nationkey") == F.col("n_nationkey")
        )
        rows = filed.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("c_custkey")

        def unless(multiple, value):
            return F.when(key % multiple != 0, value)

        return S.conform(rows.select(
            _cnpj("c_custkey"), "ano_referencia",
            F.col("c_name").alias("nm_razao_social"),
            unless(5, F.col("c_name")).alias("nm_fantasia"),
            F.col("n_name").alias("cd_uf"),
            F.lit(None).alias("cd_cnae"),
            unless(49, F.concat("c_mktsegment", F.lit(" / "), "r_name")).alias("de_cnae"),
            F.col("r_regionkey").cast("string").alias("cnae_secao"),
            F.col("r_name").alias("cnae_secao_descricao"),
            unless(7, F.substring("c_mktsegment", 1, 3)).alias("cnae_divisao"),
            unless(7, F.col("c_mktsegment")).alias("cnae_divisao_descricao"),
            unless(11, F.when(F.col("c_acctbal") >= 5000, "S").otherwise("N"))
            .alias("empresa_grande_porte"),
            F.lit(None).alias("tipo_ecd"),
            F.lit(None).alias("nm_natureza_juridica_sefaz"),
            F.lit(None).alias("nm_reg_apuracao"),
            F.lit(None).alias("sn_simples_nacional_rfb"),
        ), S.REGISTRY)

    @once
    def balance(self) -> DataFrame:
        def total(condition):
            part = F.sum(F.when(condition, F.col("preco"))) * SCALE
            return F.coalesce(part, F.lit(0)).cast(S.MONEY)

        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        rows = self._orders().groupBy("o_custkey", "ano_referencia").agg(
            total(status == "F").alias("ativo_circulante"),
            total(status == "P").alias("ativo_nao_circulante"),
            total(status == "O").alias("passivo_circulante"),
            total(priority == "1-URGENT").alias("passivo_nao_circulante"),
        )
        # Equity closes the equation, but for every tenth company, which reports too much.
        gap = F.when(
            F.col("c_custkey") % 10 == 0, F.abs(_price(F.col("c_acctbal"))) * SCALE
        ).otherwise(F.lit(0))
        rows = rows.join(
            self.raw("customer").select("c_custkey", gap.alias("excesso")),
            F.col("o_custkey") == F.col("c_custkey"),
        ).withColumn("patrimonio_liquido", F.lit(0))
        rows = builders.with_balance_totals(rows).withColumns({
            "patrimonio_liquido": F.col("ativo_total") - F.col("passivo_total"),
            "passivo_pl_total": F.col("ativo_total") + F.col("excesso"),
        })
        return S.conform(rows.select(
            _cnpj("o_custkey"), *[c for c in rows.columns if c != "o_custkey"],
            _year_end("ano_referencia").alias("data_fim_periodo"),
        ), S.BALANCE)

    @once
    def income(self) -> DataFrame:
        price = _price(F.col("l_extendedprice"))
        discount = _price(F.round(price * F.abs("l_discount").cast("decimal(3,2)"), 2))
        # Lines are added up per order before the join, on the key they are joined by.
        per_order = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.sum(price).alias("receita"),
            F.sum(discount).alias("deducoes"),
            F.sum(F.when(F.col("l_returnflag") == "R", price)).alias("despesas"),
        )

        def total(name):
            return F.coalesce(F.sum(name) * SCALE, F.lit(0)).cast(S.MONEY)

        rows = per_order.join(
            self._orders().select("o_orderkey", "o_custkey", "ano_referencia"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).groupBy("o_custkey", "ano_referencia").agg(
            total("receita").alias("receita_bruta"),
            total("deducoes").alias("deducoes_receita"),
            total("despesas").alias("despesas_totais"),
        )
        costs = (F.col("receita_bruta") * F.lit(Decimal("0.60"))).cast(S.MONEY)
        rows = builders.with_income_totals(rows.withColumn("custos_totais", costs))
        return S.conform(rows.select(
            _cnpj("o_custkey"), *[c for c in rows.columns if c != "o_custkey"],
            _year_end("ano_referencia").alias("data_fim_periodo"),
        ), S.INCOME)

    @once
    def indicators(self) -> DataFrame:
        return builders.build_indicators(self.balance(), self.income())

    @once
    def _accounts(self) -> DataFrame:
        return self.raw("part").select(
            "p_partkey", F.concat("p_brand", F.lit("."), "p_type").alias("cd_conta"),
            F.concat("p_type", F.lit(" "), "p_brand").alias("nm_conta"),
            F.col("p_type").alias("descricao_grupo_balanco"),
            F.col("p_type").alias("cd_conta_referencial"),
            F.when(F.col("p_brand").endswith("0"), "S").otherwise("A").alias("tipo_conta"),
            (F.length("p_type") % 5 + 1).cast("int").alias("nivel_conta"),
            F.col("p_brand").alias("cd_conta_sint1"), F.col("p_brand").alias("nm_conta_sint1"),
        )

    def _posted(self, *columns) -> DataFrame:
        return self.raw("lineitem").join(
            self._orders().select("o_orderkey", "o_custkey", "ano_referencia"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).join(self._accounts(), F.col("l_partkey") == F.col("p_partkey")).select(*columns)

    @once
    def chart(self) -> DataFrame:
        names = [c for c in S.SCHEMAS[S.CHART].fieldNames() if c != "cnpj"]
        used = self._posted("o_custkey", *names).distinct()
        return S.conform(used.select(_cnpj("o_custkey"), *names), S.CHART)

    @once
    def account_balances(self) -> DataFrame:
        posted = self._posted(
            "o_custkey", "cd_conta", "ano_referencia",
            _price(F.col("l_extendedprice")).alias("valor"),
        ).groupBy("o_custkey", "cd_conta", "ano_referencia").agg(
            (F.sum("valor") * SCALE).alias("saldo_final_contabil")
        )
        return S.conform(posted.select(
            _cnpj("o_custkey"), "cd_conta", "saldo_final_contabil",
            F.expr("ano_referencia div 100").alias("ano_referencia"),
            _year_end("ano_referencia").alias("data_fim_periodo"),
        ), S.ACCOUNT_BALANCES)

    @once
    def neaf_indications(self) -> DataFrame:
        lines = self.raw("lineitem").select(*SALE_KEYS, "l_returnflag")
        # The supplier side leaves out every twentieth line.
        sales = lines.where((F.col("l_orderkey") + F.col("l_linenumber")) % 20 != 0)
        unmatched = neaf.purchases_without_sale(lines, sales, SALE_KEYS)
        return S.conform(unmatched.join(
            self._orders().select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).select(
            _cnpj("o_custkey"),
            F.concat(F.lit("Compra sem venda registrada - "), "l_returnflag")
            .alias("descricao_indicio"),
            F.concat(F.lit("Fornecedor "), F.col("l_suppkey").cast("string"))
            .alias("complemento_indicio"),
        ), S.NEAF_INDICATIONS)

    @once
    def neaf_scores(self) -> DataFrame:
        return S.conform(neaf.build_neaf_scores(self.neaf_indications()), S.NEAF_SCORES)

    @once
    def equation(self) -> DataFrame:
        return builders.build_equation_check(self.balance())

    @once
    def variations(self) -> DataFrame:
        return builders.build_variations(self.account_balances())

    @once
    def risk(self) -> DataFrame:
        return builders.build_risk_scores(
            self.indicators(), self.equation(), self.neaf_scores()
        )

    @once
    def benchmark(self) -> DataFrame:
        return S.conform(build_benchmark(self.registry(), self.indicators()), S.BENCHMARK)

    @once
    def tables(self) -> FilingTables:
        return FilingTables(
            registry=self.registry(), indicators=self.indicators(), balance=self.balance(),
            income=self.income(), chart=self.chart(), account_balances=self.account_balances(),
            risk=self.risk(), neaf_indications=self.neaf_indications(),
            neaf_scores=self.neaf_scores(), equation=self.equation(),
            variations=self.variations(), benchmark=self.benchmark(),
        )

    def balance_lines(self) -> DataFrame:
        """Posted balance-sheet lines: each order, its urgent liability and the equity offset."""
        value = F.col("preco") * SCALE
        group = (
            F.when(F.col("o_orderstatus") == "F", "ativo_circulante")
            .when(F.col("o_orderstatus") == "P", "ativo_nao_circulante")
            .when(F.col("o_orderstatus") == "O", "passivo_circulante")
        )
        urgent = F.when(F.col("o_orderpriority") == "1-URGENT", value)
        asset = F.col("o_orderstatus").isin("F", "P")
        equity = F.when(asset, value).otherwise(-value) - F.coalesce(urgent, F.lit(0))
        return self._lines(self._orders(), [
            (group, value), (F.lit("passivo_nao_circulante"), urgent),
            (F.lit("patrimonio_liquido"), equity),
        ])

    def income_lines(self) -> DataFrame:
        """Posted income-statement lines of every line item."""
        line = _price(F.col("l_extendedprice"))
        price = line * SCALE
        discount = F.round(line * F.abs("l_discount").cast("decimal(3,2)"), 2) * SCALE
        rows = self.raw("lineitem").join(
            self._orders().select("o_orderkey", "o_custkey", "ano_referencia"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        return self._lines(rows, [
            (F.lit("receita_bruta"), price), (F.lit("deducoes_receita"), discount),
            (F.lit("custos_totais"), price * F.lit(Decimal("0.60"))),
            (F.lit("despesas_totais"), F.when(F.col("l_returnflag") == "R", price)),
        ])

    @staticmethod
    def _lines(rows: DataFrame, posts: list) -> DataFrame:
        entries = F.explode(F.array(*[
            F.struct(group.alias("grupo"), value.cast("decimal(12,2)").alias("valor"))
            for group, value in posts
        ]))
        return rows.select(
            _cnpj("o_custkey"), "ano_referencia",
            _year_end("ano_referencia").alias("data_fim_periodo"), entries.alias("e"),
        ).select("cnpj", "ano_referencia", "data_fim_periodo", "e.*").where("valor IS NOT NULL")


@lru_cache(maxsize=8)
def order_filings(spark: SparkSession, folder: str) -> OrderFilings:
    return OrderFilings(spark, folder)
