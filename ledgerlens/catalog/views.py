"""Inputs of the registered queries, derived from the given tables: once as DataFrames, once as SQL text.

Money is integer cents, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The part types, line flags and reporting tags that stand for one another in the test facts.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FLAGS = ("AF", "AO", "NF", "NO", "RF", "RO")
TAGS = (
    "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax",
    "DeferredRevenueCurrent", "CostOfRevenue", "CostOfGoodsAndServicesSold",
    "AccountsReceivableNetCurrent", "ReceivablesNetCurrent", "AssetsCurrent", "OtherAssetsCurrent",
    "LiabilitiesCurrent", "OtherLiabilitiesCurrent", "InventoryNet", "StockholdersEquity",
    "StockholdersEquityOther", "NetIncomeLoss", "ComprehensiveIncomeNetOfTax", "OperatingIncomeLoss",
    "OtherOperatingIncome", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    "Assets", "DepreciationDepletionAndAmortization", "Depreciation", "PropertyPlantAndEquipmentNet",
    "PropertyPlantAndEquipmentGross", "LongTermDebtNoncurrent", "NoncurrentAssets", "InterestExpense",
    "InterestPaid", "CashAndCashEquivalentsAtCarryingValue", "Cash", "Dividends",
    "NetCashProvidedByUsedInOperatingActivities",
    "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "ResearchAndDevelopmentExpense",
)
YEARS = tuple(range(1995, 2002))
PANEL_COLUMNS = (
    "Assets", "CurrentAssets", "FixedAssets", "CurrentLiabilities", "Equity", "Revenues", "AccountsReceivable", "Cash",
    "DepreciationAmortization", "PropertyPlantAndEquipment", "Interest", "NetIncomeLoss", "PreTaxIncome",
    "CashFlowOperations",
)
SLOTS = ["slot1", "slot2", "slot3", "slot4", "slot5"]
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts: a supplier is a firm, an order a filing, a line a fact."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")) - 1
    flag = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.concat("l_returnflag", "l_linestatus")) - 1
    # Codes, cents and dates are taken before the joins, so that no texts and timestamps are shuffled.
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accn"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), "l_suppkey",
        flag.cast("int").alias("flag"), _cents().alias("val"), F.when(F.col("l_linenumber") % 4 == 0, F.col("l_shipdate").cast("date")).alias("shipped"),
    )
    filings = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accn"), F.col("o_orderdate").cast("date").alias("ordered"), F.col("o_orderstatus").isin("F", "O").alias("full_year"),
    )
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), kind.cast("int").alias("kind"))
    return lines.join(filings, "accn").join(items, "item").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.year("ordered").alias("fy"),
        F.get(F.array(*[F.lit(t) for t in TAGS]), F.col("kind") * len(FLAGS) + F.col("flag")).alias("tag"),
        F.when(F.col("accn") % 5 != 0, "us-gaap").otherwise("dei").alias("ns"),
        F.when(F.col("line") % 4 == 0, F.col("shipped")).otherwise(F.col("ordered")).alias("end"),
        F.when(F.col("full_year"), "10-K").otherwise("10-Q").alias("form"),
        "val",
        "accn",
        F.struct("accn", "line", "item").alias("pos"),
    )


_TAG_LIST = ", ".join(f"'{t}'" for t in TAGS)
_KIND = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES))
_FLAG = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FLAGS))
FACTS_SQL = f"""
sales AS (
  SELECT l.*, o.*, p.p_type, CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
facts AS (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, CAST(year(o_orderdate) AS INT) AS fy,
    list_extract([{_TAG_LIST}], CASE p_type {_KIND} END * {len(FLAGS)}
      + CASE concat(l_returnflag, l_linestatus) {_FLAG} END + 1) AS tag,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'us-gaap' ELSE 'dei' END AS ns,
    CAST(CASE WHEN l_linenumber % 4 = 0 THEN l_shipdate ELSE o_orderdate END AS DATE) AS "end",
    CASE WHEN o_orderstatus IN ('F', 'O') THEN '10-K' ELSE '10-Q' END AS form,
    c AS val, o_orderkey AS accn, l_linenumber AS line, l_partkey AS item
  FROM sales)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide firm-years: a customer is a firm; sums over no rows leave natural gaps."""
    lines = {
        "CurrentLiabilities": F.col("l_returnflag") == "A",
        "Equity": F.col("l_returnflag") == "R",
        "Revenues": F.col("l_linestatus") == "F",
        "AccountsReceivable": F.col("l_linestatus") == "O",
        "DepreciationAmortization": F.col("l_discount") >= 0.05,
        "Interest": F.col("l_tax") >= 0.04,
        "NetIncomeLoss": F.col("l_returnflag").isin("N", "R") & (F.col("l_linestatus") == "F"),
        "PreTaxIncome": F.col("l_returnflag").isin("N", "R"),
        "CashFlowOperations": F.col("l_quantity") >= 20,
    }
    parts = {
        "CurrentAssets": F.col("p_type").isin("ECONOMY", "SMALL", "MEDIUM"),
        "FixedAssets": F.col("p_type") == "LARGE",
        "Cash": F.col("p_type").isin("PROMO", "SMALL"),
        "PropertyPlantAndEquipment": F.col("p_type").isin("STANDARD", "LARGE"),
    }
    # Tests are made before the joins, one bit each, so that no texts, amounts and timestamps are shuffled; parts are joined
    # first, so that the lines of an order lie together when they are summed.
    bit = {n: 1 << k for k, n in enumerate([*lines, *parts])}
    bits = lambda tests: sum((F.when(t, bit[n]).otherwise(0) for n, t in tests.items()), F.lit(0))
    sold = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accn"), F.col("l_partkey").alias("item"), _cents().alias("c"), bits(lines).alias("line_bits"),
    )
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), bits(parts).alias("part_bits"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accn"), "o_custkey", F.year("o_orderdate").alias("fy"))
    marked = sold.join(items, "item").select("accn", "c", (F.col("line_bits") + F.col("part_bits")).alias("bits"))
    amounts = {n: F.when(F.col("bits").bitwiseAND(F.lit(bit[n])) != 0, F.col("c")) if n in bit else F.col("c") for n in PANEL_COLUMNS}
    return marked.join(orders, "accn").groupBy(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), "fy"
    ).agg(*[F.sum(amounts[n]).alias(n) for n in PANEL_COLUMNS])


PANEL_SQL = """
sold AS (
  SELECT l.*, o.*, p.p_type, CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
panel AS (
  SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS symbol, CAST(year(o_orderdate) AS INT) AS fy,
    CAST(SUM(c) AS BIGINT) AS Assets,
    CAST(SUM(c) FILTER (p_type IN ('ECONOMY', 'SMALL', 'MEDIUM')) AS BIGINT) AS CurrentAssets,
    CAST(SUM(c) FILTER (p_type = 'LARGE') AS BIGINT) AS FixedAssets,
    CAST(SUM(c) FILTER (l_returnflag = 'A') AS BIGINT) AS CurrentLiabilities,
    CAST(SUM(c) FILTER (l_returnflag = 'R') AS BIGINT) AS Equity,
    CAST(SUM(c) FILTER (l_linestatus = 'F') AS BIGINT) AS Revenues,
    CAST(SUM(c) FILTER (l_linestatus = 'O') AS BIGINT) AS AccountsReceivable,
    CAST(SUM(c) FILTER (p_type IN ('PROMO', 'SMALL')) AS BIGINT) AS Cash,
    CAST(SUM(c) FILTER (l_discount >= 0.05) AS BIGINT) AS DepreciationAmortization,
    CAST(SUM(c) FILTER (p_type IN ('STANDARD', 'LARGE')) AS BIGINT) AS PropertyPlantAndEquipment,
    CAST(SUM(c) FILTER (l_tax >= 0.04) AS BIGINT) AS Interest,
    CAST(SUM(c) FILTER (l_returnflag IN ('N', 'R') AND l_linestatus = 'F') AS BIGINT) AS NetIncomeLoss,
    CAST(SUM(c) FILTER (l_returnflag IN ('N', 'R')) AS BIGINT) AS PreTaxIncome,
    CAST(SUM(c) FILTER (l_quantity >= 20) AS BIGINT) AS CashFlowOperations
  FROM sold GROUP BY o_custkey, year(o_orderdate))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated constituent slots."""
    custkey = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(*[
        F.max(F.when(F.col("o_orderpriority") == p, custkey)).alias(s) for s, p in zip(SLOTS, PRIORITIES)
    ])


_SLOT_SQL = ", ".join(
    f"MAX(CASE WHEN o_orderpriority = '{p}' THEN concat('C', CAST(o_custkey AS VARCHAR)) END) AS {s}"
    for s, p in zip(SLOTS, PRIORITIES)
)
SNAPSHOTS_SQL = f"""
snapshots AS (
  SELECT CAST(o_orderdate AS DATE) AS date, {_SLOT_SQL} FROM orders GROUP BY CAST(o_orderdate AS DATE))"""


def industry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry codes; one customer in eleven has none."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(key % 11 != 0).select(
        F.concat(F.lit("C"), key.cast("string")).alias("ticker"),
        F.lpad(((key * 37) % 9000 + 100).cast("string"), 4, "0").alias("sic"),
    )


INDUSTRY_SQL = """
industry AS (
  SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS ticker,
    lpad(CAST((c_custkey * 37) % 9000 + 100 AS VARCHAR), 4, '0') AS sic
  FROM customer WHERE c_custkey % 11 <> 0)"""


def directory(spark: SparkSession, sf_dir: str, layer: int) -> DataFrame:
    """Identifier directories. The first lacks every seventh ticker; the second is partial and has duplicates."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    ticker = F.concat(F.lit("C"), key.cast("string")).alias("ticker")
    if layer == 1:
        return customers.filter(key % 7 != 0).select(
            key.alias("position"), (key * 13 + 5).alias("cik_str"), ticker, F.col("c_name").alias("title")
        )
    partial = customers.filter(key % 3 != 0)
    copies = partial.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return copies.select(
        (key * 2 + F.col("copy")).alias("position"), (key * 17 + F.col("copy")).alias("cik_str"), ticker,
        F.concat(F.col("c_name"), F.lit(" "), F.col("copy").cast("string")).alias("title"),
    )


DIRECTORY_SQL = """
dir1 AS (
  SELECT c_custkey AS position, c_custkey * 13 + 5 AS cik_str, concat('C', CAST(c_custkey AS VARCHAR)) AS ticker,
    c_name AS title FROM customer WHERE c_custkey % 7 <> 0),
dir2 AS (
  SELECT c_custkey * 2 + copy AS position, c_custkey * 17 + copy AS cik_str,
    concat('C', CAST(c_custkey AS VARCHAR)) AS ticker, concat(c_name, ' ', CAST(copy AS VARCHAR)) AS title
  FROM customer, (VALUES (0), (1)) v(copy) WHERE c_custkey % 3 <> 0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores: text length as the score of a document's quality label."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.select("doc_id", "n_chars").join(labels, "doc_id").select(
        "doc_id", F.col("quality").cast("int").alias("truth"), (F.col("n_chars") / 1000).alias("score"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("pred"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
    )


SCORES_SQL = """
scores AS (
  SELECT d.doc_id, CAST(l.quality AS INT) AS truth, CAST(d.n_chars AS DOUBLE) / 1000 AS score,
    CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred, CAST(d.doc_id % 5 AS INT) AS fold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# A thousand consecutive orders make one part of a firm's document, which bounds the size of a document.
ORDERS_PER_PART = 1000


def documents(
    spark: SparkSession, sf_dir: str, broken: bool = False, units: tuple[str, ...] = ("USD",)
) -> DataFrame:
    """Company-facts documents (symbol, part, text) built from `facts`; optionally every tenth firm's text is cut.

    Facts are shuffled once, by document: tags, namespaces and texts are grouped where they then lie.
    """
    rows = facts(spark, sf_dir).withColumn("part", F.floor(F.col("accn") / ORDERS_PER_PART).cast("int"))
    rows = rows.repartition("symbol", "part")
    fact = F.struct(
        "pos", F.date_format("end", "yyyy-MM-dd").alias("end"), F.col("val").cast("double").alias("val"),
        F.col("accn").cast("string").alias("accn"), "fy", "form",
    )
    by_tag = rows.groupBy("symbol", "part", "ns", "tag").agg(F.array_sort(F.collect_list(fact)).alias("list"))
    plain = F.transform("list", lambda x: x.dropFields("pos"))
    by_ns = by_tag.groupBy("symbol", "part", "ns").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "tag", F.struct(F.create_map(*[x for u in units for x in (F.lit(u), plain)]).alias("units"))
        ))).alias("concepts")
    )
    text = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("ns", "concepts"))).alias("facts")))
    docs = by_ns.groupBy("symbol", "part").agg(text.alias("text"))
    if broken:
        cut = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
        number = F.substring("symbol", 2, 20).cast("bigint")
        docs = docs.withColumn("text", F.when(number % 10 == 0, cut).otherwise(F.col("text")))
    return docs


def sql(*views: str, select: str) -> str:
    """A query over the given view texts."""
    return f"WITH {', '.join(v.strip() for v in views)} {select}"
