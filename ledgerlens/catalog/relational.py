"""Queries for sources, projections, filters, nested documents and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.catalog import views as V
from ledgerlens.catalog.registry import query, r6, stage
from ledgerlens.functions import expressions as E
from ledgerlens.operators.lookup import (
    layered_directory, manual_identifiers, resolve_identifiers, restrict_to_worklist, unresolved,
)
from ledgerlens.plans.constituents import constituent_tickers, worklist
from ledgerlens.plans.panel import complete_panel, derive_items
from ledgerlens.rules import MANUAL_IDENTIFIERS
from ledgerlens.session import scratch_path, shuffles_dropped
from ledgerlens.sources.company_facts import explode_facts, parse_documents, parse_report
from ledgerlens.sources.landing import land_documents, landed_facts, read_landed
from ledgerlens.sources.readers import (
    parse_directory, read_company_facts, read_constituents, read_delimited,
)
from ledgerlens.sources.writers import write_table

YEAR_LIST = ", ".join(str(y) for y in V.YEARS)

TICKERS_SQL = V.SNAPSHOTS_SQL + f""",
latest AS (
  SELECT year(date) AS y, max(date) AS date FROM snapshots GROUP BY year(date)),
tickers AS (
  SELECT CAST(l.y AS INT) AS year, v.id, CASE v.id {" ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(V.SLOTS, 1))} END AS ticker
  FROM latest l JOIN snapshots s USING (date), (VALUES (1), (2), (3), (4), (5)) v(id) WHERE l.y IN ({YEAR_LIST}))"""

COMPLETE_SQL = V.PANEL_SQL + f""",
derived AS (SELECT *, Assets - Equity AS debt, PreTaxIncome + DepreciationAmortization AS EBITDA FROM panel),
fixed AS (SELECT * REPLACE (coalesce(FixedAssets, Assets - CurrentAssets) AS FixedAssets) FROM derived),
filled AS (SELECT * REPLACE (coalesce(CurrentAssets, Assets - FixedAssets) AS CurrentAssets) FROM fixed),
complete AS (
  SELECT *, concat(CAST(fy AS VARCHAR), ' ', symbol) AS FY_symbol FROM filled
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in V.PANEL_COLUMNS)})"""


def tickers(spark, sf_dir):
    dated = V.snapshots(spark, sf_dir).withColumn("year", F.year("date"))
    return constituent_tickers(dated, V.SLOTS, V.YEARS)


def complete(spark, sf_dir):
    panel = complete_panel(V.panel(spark, sf_dir), V.PANEL_COLUMNS)
    return panel.withColumn("FY_symbol", E.firm_year_key())


documents = stage("documents", V.documents)

# ---------------------------------------------------------------- sources and sinks


@query("src1_read_constituents", V.sql(
    V.SNAPSHOTS_SQL, select="SELECT date, CAST(year(date) AS INT) AS year, slot1, slot2, slot3, slot4, slot5 FROM snapshots"))
def src1(spark, sf_dir):
    path = scratch_path(spark, "constituents")
    V.snapshots(spark, sf_dir).select("date", *V.SLOTS).write.option("header", True).option("nullValue", "NA").csv(path)
    return read_constituents(spark, path, V.SLOTS).select("date", "year", *V.SLOTS)


@query("src2_read_delimited", V.sql(V.INDUSTRY_SQL, select="SELECT ticker, sic FROM industry"))
def src2(spark, sf_dir):
    path = scratch_path(spark, "industry")
    V.industry_codes(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return read_delimited(spark, path, schemas.INDUSTRY_CODES, sep=";")


@query("src3_read_company_facts", V.sql(
    V.FACTS_SQL, select='SELECT symbol, ns, tag, fy, form, "end" AS end_date, CAST(val AS DOUBLE) AS val FROM facts'))
def src3(spark, sf_dir):
    path = scratch_path(spark, "documents")
    with shuffles_dropped(spark):
        V.documents(spark, sf_dir).write.option("compression", "snappy").json(path)
    facts = explode_facts(parse_documents(read_company_facts(spark, path)))
    return facts.select("symbol", "ns", "tag", "fy", "form", F.col("end").alias("end_date"), "val")


@query("src4_read_ticker_directory", V.sql(
    V.DIRECTORY_SQL, select="SELECT cik_str, ticker, title, lpad(CAST(cik_str AS VARCHAR), 10, '0') AS cik FROM dir1"))
def src4(spark, sf_dir):
    entry = F.struct("cik_str", "ticker", "title")
    chunks = V.directory(spark, sf_dir, 1).groupBy(F.floor(F.col("position") / 1000).alias("chunk")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("position").cast("string"), entry)))).alias("text")
    )
    return parse_directory(chunks).select("cik_str", "ticker", "title", "cik")


@query("snk1_write_table", V.sql(V.FACTS_SQL, select="SELECT symbol, fy, tag, val FROM facts"))
def snk1(spark, sf_dir):
    path = scratch_path(spark, "facts")
    write_table(V.facts(spark, sf_dir).select("symbol", "fy", "tag", "val"), path, partition_by="fy")
    return spark.read.parquet(path).select("symbol", "fy", "tag", "val")


# ---------------------------------------------------------------- projections and filters


@query("p1_select_columns", V.sql(V.FACTS_SQL, select="SELECT symbol, fy, tag, val FROM facts"))
def p1(spark, sf_dir):
    return V.facts(spark, sf_dir).drop("ns", "end", "form", "accn", "pos").select("symbol", "fy", "tag", "val")


@query("p2_rename", V.sql(
    V.INDUSTRY_SQL, select='SELECT ticker AS "Ticker", sic AS "SIC" FROM industry'))
def p2(spark, sf_dir):
    return V.industry_codes(spark, sf_dir).withColumnsRenamed({"ticker": "Ticker", "sic": "SIC"})


@query("p3_value_list_filter", V.sql(
    V.FACTS_SQL, select="SELECT symbol, fy, tag, val FROM facts WHERE fy IN (1997, 1998) AND tag NOT IN ('Cash', 'Assets')"))
def p3(spark, sf_dir):
    facts = V.facts(spark, sf_dir)
    return facts.filter(F.col("fy").isin(1997, 1998) & ~F.col("tag").isin("Cash", "Assets")).select(
        "symbol", "fy", "tag", "val"
    )


@query("p4_annual_filing_filter", V.sql(
    V.FACTS_SQL, select="""SELECT symbol, fy, tag, val, "end" AS end_date FROM facts WHERE form = '10-K' AND year("end") = fy"""))
def p4(spark, sf_dir):
    return V.facts(spark, sf_dir).filter(E.annual_filing()).select("symbol", "fy", "tag", "val", F.col("end").alias("end_date"))


@query("p5_non_financial", V.sql(V.INDUSTRY_SQL, select="SELECT ticker, sic FROM industry WHERE sic[1] <> '6'"))
def p5(spark, sf_dir):
    return V.industry_codes(spark, sf_dir).filter(E.non_financial("sic"))


@query("p6_tag_search", V.sql(V.FACTS_SQL, select="SELECT DISTINCT tag FROM facts WHERE regexp_matches(tag, 'receivable', 'i')"))
def p6(spark, sf_dir):
    return V.facts(spark, sf_dir).filter(E.tag_search("tag", "receivable")).select("tag").distinct()


@query("p7_pad_identifier", V.sql(
    V.DIRECTORY_SQL, select="SELECT ticker, lpad(CAST(cik_str AS VARCHAR), 10, '0') AS cik FROM dir1"))
def p7(spark, sf_dir):
    return V.directory(spark, sf_dir, 1).select("ticker", E.pad_identifier("cik_str").alias("cik"))


@query("p8_composite_key", V.sql(
    V.FACTS_SQL, select="""SELECT concat(CAST(fy AS VARCHAR), ' ', symbol) AS "FY_symbol", val FROM facts"""))
def p8(spark, sf_dir):
    return V.facts(spark, sf_dir).select(E.firm_year_key().alias("FY_symbol"), "val")


@query("p9_date_parse", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filed, CAST(year(o_orderdate) AS INT) AS y,
  strftime(o_orderdate, '%Y') AS y_text FROM orders""")
def p9(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_date(text).alias("filed"))
    return orders.select("o_orderkey", "filed", F.year("filed").alias("y"), F.date_format("filed", "yyyy").alias("y_text"))


@query("p10_safe_ratio", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy,
  round(coalesce(CAST(Revenues AS DOUBLE) / nullif(CurrentAssets - CurrentLiabilities, 0), 0), 6) AS ratio,
  round(coalesce(CAST(Assets - Equity AS DOUBLE) / nullif(Equity, 0), 0), 6) AS leverage FROM panel"""))
def p10(spark, sf_dir):
    panel = V.panel(spark, sf_dir).withColumns({
        "ratio": E.ratio("Revenues", F.col("CurrentAssets") - F.col("CurrentLiabilities")),
        "leverage": E.ratio(F.col("Assets") - F.col("Equity"), "Equity"),
    })
    return E.zero_fill(panel, ["ratio", "leverage"]).select("symbol", "fy", r6("ratio"), r6("leverage"))


@query("p11_conditional_fill", V.sql(COMPLETE_SQL, select="SELECT symbol, fy, FixedAssets, CurrentAssets FROM filled"))
def p11(spark, sf_dir):
    return derive_items(V.panel(spark, sf_dir)).select("symbol", "fy", "FixedAssets", "CurrentAssets")


@query("p12_derived_items", V.sql(COMPLETE_SQL, select="SELECT symbol, fy, debt, EBITDA FROM derived"))
def p12(spark, sf_dir):
    return derive_items(V.panel(spark, sf_dir)).select("symbol", "fy", "debt", "EBITDA")


@query("p13_zero_fill", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy, CAST(coalesce(Equity, 0) AS DOUBLE) AS Equity,
  CAST(coalesce(FixedAssets, 0) AS DOUBLE) AS FixedAssets FROM panel"""))
def p13(spark, sf_dir):
    return E.zero_fill(V.panel(spark, sf_dir), ["Equity", "FixedAssets"]).select("symbol", "fy", "Equity", "FixedAssets")


@query("p14_complete_cases", V.sql(COMPLETE_SQL, select=f"""SELECT symbol, fy, {", ".join(V.PANEL_COLUMNS)}, debt, EBITDA, "FY_symbol" FROM complete"""))
def p14(spark, sf_dir):
    return complete(spark, sf_dir)


@query("p15_value_recode", V.sql(V.SCORES_SQL, select=f"""SELECT doc_id,
  CASE WHEN pred = 0 THEN '{E.MODERATE_TEXT}' ELSE '{E.EXTREME_TEXT}' END AS text,
  CASE WHEN fold = 0 THEN 'Accuracy' WHEN fold = 1 THEN 'Sensitivity' WHEN fold = 2 THEN 'Specificity'
       WHEN fold = 3 THEN 'ROC-AUC' END AS title FROM scores"""))
def p15(spark, sf_dir):
    names = F.get(F.array(*[F.lit(m) for m in E.METRIC_TITLES]), F.col("fold"))
    return V.scores(spark, sf_dir).select("doc_id", E.prediction_text("pred").alias("text"), E.metric_title(names).alias("title"))


@query("p16_number_format", V.sql(V.FACTS_SQL, select="""SELECT symbol, fy, tag, printf('%.2f', val / 100.0) AS shown,
  round_even(val / 7000.0, 3) AS rounded FROM facts"""))
def p16(spark, sf_dir):
    return V.facts(spark, sf_dir).select(
        "symbol", "fy", "tag", E.two_decimals(F.col("val") / 100.0).alias("shown"),
        F.bround(F.col("val") / 7000.0, 3).alias("rounded"),
    )


@query("p17_label_cast", "SELECT doc_id, CAST(quality AS INT) AS label FROM labels")
def p17(spark, sf_dir):
    return V.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("label")
    )


def _landed(spark, sf_dir, tags=None):
    path = scratch_path(spark, "landed")
    land_documents(documents(spark, sf_dir), path, 0)
    facts = landed_facts(read_landed(spark, path, tags))
    return facts.select("symbol", "ns", "tag", "fy", "form", F.col("end").alias("end_date"), "val", "accn", "pos.part", "pos.idx")


_PLACED_SELECT = f"""SELECT symbol, ns, tag, fy, form, "end" AS end_date,
  CAST(val AS DOUBLE) AS val, CAST(accn AS VARCHAR) AS accn, CAST(accn // {V.ORDERS_PER_PART} AS INT) AS part,
  CAST(row_number() OVER (PARTITION BY symbol, accn // {V.ORDERS_PER_PART}, ns, tag ORDER BY accn, line, item) - 1 AS INT) AS idx
  FROM facts"""
_CONCEPTS = ["Assets", "NetIncomeLoss", "Revenues"]


@query("src3_land_documents", V.sql(V.FACTS_SQL, select=_PLACED_SELECT))
def src3_land(spark, sf_dir):
    """Every fact, read from concepts that were landed as VARIANT."""
    return _landed(spark, sf_dir)


@query("src3_read_concepts", V.sql(V.FACTS_SQL, select=f"""{_PLACED_SELECT} WHERE tag IN ('{"', '".join(_CONCEPTS)}')"""))
def src3_concepts(spark, sf_dir):
    """The facts of three concepts: files and row groups of others are not read."""
    return _landed(spark, sf_dir, _CONCEPTS)


# ---------------------------------------------------------------- nested documents


@query("n1_explode_facts", V.sql(V.FACTS_SQL, select=_PLACED_SELECT))
def n1(spark, sf_dir):
    facts = explode_facts(parse_documents(V.documents(spark, sf_dir)))
    return facts.select("symbol", "ns", "tag", "fy", "form", F.col("end").alias("end_date"), "val", "accn", "pos.part", "pos.idx")


@query("n2_first_unit", V.sql(V.FACTS_SQL, select="SELECT symbol, ns, tag, 'USD' AS unit, COUNT(*) AS n FROM facts GROUP BY ALL"))
def n2(spark, sf_dir):
    facts = explode_facts(parse_documents(V.documents(spark, sf_dir, units=("USD", "pure"))))
    return facts.groupBy("symbol", "ns", "tag", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("n2_all_units", V.sql(V.FACTS_SQL, select="""SELECT symbol, ns, tag, u.unit, COUNT(*) AS n
  FROM facts, (VALUES ('USD'), ('pure')) u(unit) GROUP BY ALL"""))
def n2_all(spark, sf_dir):
    two_units = V.documents(spark, sf_dir, units=("USD", "pure"))
    facts = explode_facts(parse_documents(two_units), units="all")
    return facts.groupBy("symbol", "ns", "tag", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("n3_ragged_union", V.sql(V.FACTS_SQL, select="""SELECT symbol, tag, ns,
  CASE ns WHEN 'us-gaap' THEN 0 ELSE 1 END AS ns_order, CAST(NULL AS DATE) AS start_date, CAST(NULL AS VARCHAR) AS frame,
  CAST(val AS DOUBLE) AS val FROM facts"""))
def n3(spark, sf_dir):
    facts = explode_facts(parse_documents(V.documents(spark, sf_dir)))
    return facts.select("symbol", "tag", "ns", "ns_order", F.col("start").alias("start_date"), "frame", "val")


@query("e1_parse_report", V.sql(V.FACTS_SQL, select=f"""SELECT CASE WHEN broken THEN 'corrupt' ELSE 'ok' END AS status, COUNT(*) AS n
  FROM (SELECT DISTINCT symbol, accn // {V.ORDERS_PER_PART} AS part, CAST(symbol[2:] AS BIGINT) % 10 = 0 AS broken FROM facts)
  GROUP BY broken"""))
def e1(spark, sf_dir):
    return parse_report(parse_documents(V.documents(spark, sf_dir, broken=True)))


# ---------------------------------------------------------------- joins and sets


@query("j1_inner_join", V.sql(
    TICKERS_SQL, V.INDUSTRY_SQL, select="SELECT ticker, year, id, sic FROM tickers JOIN industry USING (ticker)"))
def j1(spark, sf_dir):
    return tickers(spark, sf_dir).join(V.industry_codes(spark, sf_dir), "ticker").select("ticker", "year", "id", "sic")


@query("j1_worklist", V.sql(TICKERS_SQL, V.INDUSTRY_SQL, select="""SELECT ticker, year FROM tickers JOIN industry USING (ticker)
  WHERE sic[1] <> '6'"""))
def j1_worklist(spark, sf_dir):
    return worklist(tickers(spark, sf_dir), V.industry_codes(spark, sf_dir))


@query("j2_semi_join", V.sql(V.DIRECTORY_SQL, V.INDUSTRY_SQL, select="""SELECT ticker, cik_str, title FROM dir2
  WHERE ticker IN (SELECT ticker FROM industry)"""))
def j2(spark, sf_dir):
    directory = V.directory(spark, sf_dir, 2)
    return directory.join(V.industry_codes(spark, sf_dir), "ticker", "left_semi").select("ticker", "cik_str", "title")


@query("j3_anti_join", V.sql(V.PANEL_SQL, V.INDUSTRY_SQL, select="""SELECT symbol, fy, Assets FROM panel
  WHERE symbol NOT IN (SELECT ticker FROM industry)"""))
def j3(spark, sf_dir):
    known = V.industry_codes(spark, sf_dir).select(F.col("ticker").alias("symbol"))
    return V.panel(spark, sf_dir).join(known, "symbol", "left_anti").select("symbol", "fy", "Assets")


@query("j4_set_difference", V.sql(TICKERS_SQL, V.DIRECTORY_SQL, select="SELECT ticker FROM tickers EXCEPT SELECT ticker FROM dir1"))
def j4(spark, sf_dir):
    return tickers(spark, sf_dir).select("ticker").subtract(V.directory(spark, sf_dir, 1).select("ticker"))


@query("j5_set_intersection", V.sql(
    TICKERS_SQL, V.DIRECTORY_SQL, select="SELECT ticker FROM tickers INTERSECT SELECT ticker FROM dir2"))
def j5(spark, sf_dir):
    return tickers(spark, sf_dir).select("ticker").intersect(V.directory(spark, sf_dir, 2).select("ticker"))


@query("j6_union_all", V.sql(V.DIRECTORY_SQL, select="""SELECT cik_str, ticker, title FROM dir1
  UNION ALL SELECT cik_str, ticker, title FROM dir2"""))
def j6(spark, sf_dir):
    first, second = (V.directory(spark, sf_dir, n).select("cik_str", "ticker", "title") for n in (1, 2))
    return first.unionByName(second)


_MANUAL = ", ".join(f"({c}, '{t}')" for c, t in MANUAL_IDENTIFIERS)
LAYERS_SQL = TICKERS_SQL + "," + V.DIRECTORY_SQL + f""",
layers AS (
  SELECT 1 AS source, position, cik_str, ticker, title FROM dir1
  UNION ALL SELECT 2, position, cik_str, ticker, title FROM dir2
  UNION ALL SELECT 3, cik, cik, ticker, NULL FROM (VALUES {_MANUAL}) m(cik, ticker)),
best AS (
  SELECT *, lpad(CAST(cik_str AS VARCHAR), 10, '0') AS cik FROM layers
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY source, position, cik_str) = 1)"""


def identifiers(spark, sf_dir):
    return layered_directory(V.directory(spark, sf_dir, 1), V.directory(spark, sf_dir, 2), manual_identifiers(spark))


@query("j7_layered_lookup", V.sql(
    LAYERS_SQL, select="SELECT year, t.ticker, source, cik, title FROM tickers t LEFT JOIN best b ON t.ticker = b.ticker"))
def j7(spark, sf_dir):
    resolved = resolve_identifiers(tickers(spark, sf_dir), identifiers(spark, sf_dir))
    return resolved.select("year", "ticker", "source", "cik", "title")


@query("j7_unresolved", V.sql(
    LAYERS_SQL, V.INDUSTRY_SQL, select="SELECT DISTINCT ticker FROM industry WHERE ticker NOT IN (SELECT ticker FROM best)"))
def j7_unresolved(spark, sf_dir):
    return unresolved(V.industry_codes(spark, sf_dir), identifiers(spark, sf_dir))


@query("j8_worklist_facts", V.sql(V.FACTS_SQL, select="""SELECT symbol, fy, tag, val FROM facts
  WHERE (symbol, fy) IN (SELECT symbol, fy FROM facts WHERE tag = 'Assets')"""))
def j8(spark, sf_dir):
    facts = V.facts(spark, sf_dir)
    wanted = facts.filter(F.col("tag") == "Assets")
    return restrict_to_worklist(facts, wanted).select("symbol", "fy", "tag", "val")
