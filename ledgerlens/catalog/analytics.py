"""Queries for deduplication, windows, aggregates, reshaping and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import views as V
from ledgerlens.catalog.registry import query, r6
from ledgerlens.catalog.relational import COMPLETE_SQL, complete
from ledgerlens.functions.expressions import firm_year_key
from ledgerlens.operators import stats as S
from ledgerlens.operators.canonical import tag_counts
from ledgerlens.operators.changes import change, drop_first_year, previous
from ledgerlens.operators.dedup import annual_facts, first_per_key, keep_last, last_per_year
from ledgerlens.operators.metrics import class_metrics, summarise_folds
from ledgerlens.operators.reshape import pivot_items, pivot_metrics, report_rows, slots_to_long
from ledgerlens.rules import PANEL_ITEMS
from ledgerlens.sources.company_facts import explode_facts, parse_documents

KEPT_SQL = V.FACTS_SQL + """,
firsts AS (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY symbol, ns, tag, "end" ORDER BY accn, line, item) = 1),
annual AS (SELECT * FROM firsts WHERE form = '10-K' AND year("end") = fy),
kept AS (
  SELECT * FROM annual
  QUALIFY row_number() OVER (PARTITION BY symbol, fy, tag ORDER BY "end" DESC NULLS FIRST, accn DESC, line DESC, item DESC) = 1)"""

COLUMNS = list(V.PANEL_COLUMNS)


def kept(spark, sf_dir):
    return keep_last(annual_facts(V.facts(spark, sf_dir)))


def _each(columns, template, glue=" UNION ALL "):
    return glue.join(template.format(c=c) for c in columns)


# ---------------------------------------------------------------- first / last / lag


@query("w1_first_per_end", V.sql(KEPT_SQL, select='SELECT symbol, ns, tag, fy, "end" AS end_date, accn, val FROM annual'))
def w1(spark, sf_dir):
    return annual_facts(V.facts(spark, sf_dir)).select("symbol", "ns", "tag", "fy", F.col("end").alias("end_date"), "accn", "val")


@query("w1_filter_first", V.sql(V.FACTS_SQL, select="""SELECT symbol, ns, tag, fy, "end" AS end_date, accn, val
  FROM (SELECT * FROM facts WHERE form = '10-K' AND year("end") = fy)
  QUALIFY row_number() OVER (PARTITION BY symbol, ns, tag, "end" ORDER BY accn, line, item) = 1"""))
def w1_filter_first(spark, sf_dir):
    rows = annual_facts(V.facts(spark, sf_dir), dedupe="after_filter")
    return rows.select("symbol", "ns", "tag", "fy", F.col("end").alias("end_date"), "accn", "val")


@query("w2_keep_last", V.sql(KEPT_SQL, select='SELECT symbol, fy, tag, "end" AS end_date, accn, val FROM kept'))
def w2(spark, sf_dir):
    return kept(spark, sf_dir).select("symbol", "fy", "tag", F.col("end").alias("end_date"), "accn", "val")


STACKED_SQL = V.FACTS_SQL + f""",
stacked AS (SELECT *, CASE ns WHEN 'us-gaap' THEN 0 ELSE 1 END AS ns_order, accn // {V.ORDERS_PER_PART} AS part FROM facts),
annual AS (
  SELECT * FROM (SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY symbol, ns, tag, "end" ORDER BY part, accn, line, item) = 1)
  WHERE form = '10-K' AND year("end") = fy),
last_ones AS (
  SELECT * FROM annual QUALIFY row_number() OVER (
    PARTITION BY symbol, fy, tag ORDER BY "end" DESC NULLS FIRST, ns_order DESC, part DESC, accn DESC, line DESC, item DESC) = 1)"""


@query("w1_all_units", V.sql(STACKED_SQL, select="""SELECT symbol, ns, tag, u.unit, fy, "end" AS end_date, CAST(accn AS VARCHAR) AS accn,
  CAST(val AS DOUBLE) AS val FROM annual, (VALUES ('USD'), ('pure')) u(unit)"""))
def w1_all_units(spark, sf_dir):
    """From nested documents whose concepts list two units: each unit keeps its fact."""
    facts = explode_facts(parse_documents(V.documents(spark, sf_dir, units=("USD", "pure"))), units="all")
    return annual_facts(facts).select("symbol", "ns", "tag", "unit", "fy", F.col("end").alias("end_date"), "accn", "val")


@query("w2_keep_last_namespaces", V.sql(STACKED_SQL, select="""SELECT symbol, fy, tag, ns, "end" AS end_date, CAST(accn AS VARCHAR) AS accn,
  CAST(val AS DOUBLE) AS val FROM last_ones"""))
def w2_namespaces(spark, sf_dir):
    """From nested documents: of facts with one end, that of the later namespace is last."""
    facts = annual_facts(explode_facts(parse_documents(V.documents(spark, sf_dir))))
    return keep_last(facts).select("symbol", "fy", "tag", "ns", F.col("end").alias("end_date"), "accn", "val")


@query("w3_last_per_year", V.sql(V.SNAPSHOTS_SQL, select="""SELECT CAST(year(date) AS INT) AS year, date, slot1, slot2, slot3, slot4, slot5
  FROM snapshots QUALIFY row_number() OVER (PARTITION BY year(date) ORDER BY date DESC) = 1"""))
def w3(spark, sf_dir):
    return last_per_year(V.snapshots(spark, sf_dir).withColumn("year", F.year("date"))).select("year", "date", *V.SLOTS)


@query("w4_distinct_keep_first", V.sql(V.DIRECTORY_SQL, select="""SELECT ticker, cik_str, title FROM dir2
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY position) = 1"""))
def w4(spark, sf_dir):
    return first_per_key(V.directory(spark, sf_dir, 2), ["ticker"], [F.col("position")]).select("ticker", "cik_str", "title")


@query("w5_drop_first_year", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy, Assets FROM panel
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fy) > 1"""))
def w5(spark, sf_dir):
    return drop_first_year(V.panel(spark, sf_dir).select("symbol", "fy", "Assets"))


@query("w6_firm_years_per_year", V.sql(V.FACTS_SQL, select="""SELECT fy, COUNT(*) AS n
  FROM (SELECT DISTINCT symbol, fy FROM facts) GROUP BY fy"""))
def w6(spark, sf_dir):
    firm_years = V.facts(spark, sf_dir).select("symbol", "fy").dropDuplicates()
    return firm_years.groupBy("fy").agg(F.count(F.lit(1)).alias("n"))


@query("w7_lag_self_default", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy, Assets,
  lag(Assets, 1, Assets) OVER (PARTITION BY symbol ORDER BY fy) AS previous_assets FROM panel"""))
def w7(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "fy", "Assets", previous("Assets").alias("previous_assets"))


@query("w8_change", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy,
  Assets - lag(Assets, 1, Assets) OVER w AS change, Equity - lag(Equity, 1, Equity) OVER w AS equity_change
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY fy)"""))
def w8(spark, sf_dir):
    return V.panel(spark, sf_dir).select(
        "symbol", "fy", change("Assets").alias("change"), change("Equity").alias("equity_change")
    )


@query("w8_change_strict_year", V.sql(V.PANEL_SQL, select="""SELECT symbol, fy,
  CASE WHEN fy - lag(fy, 1, fy - 1) OVER w = 1 THEN Assets - lag(Assets, 1, Assets) OVER w END AS change
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY fy)"""))
def w8_strict(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "fy", change("Assets", strict_year=True).alias("change"))


@query("w9_share_of_total", V.sql(V.SCORES_SQL, select="""SELECT truth, COUNT(*) AS n,
  round(COUNT(*) / (SUM(COUNT(*)) OVER ()), 6) AS prop FROM scores GROUP BY truth"""))
def w9(spark, sf_dir):
    counts = V.scores(spark, sf_dir).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))
    return S.share_of_total(counts).select("truth", "n", r6("prop"))


@query("w10_sort", V.sql(V.PANEL_SQL, select="SELECT symbol, fy, Assets FROM panel ORDER BY symbol, fy"))
def w10(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "fy", "Assets").orderBy("symbol", "fy")


@query("w11_top_tags", V.sql(KEPT_SQL, select="SELECT tag, COUNT(*) AS n FROM kept GROUP BY tag ORDER BY n DESC, tag LIMIT 10"))
def w11(spark, sf_dir):
    counts = tag_counts(kept(spark, sf_dir))
    return counts.orderBy(F.col("n").desc(), "tag").limit(10)


# ---------------------------------------------------------------- counts and audits


@query("a1_tag_frequency", V.sql(KEPT_SQL, select="SELECT tag, COUNT(*) AS n FROM kept GROUP BY tag ORDER BY n DESC, tag"))
def a1(spark, sf_dir):
    return tag_counts(kept(spark, sf_dir)).orderBy(F.col("n").desc(), "tag")


@query("a2_distinct_count", V.sql(V.FACTS_SQL, select="SELECT fy, COUNT(DISTINCT symbol) AS firm_years FROM facts GROUP BY fy"))
def a2(spark, sf_dir):
    keyed = V.facts(spark, sf_dir).withColumn("FY_symbol", firm_year_key())
    return keyed.groupBy("fy").agg(F.countDistinct("FY_symbol").alias("firm_years"))


@query("a3_group_count", V.sql(V.SCORES_SQL, select="SELECT fold, truth, COUNT(*) AS n FROM scores GROUP BY fold, truth"))
def a3(spark, sf_dir):
    return V.scores(spark, sf_dir).groupBy("fold", "truth").agg(F.count(F.lit(1)).alias("n"))


@query("a4_duplicate_keys", V.sql(V.FACTS_SQL, select="""SELECT symbol, fy, tag, COUNT(*) AS n FROM facts
  GROUP BY symbol, fy, tag HAVING COUNT(*) > 1"""))
def a4(spark, sf_dir):
    return S.duplicate_keys(V.facts(spark, sf_dir), ["symbol", "fy", "tag"])


@query("a5_null_profile", V.sql(V.PANEL_SQL, select=_each(
    V.PANEL_COLUMNS, """SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS nulls FROM panel""")))
def a5(spark, sf_dir):
    return S.null_profile(V.panel(spark, sf_dir), list(V.PANEL_COLUMNS))


@query("a6_null_gate", V.sql(V.PANEL_SQL, select=f"""SELECT fy, COUNT(*) FILTER (ok) AS valid, COUNT(*) FILTER (NOT ok) AS rejected,
  bool_and(ok) AS all_valid FROM (SELECT fy, {" AND ".join(f"{c} IS NOT NULL" for c in V.PANEL_COLUMNS)} AS ok FROM panel) GROUP BY fy"""))
def a6(spark, sf_dir):
    whole = F.lit(True)
    for c in V.PANEL_COLUMNS:
        whole = whole & F.col(c).isNotNull()
    gated = V.panel(spark, sf_dir).select("fy", whole.alias("ok"))
    return gated.groupBy("fy").agg(
        F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("rejected"), F.every("ok").alias("all_valid")
    )


@query("a7_pivot_items", V.sql(KEPT_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"MAX(val) FILTER (tag = '{t}') AS {t}" for t in PANEL_ITEMS)}
  FROM kept WHERE tag IN ({", ".join(f"'{t}'" for t in PANEL_ITEMS)}) GROUP BY symbol, fy"""))
def a7(spark, sf_dir):
    return pivot_items(kept(spark, sf_dir), PANEL_ITEMS)


FOLD_RATES_SQL = V.SCORES_SQL + """,
rates AS (
  SELECT pred_cut, fold, 'accuracy' AS metric, avg(CASE WHEN p = truth THEN 1.0 ELSE 0.0 END) AS value FROM cut GROUP BY 1, 2
  UNION ALL SELECT pred_cut, fold, 'sensitivity', avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) FROM cut WHERE truth = 1 GROUP BY 1, 2
  UNION ALL SELECT pred_cut, fold, 'specificity', avg(CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END) FROM cut WHERE truth = 0 GROUP BY 1, 2),
summary AS (
  SELECT pred_cut, metric, avg(value) AS mean, COUNT(value) AS n, stddev_samp(value) / sqrt(COUNT(value)) AS std_err
  FROM rates GROUP BY pred_cut, metric)"""
CUTS = (500, 1000, 2000)
FOLD_RATES_SQL = FOLD_RATES_SQL.replace("rates AS (", f"""cut AS (
  SELECT s.*, c.pred_cut, CASE WHEN s.score * 1000 >= c.pred_cut THEN 1 ELSE 0 END AS p
  FROM scores s, (VALUES {", ".join(f"({c})" for c in CUTS)}) c(pred_cut)),
rates AS (""", 1)


def cut_rates(spark, sf_dir):
    """Fold metrics of three cut-offs."""
    cuts = V.scores(spark, sf_dir).withColumn("pred_cut", F.explode(F.array(*[F.lit(c) for c in CUTS])))
    cuts = cuts.withColumn("pred", F.when(F.col("score") * 1000 >= F.col("pred_cut"), 1).otherwise(0))
    rates = class_metrics(cuts, ["pred_cut", "fold"])
    return rates.unpivot(["pred_cut", "fold"], ["accuracy", "sensitivity", "specificity"], "metric", "value")


@query("a8_multi_measure_pivot", V.sql(FOLD_RATES_SQL, select=f"""SELECT pred_cut,
  {", ".join(f"round(MAX({m}) FILTER (metric = '{n}'), 6) AS {m}_{n}" for m in ("mean", "std_err") for n in ("accuracy", "sensitivity"))}
  FROM summary GROUP BY pred_cut"""))
def a8(spark, sf_dir):
    names, measures = ("accuracy", "sensitivity"), ("mean", "std_err")
    wide = pivot_metrics(summarise_folds(cut_rates(spark, sf_dir), ["pred_cut"]), ["pred_cut"], names, measures)
    return wide.select("pred_cut", *[r6(f"{m}_{n}") for m in measures for n in names])


@query("a9_wide_to_long", V.sql(V.SNAPSHOTS_SQL, select=_each(
    range(1, 6), "SELECT date, {c} AS id, slot{c} AS ticker FROM snapshots")))
def a9(spark, sf_dir):
    return slots_to_long(V.snapshots(spark, sf_dir), V.SLOTS, key="date")


@query("a10_report_transpose", V.sql(COMPLETE_SQL, select="""
  SELECT FY_symbol AS key, 'Ticker' AS "Name", symbol AS "Value" FROM complete
  UNION ALL SELECT FY_symbol, 'Year', CAST(fy AS VARCHAR) FROM complete
  UNION ALL SELECT FY_symbol, 'Assets', printf('%.2f', CAST(Assets AS DOUBLE)) FROM complete
  UNION ALL SELECT FY_symbol, 'debt', printf('%.2f', CAST(debt AS DOUBLE)) FROM complete"""))
def a10(spark, sf_dir):
    rows = complete(spark, sf_dir).withColumn("key", F.col("FY_symbol"))
    return report_rows(rows, ["key"], {"symbol": "Ticker", "fy": "Year"}, ["Assets", "debt"])


# ---------------------------------------------------------------- statistics


@query("a11_column_moments", V.sql(V.PANEL_SQL, select=_each(
    COLUMNS, "SELECT '{c}' AS feature, round(avg({c}) / 1000, 6) AS mean, round(stddev_samp({c}) / 1000, 6) AS sd FROM panel")))
def a11(spark, sf_dir):
    moments = S.column_moments(V.panel(spark, sf_dir), COLUMNS)
    return moments.select("feature", r6(F.col("mean") / 1000, "mean"), r6(F.col("sd") / 1000, "sd"))


@query("a12_z_score", V.sql(V.PANEL_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"round(({c} - (SELECT avg({c}) FROM panel)) / (SELECT stddev_samp({c}) FROM panel), 6) + 0.0 AS {c}" for c in COLUMNS)}
  FROM panel"""))
def a12(spark, sf_dir):
    return S.z_score(V.panel(spark, sf_dir), COLUMNS).select("symbol", "fy", *[r6(c) for c in COLUMNS])


@query("a13_winsorize_quantile", V.sql(V.PANEL_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest((SELECT quantile_cont({c}, 0.0001) FROM panel), least((SELECT quantile_cont({c}, 0.9999) FROM panel), {c})) END, 6) AS {c}" for c in COLUMNS)}
  FROM panel"""))
def a13(spark, sf_dir):
    clipped = S.winsorize_quantile(V.panel(spark, sf_dir), COLUMNS, probs=(0.0001, 0.9999))
    return clipped.select("symbol", "fy", *[r6(c) for c in COLUMNS])


MAD_SQL = V.PANEL_SQL + ",\n" + ",\n".join(
    f"m_{c} AS (SELECT median({c}) AS m, 2 * {S.MAD_SCALE} * mad({c}) AS reach FROM panel)" for c in COLUMNS
)


@query("a14_winsorize_mad", V.sql(MAD_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest((SELECT m - reach FROM m_{c}), least((SELECT m + reach FROM m_{c}), {c})) END, 6) AS {c}" for c in COLUMNS)}
  FROM panel"""))
def a14(spark, sf_dir):
    clipped = S.winsorize_mad(V.panel(spark, sf_dir), COLUMNS)
    return clipped.select("symbol", "fy", *[r6(c) for c in COLUMNS])


@query("a15_histogram", V.sql(V.PANEL_SQL, select=_each(COLUMNS, """
  SELECT '{c}' AS feature, CAST(CASE WHEN hi = lo THEN 1 ELSE least(k, greatest(1, ceil(({c} - lo) / ((hi - lo) / k)))) END AS INT) AS bin,
    COUNT(*) AS n FROM panel, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, ceil(log2(COUNT({c})) + 1) AS k FROM panel)
  WHERE {c} IS NOT NULL GROUP BY bin""")))
def a15(spark, sf_dir):
    return S.histogram(V.panel(spark, sf_dir), COLUMNS)
