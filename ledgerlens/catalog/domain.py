"""Queries for tag canonicalisation, the panel, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import views as V
from ledgerlens.catalog.analytics import KEPT_SQL, kept
from ledgerlens.catalog.registry import query, r6, stage
from ledgerlens.catalog.relational import COMPLETE_SQL, complete
from ledgerlens.operators.canonical import apply_rules, canonicalize, rank_candidates, resolve_items
from ledgerlens.operators.dedup import annual_facts
from ledgerlens.operators.features import (
    ACCRUAL_TERMS, CHANGE_NAMES, CHANGE_OF, FEATURES, RATIO_NAMES, RATIO_PARTS, accrual_inputs, band_label,
    change_features, ols_residuals, ratio_features,
)
from ledgerlens.operators.regression_state import product_state, state_coefficients
from ledgerlens.plans.feature_table import feature_table
from ledgerlens.plans.panel import facts_to_panel
from ledgerlens.rules import PANEL_ITEMS, RULES, Rule
from ledgerlens.session import cut_lineage

TARGETS = tuple(r.target for r in RULES)
ITEM_YEARS = (1996, 1997, 1998, 1999, 2000)
# The rule that ranks by counts taken before an earlier rule rewrote rows, and that earlier rule.
STALE_RULE, STALE_SINCE = 15, 6


# Ranks and items both start from the keep-last facts.
last_facts = stage("last_facts", lambda spark, sf_dir: kept(spark, sf_dir).select("symbol", "fy", "tag", "val"))


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _accepts_sql(rule: Rule, tag: str = "tag") -> str:
    listed = f"{tag} IN ({_quoted(rule.allow)})" if rule.allow else f"{tag} NOT IN ({_quoted(rule.deny)})"
    return f"regexp_matches({tag}, '{rule.pattern}', 'i') AND {listed}"


def sequence_sql() -> str:
    """All rules one after the other, each ranking by the counts of its own moment: the definition."""
    steps = ["s0 AS MATERIALIZED (SELECT symbol, fy, tag, val FROM kept)"]
    for i, rule in enumerate(RULES):
        counted = f"s{STALE_SINCE}" if i == STALE_RULE else f"s{i}"
        steps.append(f"""r{i} AS MATERIALIZED (
          SELECT tag, row_number() OVER (ORDER BY COUNT(*) DESC, tag) AS rank FROM {counted}
          WHERE {_accepts_sql(rule)} GROUP BY tag)""")
        steps.append(f"""b{i} AS MATERIALIZED (
          SELECT symbol, fy, arg_min(r{i}.tag, rank) FILTER (rank IS NOT NULL) AS best
          FROM s{i} LEFT JOIN r{i} ON s{i}.tag = r{i}.tag GROUP BY symbol, fy
          HAVING NOT bool_or(s{i}.tag = '{rule.target}'))""")
        steps.append(f"""s{i + 1} AS MATERIALIZED (
          SELECT s.symbol, s.fy, CASE WHEN b.best = s.tag THEN '{rule.target}' ELSE s.tag END AS tag, s.val
          FROM s{i} s LEFT JOIN b{i} b ON s.symbol = b.symbol AND s.fy = b.fy)""")
    return KEPT_SQL + ",\n" + ",\n".join(steps)


SEQUENCE_SQL = sequence_sql()
LAST = f"s{len(RULES)}"


def _pivot_sql(items) -> str:
    return ", ".join(f"MAX(val) FILTER (tag = '{i}') AS {i}" for i in items)


# ---------------------------------------------------------------- canonicalisation


@query("c1_rank_candidates", V.sql(KEPT_SQL, select=" UNION ALL ".join(f"""
  SELECT {i} AS rule, tag, COUNT(*) AS n, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, tag) AS INT) AS rank
  FROM kept WHERE {_accepts_sql(r)} GROUP BY tag""" for i, r in enumerate(RULES))))
def c1(spark, sf_dir):
    return rank_candidates(kept(spark, sf_dir))


@query("c2_canonicalize", V.sql(SEQUENCE_SQL, select="SELECT symbol, fy, tag, val FROM s1"))
def c2(spark, sf_dir):
    facts = last_facts(spark, sf_dir)
    return canonicalize(facts, rank_candidates(facts, RULES[:1]), 0, RULES[0])


@query("c2_canonicalize_sequence", V.sql(SEQUENCE_SQL, select=f"SELECT symbol, fy, tag, val FROM {LAST}"))
def c2_sequence(spark, sf_dir):
    facts = last_facts(spark, sf_dir)
    return apply_rules(facts, rank_candidates(facts))


@query("c3_resolve_items", V.sql(SEQUENCE_SQL, select=f"""SELECT symbol, fy, {_pivot_sql(TARGETS)} FROM {LAST}
  WHERE tag IN ({_quoted(TARGETS)}) GROUP BY symbol, fy"""))
def c3(spark, sf_dir):
    facts = last_facts(spark, sf_dir)
    return resolve_items(facts, rank_candidates(facts))


@query("c4_select_items", V.sql(KEPT_SQL, select=f"""SELECT symbol, fy, tag, val FROM kept
  WHERE tag IN ({_quoted(PANEL_ITEMS)}) AND fy IN ({", ".join(map(str, ITEM_YEARS))})"""))
def c4(spark, sf_dir):
    facts = kept(spark, sf_dir)
    return facts.filter(F.col("tag").isin(*PANEL_ITEMS) & F.col("fy").isin(*ITEM_YEARS)).select("symbol", "fy", "tag", "val")


def whole_panel_sql(years: str = "true") -> str:
    """View `whole`: complete firm-years of canonical items."""
    return SEQUENCE_SQL + f""",
wide AS (
  SELECT symbol, fy, {_pivot_sql(PANEL_ITEMS)} FROM {LAST}
  WHERE tag IN ({_quoted(PANEL_ITEMS)}) AND {years} GROUP BY symbol, fy),
derived AS (SELECT *, Assets - Equity AS debt, PreTaxIncome + DepreciationAmortization AS EBITDA FROM wide),
fixed AS (SELECT * REPLACE (coalesce(FixedAssets, Assets - CurrentAssets) AS FixedAssets) FROM derived),
filled AS (SELECT * REPLACE (coalesce(CurrentAssets, Assets - FixedAssets) AS CurrentAssets) FROM fixed),
whole AS (SELECT *, concat(CAST(fy AS VARCHAR), ' ', symbol) AS FY_symbol FROM filled
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PANEL_ITEMS)})"""


@query("c5_facts_to_panel", V.sql(whole_panel_sql(f"fy IN ({', '.join(map(str, ITEM_YEARS))})"), select="SELECT * FROM whole"))
def c5(spark, sf_dir):
    return facts_to_panel(annual_facts(V.facts(spark, sf_dir)), years=ITEM_YEARS)


# ---------------------------------------------------------------- features and labels

_WC = "(CurrentAssets - CurrentLiabilities)"


def _term(text: str) -> str:
    return _WC if text and text.startswith("(CurrentAssets -") else text


def _ratio_sql(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


RATIOS_SQL = COMPLETE_SQL + f""",
ratios AS (
  SELECT *, {", ".join(f"{_ratio_sql(_term(a), _term(b))} AS {n}" for n, a, b in RATIO_PARTS if a)},
    CASE WHEN Revenues = 0 THEN NULL WHEN AccountsReceivable = 0 THEN 0.0
         ELSE 360.0 / (CAST(Revenues AS DOUBLE) / AccountsReceivable) END AS DaysSalesinAccountingReceivable
  FROM complete)"""
FEATURES_SQL = RATIOS_SQL + f""",
changes AS (
  SELECT *, {", ".join(f"{_term(x)} - lag({_term(x)}, 1, {_term(x)}) OVER w AS {n}" for n, x in CHANGE_OF)}
  FROM ratios WINDOW w AS (PARTITION BY symbol ORDER BY fy)),
features AS (SELECT * REPLACE ({", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in FEATURES)}) FROM changes)"""
ACCRUALS_SQL = FEATURES_SQL + """,
lagged AS (
  SELECT *, row_number() OVER w AS rn, nullif(lag(Assets, 1, Assets) OVER w, 0) AS a0,
    CurrentAssets - lag(CurrentAssets, 1, CurrentAssets) OVER w AS d_ca,
    CurrentLiabilities - lag(CurrentLiabilities, 1, CurrentLiabilities) OVER w AS d_cl,
    Cash - lag(Cash, 1, Cash) OVER w AS d_cash, Revenues - lag(Revenues, 1, Revenues) OVER w AS d_rev,
    AccountsReceivable - lag(AccountsReceivable, 1, AccountsReceivable) OVER w AS d_ar
  FROM features WINDOW w AS (PARTITION BY symbol ORDER BY fy)),
accruals AS (
  SELECT symbol, fy, FY_symbol, CAST(d_ca - d_cl - d_cash - DepreciationAmortization AS DOUBLE) / a0 AS DV, 1.0::DOUBLE / a0 AS IV1,
    CAST(d_rev - d_ar AS DOUBLE) / a0 AS IV2, CAST(PropertyPlantAndEquipment AS DOUBLE) / a0 AS IV3, ROA AS IV4
  FROM lagged WHERE rn > 1)"""


def _residualise(source: str, target: str, columns: list[str], on: str) -> str:
    fits = ", ".join(f"regr_slope({c}, {on}) AS b_{c}, regr_intercept({c}, {on}) AS a_{c}" for c in columns)
    left = ", ".join(f"{c} - a_{c} - b_{c} * {on} AS {c}" for c in columns)
    return f"{target} AS MATERIALIZED (SELECT symbol, fy, {left} FROM {source}, (SELECT {fits} FROM {source}))"


# Frisch-Waugh: take every regressor out of the rest in turn; what is left of DV is the residual.
RESIDUALS_SQL = ACCRUALS_SQL + ",\n" + ",\n".join([
    "q0 AS MATERIALIZED (SELECT symbol, fy, DV, IV1 * 1e6 AS IV1, IV2, IV3, IV4 FROM accruals)",
    _residualise("q0", "q1", ["DV", "IV2", "IV3", "IV4"], "IV1"),
    _residualise("q1", "q2", ["DV", "IV3", "IV4"], "IV2"),
    _residualise("q2", "q3", ["DV", "IV4"], "IV3"),
    _residualise("q3", "q4", ["DV"], "IV4"),
])


def with_changes(spark, sf_dir):
    return change_features(complete(spark, sf_dir))


@query("f1_ratio_features", V.sql(RATIOS_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"round(coalesce({n}, 0), 6) + 0.0 AS {n}" for n in RATIO_NAMES)} FROM ratios"""))
def f1(spark, sf_dir):
    return ratio_features(complete(spark, sf_dir)).select("symbol", "fy", *[r6(n) for n in RATIO_NAMES])


@query("f2_change_features", V.sql(FEATURES_SQL, select=f"""SELECT symbol, fy,
  {", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in CHANGE_NAMES)} FROM features"""))
def f2(spark, sf_dir):
    return with_changes(spark, sf_dir).select("symbol", "fy", *[r6(n) for n in CHANGE_NAMES])


@query("f3_accrual_inputs", V.sql(ACCRUALS_SQL, select="""SELECT symbol, fy, round(DV, 6) + 0.0 AS DV, round(IV1 * 1e6, 6) AS IV1,
  round(IV2, 6) + 0.0 AS IV2, round(IV3, 6) AS IV3, round(IV4, 6) AS IV4 FROM accruals"""))
def f3(spark, sf_dir):
    rows = accrual_inputs(with_changes(spark, sf_dir))
    return rows.select("symbol", "fy", r6("DV"), r6(F.col("IV1") * 1e6, "IV1"), r6("IV2"), r6("IV3"), r6("IV4"))


accruals = stage("accruals", lambda spark, sf_dir: accrual_inputs(with_changes(spark, sf_dir)))


@query("f4_ols_residuals", V.sql(RESIDUALS_SQL, select="SELECT symbol, fy, round(DV, 5) + 0.0 AS residual FROM q4"))
def f4(spark, sf_dir):
    rows = ols_residuals(accruals(spark, sf_dir), "DV", ACCRUAL_TERMS)
    return rows.select("symbol", "fy", (F.round("residual", 5) + 0.0).alias("residual"))


@query("f4_incremental_residuals", V.sql(RESIDUALS_SQL, select="SELECT symbol, fy, round(DV, 5) + 0.0 AS residual FROM q4"))
def f4_incremental(spark, sf_dir):
    """One state row per fiscal year, as if each year had come as a batch."""
    rows = accruals(spark, sf_dir)
    states = product_state(rows, "DV", ACCRUAL_TERMS, by=("fy",))
    rows = ols_residuals(rows, "DV", ACCRUAL_TERMS, coefficients=state_coefficients(states))
    return rows.select("symbol", "fy", (F.round("residual", 5) + 0.0).alias("residual"))


@query("f5_band_label", V.sql(ACCRUALS_SQL, select="""SELECT symbol, fy, CASE WHEN DV BETWEEN m - s AND m + s THEN 0 ELSE 1 END AS label
  FROM accruals, (SELECT avg(DV) AS m, stddev_samp(DV) AS s FROM accruals)"""))
def f5(spark, sf_dir):
    return band_label(accrual_inputs(with_changes(spark, sf_dir)), "DV").select("symbol", "fy", "label")


@query("f5_residual_label", V.sql(RESIDUALS_SQL, select="""SELECT symbol, fy, CASE WHEN DV BETWEEN m - s AND m + s THEN 0 ELSE 1 END AS label
  FROM q4, (SELECT avg(DV) AS m, stddev_samp(DV) AS s FROM q4)"""))
def f5_residual(spark, sf_dir):
    rows = ols_residuals(accruals(spark, sf_dir), "DV", ACCRUAL_TERMS)
    return band_label(rows, "residual").select("symbol", "fy", "label")


# The firm-years are stored first, so that the shuffles of lines and orders are deleted before firms are shuffled.
features = stage("features", lambda spark, sf_dir: feature_table(cut_lineage(complete(spark, sf_dir))))


@query("f6_feature_table", V.sql(RESIDUALS_SQL + f""",
clipped AS MATERIALIZED (
  SELECT symbol, fy, FY_symbol, {", ".join(f"greatest(quantile_cont({f}, 0.0001) OVER (), least(quantile_cont({f}, 0.9999) OVER (), {f})) AS {f}" for f in FEATURES)}
  FROM lagged WHERE rn > 1),
moments AS MATERIALIZED (SELECT {", ".join(f"avg({f}) AS m_{f}, nullif(stddev_samp({f}), 0) AS s_{f}" for f in FEATURES)} FROM clipped),
labels_ AS MATERIALIZED (SELECT symbol, fy, CASE WHEN DV BETWEEN m - s AND m + s THEN 0 ELSE 1 END AS label
  FROM q4, (SELECT avg(DV) AS m, stddev_samp(DV) AS s FROM q4))""",
    select=f"""SELECT c.symbol, c.fy, c.FY_symbol, {", ".join(f"round(coalesce((c.{f} - m_{f}) / s_{f}, 0), 5) + 0.0 AS {f}" for f in FEATURES)},
  l.label AS DiscretionaryAccrualsBinary FROM clipped c JOIN labels_ l ON c.symbol = l.symbol AND c.fy = l.fy, moments"""))
def f6(spark, sf_dir):
    rounded = [(F.round(f, 5) + 0.0).alias(f) for f in FEATURES]
    return features(spark, sf_dir).select("symbol", "fy", "FY_symbol", *rounded, "DiscretionaryAccrualsBinary")


_BOUNDS = ", ".join(f"quantile_cont({f}, 0.0001) AS lo_{f}, quantile_cont({f}, 0.9999) AS hi_{f}" for f in FEATURES)
_CLIP = ", ".join(f"greatest(lo_{f}, least(hi_{f}, {f})) AS {f}" for f in FEATURES)


@query("f6_feature_table_train", V.sql(RESIDUALS_SQL + f""",
labelled AS MATERIALIZED (SELECT l.*, CASE WHEN q.DV BETWEEN m - s AND m + s THEN 0 ELSE 1 END AS label
  FROM lagged l JOIN q4 q USING (symbol, fy), (SELECT avg(DV) AS m, stddev_samp(DV) AS s FROM q4) WHERE l.rn > 1),
split_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(FY_symbol, '#1')), FY_symbol)
    <= floor(COUNT(*) OVER (PARTITION BY label) * 0.7::DOUBLE) AS is_train FROM labelled),
bounds AS MATERIALIZED (SELECT {_BOUNDS} FROM split_ WHERE is_train),
clipped AS MATERIALIZED (SELECT symbol, fy, FY_symbol, label, is_train, {_CLIP} FROM split_, bounds),
moments AS MATERIALIZED (SELECT {", ".join(f"avg({f}) AS m_{f}, nullif(stddev_samp({f}), 0) AS s_{f}" for f in FEATURES)} FROM clipped WHERE is_train)""",
    select=f"""SELECT symbol, fy, FY_symbol, {", ".join(f"round(coalesce(({f} - m_{f}) / s_{f}, 0), 5) + 0.0 AS {f}" for f in FEATURES)},
  label AS DiscretionaryAccrualsBinary FROM clipped, moments"""))
def f6_train(spark, sf_dir):
    """Features whose winsorizing and scaling see the training rows only."""
    rounded = [(F.round(f, 5) + 0.0).alias(f) for f in FEATURES]
    table = feature_table(complete(spark, sf_dir), fit_scope="train")
    return table.select("symbol", "fy", "FY_symbol", *rounded, "DiscretionaryAccrualsBinary")
