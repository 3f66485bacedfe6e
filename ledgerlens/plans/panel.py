"""Facts -> complete firm-year panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import firm_year_key
from ledgerlens.operators.canonical import rank_candidates, resolve_items
from ledgerlens.operators.dedup import keep_last
from ledgerlens.rules import PANEL_ITEMS, PANEL_YEARS, RULES, Rule
from ledgerlens.session import cut_lineage


def derive_items(panel: DataFrame) -> DataFrame:
    """`debt` and `EBITDA`, then fill FixedAssets and CurrentAssets from one another, in this order."""
    return (
        panel.withColumns({
            "debt": F.col("Assets") - F.col("Equity"),
            "EBITDA": F.col("PreTaxIncome") + F.col("DepreciationAmortization"),
        })
        .withColumn("FixedAssets", F.coalesce("FixedAssets", F.col("Assets") - F.col("CurrentAssets")))
        .withColumn("CurrentAssets", F.coalesce("CurrentAssets", F.col("Assets") - F.col("FixedAssets")))
    )


def complete_panel(panel: DataFrame, items: tuple[str, ...] = PANEL_ITEMS) -> DataFrame:
    """Derived items added; firm-years with any missing item dropped."""
    return derive_items(panel).na.drop(subset=[*items, "debt", "EBITDA"])


def items_per_firm_year(
    facts: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    items: tuple[str, ...] = PANEL_ITEMS,
    years: tuple[int, ...] | None = PANEL_YEARS,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Annual facts -> canonical items, wide. Ranks see all years; only then are years selected.

    The keep-last rows feed both the ranks and the items. They are checkpointed, so the large shuffles over raw
    facts run once; with saved `ranks` there is nothing to share.
    """
    kept = keep_last(facts).select("symbol", "fy", "tag", "val")
    if ranks is None:
        kept = cut_lineage(kept)
        ranks = rank_candidates(kept, rules)
    if years is not None:
        kept = kept.filter(F.col("fy").isin(*years))
    return resolve_items(kept, ranks, rules, items).withColumn("FY_symbol", firm_year_key())


def facts_to_panel(
    facts: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    items: tuple[str, ...] = PANEL_ITEMS,
    years: tuple[int, ...] | None = PANEL_YEARS,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Annual facts -> (symbol, fy, FY_symbol, items, debt, EBITDA), complete cases only."""
    return complete_panel(items_per_firm_year(facts, rules, items, years, ranks), items)
