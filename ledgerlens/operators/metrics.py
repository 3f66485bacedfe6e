"""Classification metrics as grouped aggregates. The event is class 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import running_totals
from ledgerlens.session import cut_lineage

METRICS = ("accuracy", "sensitivity", "specificity", "roc_auc")


def confusion_matrix(scored: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred_1, pred_0) counts."""
    return scored.groupBy(truth).agg(
        F.count_if(F.col(pred) == 1).alias("pred_1"), F.count_if(F.col(pred) == 0).alias("pred_0")
    )


def _rate(hit: Column, base: Column) -> Column:
    return F.try_divide(F.count_if(hit).cast("double"), F.count_if(base).cast("double"))


def class_metrics(scored: DataFrame, groups: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(groups, accuracy, sensitivity, specificity) in one aggregate."""
    right, event = F.col(truth) == F.col(pred), F.col(truth) == 1
    return scored.groupBy(*groups).agg(
        _rate(right, F.col(truth).isNotNull()).alias("accuracy"),
        _rate(right & event, event).alias("sensitivity"),
        _rate(right & ~event, ~event).alias("specificity"),
    )


def roc_auc(
    scored: DataFrame, groups: list[str], truth: str = "truth", score: str = "score", group_bound: int | None = None
) -> DataFrame:
    """(groups, roc_auc): share of (event, other) pairs that the score orders rightly, ties count half.

    Rows are reduced to distinct scores first, which are stored since they are read three times; the number of others below each score is an exact running
    total over ordered buckets, so no group is sorted in one task and no pair is formed.
    """
    by_score = cut_lineage(scored.groupBy(*groups, score).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    ))
    return _areas(by_score, groups, score, group_bound)


def _areas(by_score: DataFrame, groups: list[str], score: str, group_bound: int | None) -> DataFrame:
    ranked = running_totals(by_score, groups, score, ["neg"], group_bound)
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.groupBy(*groups).agg(
        F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc")
    )


def fold_metrics(
    scored: DataFrame, groups: list[str], truth: str = "truth", pred: str = "pred", score: str = "score",
    group_bound: int | None = None,
) -> DataFrame:
    """(groups, metric, value) rows of all four metrics: `class_metrics` and `roc_auc`, both from counts by score, for which `scored` is read once."""
    right, event = F.col(truth) == F.col(pred), F.col(truth) == 1
    by_score = cut_lineage(scored.groupBy(*groups, score).agg(
        F.count_if(event).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"), F.count(truth).alias("n"),
        F.count_if(right & event).alias("pos_hits"), F.count_if(right & ~event).alias("other_hits"),
    ))
    total = {c: F.sum(c).cast("double") for c in ("n", "pos", "pos_hits", "other_hits")}
    rates = by_score.groupBy(*groups).agg(
        F.try_divide(total["pos_hits"] + total["other_hits"], total["n"]).alias("accuracy"),
        F.try_divide(total["pos_hits"], total["pos"]).alias("sensitivity"),
        F.try_divide(total["other_hits"], total["n"] - total["pos"]).alias("specificity"),
    )
    areas = _areas(by_score.select(*groups, score, "pos", "neg"), groups, score, group_bound)
    return rates.join(areas, groups, "left").unpivot(list(groups), list(METRICS), "metric", "value")


def summarise_folds(metrics: DataFrame, configs: list[str]) -> DataFrame:
    """(configs, metric, mean, n, std_err) over folds."""
    return metrics.groupBy(*configs, "metric").agg(
        F.avg("value").alias("mean"),
        F.count("value").alias("n"),
        F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("value").cast("double"))).alias("std_err"),
    )


def select_best(summary: DataFrame, metric: str, config: str = "config") -> DataFrame:
    """The configuration with the highest mean of the metric; the first one on ties."""
    return summary.filter(F.col("metric") == metric).orderBy(F.col("mean").desc_nulls_last(), config).limit(1)
