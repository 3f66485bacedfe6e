"""Queries for resampling, metrics, models, tuning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import views as V
from ledgerlens.catalog.analytics import FOLD_RATES_SQL, KEPT_SQL, cut_rates
from ledgerlens.catalog.domain import ACCRUALS_SQL, ITEM_YEARS, RESIDUALS_SQL, accruals, features, last_facts, whole_panel_sql
from ledgerlens.catalog.registry import query, r6, stage
from ledgerlens.catalog.relational import COMPLETE_SQL, complete, documents
from ledgerlens.functions import expressions as E
from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as ML
from ledgerlens.operators import resample as R
from ledgerlens.operators import tuning as T
from ledgerlens.operators.bagging import fit_bagged_trees, out_of_bag_importance, out_of_bag_scores
from ledgerlens.operators.canonical import rank_candidates
from ledgerlens.operators.dedup import annual_facts, keep_last
from ledgerlens.operators.features import ACCRUAL_TERMS, FEATURES, band_label, column_filter, ols_residuals
from ledgerlens.operators.penalty_path import entry_penalties
from ledgerlens.operators.reshape import pivot_metrics
from ledgerlens.operators.staged import fit_boosting_stopped
from ledgerlens.operators.stats import apply_normalisation, fit_normalisation
from ledgerlens.operators.value_state import store_batch, stored_normalisation
from ledgerlens.plans.feature_table import LABEL, labelled_features
from ledgerlens.plans.panel import facts_to_panel
from ledgerlens.plans.scoring import (
    append_to_history, normalise_with_history, report, score_batch, two_year_window,
)
from ledgerlens.plans.training import feature_names, scoring_models
from ledgerlens.session import cut_lineage, scratch_path
from ledgerlens.sources.company_facts import explode_facts, parse_documents
from ledgerlens.sources.readers import read_company_facts
from ledgerlens.sources.writers import load_model, load_tuning, save_model, save_tuning
from ledgerlens.streaming.score_stream import latest_scores, start_scoring

KEY = "FY_symbol"

# ---------------------------------------------------------------- resampling

_HASH = "md5(concat(CAST(doc_id AS VARCHAR), '#1'))"


@query("m1_stratified_split", V.sql(V.SCORES_SQL, select=f"""SELECT doc_id, truth,
  row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, doc_id) <= floor(COUNT(*) OVER (PARTITION BY truth) * 0.7::DOUBLE) AS is_train
  FROM scores"""))
def m1(spark, sf_dir):
    return R.stratified_split(V.scores(spark, sf_dir), "truth", "doc_id").select("doc_id", "truth", "is_train")


@query("m2_stratified_folds", V.sql(V.SCORES_SQL, select=f"""SELECT doc_id, truth,
  CAST((row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, doc_id) - 1) % 10 AS INT) AS fold FROM scores"""))
def m2(spark, sf_dir):
    rows = V.scores(spark, sf_dir).drop("fold")
    return R.stratified_folds(rows, "truth", "doc_id").select("doc_id", "truth", "fold")


@query("m3_downsample", V.sql(V.SCORES_SQL, select=f"""SELECT doc_id, truth, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, doc_id)
    <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM scores GROUP BY truth))"""))
def m3(spark, sf_dir):
    return R.downsample(V.scores(spark, sf_dir), "truth", "doc_id").select("doc_id", "truth", "score")


_KEYS_SQL = ACCRUALS_SQL  # one firm-year of `lagged` after the first is one row of the feature table


@query("m4_role_exclusion", V.sql(_KEYS_SQL, select=f"""SELECT symbol, fy, FY_symbol, {len(FEATURES)} AS predictors FROM lagged WHERE rn > 1"""))
def m4(spark, sf_dir):
    """Keys ride along and are not predictors: the model's inputs are listed by name."""
    table = features(spark, sf_dir)
    model = ML.fit_lasso(table, feature_names(table), LABEL, penalty=0.05)
    inputs = F.array(*[F.lit(c) for c in model.stages[0].getInputCols()])
    return ML.predict(model, table).select("symbol", "fy", KEY, F.size(inputs).alias("predictors"))


_LABELLED_SQL = """
labelled AS (SELECT d.doc_id, CAST(l.quality AS INT) AS truth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("m1_split_null_labels", V.sql(_LABELLED_SQL, select=f"""SELECT doc_id, truth,
  row_number() OVER (PARTITION BY truth ORDER BY {_HASH}, doc_id) <= floor(COUNT(*) OVER (PARTITION BY truth) * 0.7::DOUBLE) AS is_train
  FROM labelled"""))
def m1_null_labels(spark, sf_dir):
    """Documents without a label are split like a class of their own."""
    labels = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("truth"))
    rows = V.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return R.stratified_split(rows, "truth", "doc_id").select("doc_id", "truth", "is_train")


# ---------------------------------------------------------------- metrics


@query("m5_confusion_matrix", V.sql(V.SCORES_SQL, select="""SELECT truth, COUNT(*) FILTER (pred = 1) AS pred_1,
  COUNT(*) FILTER (pred = 0) AS pred_0 FROM scores GROUP BY truth"""))
def m5(spark, sf_dir):
    return M.confusion_matrix(V.scores(spark, sf_dir))


@query("m6_class_metrics", V.sql(V.SCORES_SQL, select="""SELECT fold,
  round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0.0 END) FILTER (truth = 1), 6) AS sensitivity,
  round(avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) FILTER (truth = 0), 6) AS specificity FROM scores GROUP BY fold"""))
def m6(spark, sf_dir):
    rates = M.class_metrics(V.scores(spark, sf_dir), ["fold"])
    return rates.select("fold", r6("accuracy"), r6("sensitivity"), r6("specificity"))


_AUC = """round((SUM(rk) FILTER (truth = 1) - COUNT(*) FILTER (truth = 1) * (COUNT(*) FILTER (truth = 1) + 1) / 2.0)
  / (COUNT(*) FILTER (truth = 1) * COUNT(*) FILTER (truth = 0)), 6) AS roc_auc"""


def _ranks(group: str) -> str:
    return f"""SELECT *, rank() OVER ({group} ORDER BY score) + (COUNT(*) OVER ({group} ORDER BY score RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 AS rk FROM scores"""


@query("m7_roc_auc", V.sql(V.SCORES_SQL, select=f"SELECT {_AUC} FROM ({_ranks('')})"))
def m7(spark, sf_dir):
    return M.roc_auc(V.scores(spark, sf_dir), []).select(r6("roc_auc"))


@query("m7_roc_auc_by_fold", V.sql(V.SCORES_SQL, select=f"SELECT fold, {_AUC} FROM ({_ranks('PARTITION BY fold')}) GROUP BY fold"))
def m7_by_fold(spark, sf_dir):
    return M.roc_auc(V.scores(spark, sf_dir), ["fold"], group_bound=5).select("fold", r6("roc_auc"))


@query("m8_fold_summary", V.sql(
    FOLD_RATES_SQL, select="SELECT pred_cut, metric, round(mean, 6) AS mean, n, round(std_err, 6) AS std_err FROM summary"))
def m8(spark, sf_dir):
    summary = M.summarise_folds(cut_rates(spark, sf_dir), ["pred_cut"])
    return summary.select("pred_cut", "metric", r6("mean"), "n", r6("std_err"))


GRID = R.grid_points(cut=[500, 1000, 2000], weight=[1, 3])


@query("m9_grid", V.sql(V.SCORES_SQL, select=f"""SELECT g.config, g.cut, g.weight,
  CAST(SUM(CASE WHEN truth = 1 AND score * 1000 < g.cut THEN g.weight WHEN truth = 0 AND score * 1000 >= g.cut THEN 1 ELSE 0 END) AS BIGINT) AS cost
  FROM scores, (VALUES {", ".join(f"({p['config']}, {p['cut']}, {p['weight']})" for p in GRID)}) g(config, cut, weight)
  GROUP BY g.config, g.cut, g.weight"""))
def m9(spark, sf_dir):
    """Cost of every grid point: the grid is inlined next to each row and aggregated map-side."""
    points = V.scores(spark, sf_dir).select("truth", "score", F.inline(R.grid_column(GRID)))
    above = F.col("score") * 1000 >= F.col("cut")
    cost = F.when((F.col("truth") == 1) & ~above, F.col("weight")).when((F.col("truth") == 0) & above, 1).otherwise(0)
    return points.groupBy("config", "cut", "weight").agg(F.sum(cost).alias("cost"))


@query("m11_select_best", V.sql(FOLD_RATES_SQL, select="""SELECT pred_cut, metric, round(mean, 6) AS mean FROM summary
  WHERE metric = 'accuracy' ORDER BY summary.mean DESC, pred_cut LIMIT 1"""))
def m11(spark, sf_dir):
    summary = M.summarise_folds(cut_rates(spark, sf_dir), ["pred_cut"])
    return M.select_best(summary, "accuracy", "pred_cut").select("pred_cut", "metric", r6("mean"))


@query("m13_metric_query", V.sql(FOLD_RATES_SQL, select="""SELECT pred_cut,
  round(MAX(mean) FILTER (metric = 'accuracy'), 6) AS mean_accuracy, round(MAX(mean) FILTER (metric = 'specificity'), 6) AS mean_specificity
  FROM summary WHERE pred_cut >= 1000 GROUP BY pred_cut"""))
def m13(spark, sf_dir):
    summary = M.summarise_folds(cut_rates(spark, sf_dir), ["pred_cut"]).filter(F.col("pred_cut") >= 1000)
    wide = pivot_metrics(summary, ["pred_cut"], ("accuracy", "specificity"), ("mean",))
    return wide.select("pred_cut", r6("mean_accuracy"), r6("mean_specificity"))


# ---------------------------------------------------------------- models and tuning

split = stage("split", lambda spark, sf_dir: R.stratified_split(features(spark, sf_dir), LABEL, KEY))


def _train(spark, sf_dir):
    return split(spark, sf_dir).filter("is_train").drop("is_train")


def _fitted(kind, spark, sf_dir, **params):
    train = _train(spark, sf_dir)
    return ML.fit_balanced(kind, train, feature_names(train), LABEL, KEY, **params)


def _tuned(kind, grid, spark, sf_dir, folds=3):
    train = R.stratified_folds(_train(spark, sf_dir), LABEL, KEY, folds=folds)
    metrics = T.tune_grid(kind, train, feature_names(train), LABEL, KEY, grid)
    return T.tuning_table(metrics, grid)


@query("m10_tune_lasso")
def m10(spark, sf_dir):
    """The whole grid of 100 penalties on ten folds."""
    return _tuned("lasso", R.FULL_GRIDS["lasso"], spark, sf_dir, folds=10)


@query("m10_tune_forest")
def m10_forest(spark, sf_dir):
    """Two points of the grid's 600 on three folds of its ten: a part, 6000 fits being hours here."""
    points = [p for p in R.FULL_GRIDS["forest"] if p["mtry"] == 7 and p["trees"] <= 100]
    return _tuned("forest", points, spark, sf_dir)


@query("m10_tune_boosting")
def m10_boosting(spark, sf_dir):
    """The first rounds of three of the grid's ensembles on three folds: a part, 500 rounds, the least size, taking over 2 minutes a fit."""
    return _tuned("boosting", R.grid_points(trees=[5, 10], learn_rate=[0.1], depth=[1, 2, 3]), spark, sf_dir)


@query("m10_tune_kernel")
def m10_kernel(spark, sf_dir):
    """Two points of the grid's 40 on three folds of its ten: a part, a fit taking some 6 s here."""
    points = [p for p in R.FULL_GRIDS["kernel"] if p["sigma"] in (1e-3, 1e-2) and p["cost"] == 10.0]
    return _tuned("kernel", points, spark, sf_dir)


@query("m12_last_fit")
def m12(spark, sf_dir):
    table = split(spark, sf_dir)
    _, metrics, _ = T.last_fit("lasso", table, feature_names(table), LABEL, KEY, penalty=0.05)
    return metrics


@query("ml1_lasso_coefficients")
def ml1(spark, sf_dir):
    train = _train(spark, sf_dir)
    return ML.coefficient_table(_fitted("lasso", spark, sf_dir, penalty=0.02), feature_names(train), train)


_CHANGED_SQL = RESIDUALS_SQL + """,
labelled AS (SELECT l.*, CASE WHEN q.DV BETWEEN m - s AND m + s THEN 0.0 ELSE 1.0 END AS label
  FROM lagged l JOIN q4 q USING (symbol, fy), (SELECT avg(DV) AS m, stddev_samp(DV) AS s FROM q4) WHERE l.rn > 1)"""


@query("ml1_entry_penalties", V.sql(_CHANGED_SQL, select=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(CASE WHEN min({f}) < max({f}) THEN abs(covar_pop({f}, label)) / stddev_samp({f}) END, 5) AS entry FROM labelled" for f in FEATURES)))
def ml1_entry(spark, sf_dir):
    """Where each feature would enter the LASSO path, on features that are not normalised: the path does not depend on it."""
    rows = band_label(ols_residuals(accruals(spark, sf_dir), "DV", ACCRUAL_TERMS, "DiscretionaryAccruals"), "DiscretionaryAccruals", name=LABEL)
    return entry_penalties(rows, FEATURES, LABEL).select("feature", F.round("entry", 5).alias("entry"))


@query("f7_column_filter")
def f7(spark, sf_dir):
    table = features(spark, sf_dir)
    model = _fitted("lasso", spark, sf_dir, penalty=0.05)
    return column_filter(table, ML.coefficients(model, feature_names(table)))


# The firm-years that the split leaves for testing, with their labels.
_TESTED_SQL = _CHANGED_SQL + """,
tested AS (SELECT symbol, fy, CAST(label AS INT) AS truth FROM labelled
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat(FY_symbol, '#1')), FY_symbol)
    > floor(COUNT(*) OVER (PARTITION BY label) * 0.7::DOUBLE))"""
_TESTED = V.sql(_TESTED_SQL, select="SELECT symbol, fy, truth, true AS valid FROM tested")


def _predicted(kind, spark, sf_dir):
    """Test rows with their labels; `valid` says that class and score are there and agree with each other."""
    test = split(spark, sf_dir).filter(~F.col("is_train"))
    model = _fitted(kind, spark, sf_dir, **ML.SCORING_PARAMS[kind])
    return _checked(ML.predict(model, test), 0.0 if kind == "kernel" else 0.5)


def _checked(scored, cut):
    agrees = F.col("score").isNotNull() & ~F.isnan("score") & ((F.col("score") > cut) == (F.col("pred") == 1)) | (F.col("score") == cut)
    return scored.select("symbol", "fy", F.col(LABEL).cast("int").alias("truth"), agrees.alias("valid"))


@query("m12_last_fit_confusion", V.sql(_TESTED_SQL, select="""SELECT model, truth, COUNT(*) AS n
  FROM tested, (VALUES ('lasso'), ('forest'), ('kernel')) m(model) GROUP BY ALL"""))
def m12_confusion(spark, sf_dir):
    """Test rows of each class in the confusion matrices of three last fits at the scoring parameters; for boosting see `ml3_*`."""
    table = split(spark, sf_dir)
    params = {"lasso": {"penalty": 0.02}, "forest": ML.SCORING_PARAMS["forest"], "kernel": ML.SCORING_PARAMS["kernel"]}
    found = [T.last_fit(k, table, FEATURES, LABEL, KEY, **p)[2].withColumn("model", F.lit(k)) for k, p in params.items()]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("model", F.col("truth").cast("int").alias("truth"), (F.col("pred_1") + F.col("pred_0")).alias("n"))


@query("ml2_random_forest", _TESTED)
def ml2(spark, sf_dir):
    return _predicted("forest", spark, sf_dir)


@query("ml3_boosted_trees", _TESTED)
def ml3(spark, sf_dir):
    """All 1500 rounds of the boosted ensemble."""
    return _predicted("boosting", spark, sf_dir)


@query("ml3_early_stopping", _TESTED)
def ml3_stopped(spark, sf_dir):
    """Boosting up to 10 000 rounds that ends once ten rounds have not lowered the loss on a tenth of the training rows."""
    train = R.stratified_folds(_train(spark, sf_dir), LABEL, KEY).withColumn(LABEL, F.col(LABEL).cast("int"))
    test = split(spark, sf_dir).filter(~F.col("is_train"))
    with ML.balanced_rows(train.filter("fold <> 0"), LABEL, KEY) as rows:
        model, _, _ = fit_boosting_stopped(rows, cut_lineage(train.filter("fold = 0")), FEATURES, LABEL, learn_rate=0.1, patience=10)
    return _checked(ML.predict(model, test), 0.5)


@query("ml4_kernel_svm", _TESTED)
def ml4(spark, sf_dir):
    return _predicted("kernel", spark, sf_dir)


@query("ml5_permutation_importance")
def ml5(spark, sf_dir):
    test = split(spark, sf_dir).filter(~F.col("is_train")).drop("is_train")
    model = _fitted("forest", spark, sf_dir, **ML.SCORING_PARAMS["forest"])
    ranked = T.permutation_importance(model, test, feature_names(test), LABEL, KEY)
    return ranked.orderBy(F.col("importance").desc(), "feature").limit(10)


TREES = ML.SCORING_PARAMS["forest"]["trees"]
_BALANCED_SQL = _CHANGED_SQL + f""",
train AS (SELECT FY_symbol, CAST(label AS INT) AS truth, row_number() OVER w AS place FROM labelled
  WINDOW w AS (PARTITION BY label ORDER BY md5(concat(FY_symbol, '#1')), FY_symbol)
  QUALIFY row_number() OVER w <= floor(COUNT(*) OVER (PARTITION BY label) * 0.7::DOUBLE)),
balanced AS (SELECT FY_symbol, truth FROM train WHERE place <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM train GROUP BY truth))),
unseen AS (SELECT FY_symbol, truth, COUNT(*) AS trees FROM balanced, range({TREES}) t(tree)
  WHERE ('0x' || substr(md5(concat(FY_symbol, '#1#', tree)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < exp(-1) GROUP BY FY_symbol, truth)"""


def _bagged(spark, sf_dir):
    """Balanced training rows, stored, and the trees of a bagged forest at the scoring parameters, once per session and input."""
    key = (spark.sparkContext.applicationId, "bagged", sf_dir)
    if key not in _MODELS:
        train = _train(spark, sf_dir)
        rows = cut_lineage(R.downsample(train.select(KEY, LABEL, *FEATURES), LABEL, KEY))
        few = rows.coalesce(max(1, -(-rows.count() // ML.ROWS_PER_FIT_TASK)))
        _MODELS[key] = few, fit_bagged_trees(few, FEATURES, LABEL, KEY, **ML.SCORING_PARAMS["forest"])
    return _MODELS[key]


@query("ml2_out_of_bag", V.sql(_BALANCED_SQL, select=f"SELECT {KEY}, truth, trees, true AS valid FROM unseen"))
def ml2_out_of_bag(spark, sf_dir):
    """Training rows with the number of trees that have not seen them, which vote on them; `valid` says that the vote is there."""
    rows, models = _bagged(spark, sf_dir)
    scored = out_of_bag_scores(models, rows, FEATURES, LABEL, KEY)
    return scored.select(KEY, "truth", "trees", F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)).alias("valid"))


@query("ml5_out_of_bag_importance", "SELECT feature, true AS valid FROM (VALUES %s) t(feature)" % ", ".join(f"('{f}')" for f in FEATURES))
def ml5_out_of_bag(spark, sf_dir):
    """Every feature; `valid` says that its importance is a difference of accuracies."""
    rows, models = _bagged(spark, sf_dir)
    found = out_of_bag_importance(models, rows, FEATURES, LABEL, KEY)
    return found.select("feature", F.coalesce(F.col("importance").between(-1.0, 1.0), F.lit(False)).alias("valid"))


@query("ml6_predict_text", V.sql(_TESTED_SQL, select="SELECT symbol, fy, true AS known FROM tested"))
def ml6(spark, sf_dir):
    test = split(spark, sf_dir).filter(~F.col("is_train"))
    model = _fitted("lasso", spark, sf_dir, penalty=0.02)
    texts = ML.predict_text(model, test)
    return texts.select("symbol", "fy", F.col("text").isin(E.MODERATE_TEXT, E.EXTREME_TEXT).alias("known"))


@query("ml7_majority_vote", V.sql(V.SCORES_SQL, select="""SELECT doc_id,
  CASE WHEN (CASE WHEN score < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN score < 1 THEN 1 ELSE 0 END) + (CASE WHEN score < 2 THEN 1 ELSE 0 END) >= 2
       THEN 'Moderately' ELSE 'Extremely' END AS overall FROM scores"""))
def ml7(spark, sf_dir):
    cuts = {"a": 0.5, "b": 1.0, "c": 2.0}
    votes = V.scores(spark, sf_dir).withColumns({n: F.when(F.col("score") < c, 0).otherwise(1) for n, c in cuts.items()})
    return ML.vote(votes, list(cuts)).select("doc_id", "overall")


@query("snk2_save_and_load", V.sql(_TESTED_SQL, FOLD_RATES_SQL.strip().removeprefix("WITH "), select="""SELECT 'model' AS saved, COUNT(*) AS n, 0 AS differing FROM tested
  UNION ALL SELECT 'tuning', COUNT(*), 0 FROM summary"""))
def snk2(spark, sf_dir):
    """Rows of a reloaded model's predictions and of a reloaded tuning table that differ from what was saved."""
    test, folder = split(spark, sf_dir).filter(~F.col("is_train")), scratch_path(spark, "saved")
    model = _fitted("lasso", spark, sf_dir, penalty=0.02)
    save_model(model, f"{folder}/model")
    keys = ["symbol", "fy", "pred", "score"]
    made, loaded = (ML.predict(m, test).select(*keys) for m in (model, load_model(f"{folder}/model")))
    summary = cut_lineage(M.summarise_folds(cut_rates(spark, sf_dir), ["pred_cut"]))
    save_tuning(summary, f"{folder}/tuning")
    tuning = load_tuning(spark, f"{folder}/tuning")

    def compared(name, saved, found):
        differing = saved.exceptAll(found).unionByName(found.exceptAll(saved)).agg(F.count(F.lit(1)))
        return found.agg(F.lit(name).alias("saved"), F.count(F.lit(1)).alias("n")).withColumn("differing", differing.scalar().cast("int"))

    return compared("model", made, loaded).unionByName(compared("tuning", summary, tuning))


# ---------------------------------------------------------------- scoring


# The window reads the annual facts twice: for the requests, and to choose from.
annual = stage("annual", lambda spark, sf_dir: annual_facts(V.facts(spark, sf_dir)).select("symbol", "fy", "tag", "val", "end", "pos"))


def requests(spark, sf_dir, facts=None):
    """Score every firm's last two years; `facts` are keep-last facts, by default the stored ones."""
    kept = (last_facts(spark, sf_dir) if facts is None else facts).select("symbol", "fy").distinct()
    last = kept.groupBy("symbol").agg(F.max("fy").alias("_last"))
    return kept.join(last, "symbol").filter(F.col("fy") >= F.col("_last") - 1).drop("_last")


REQUESTS_SQL = KEPT_SQL + """,
requests AS (SELECT symbol, fy FROM (SELECT DISTINCT symbol, fy FROM kept) QUALIFY fy >= max(fy) OVER (PARTITION BY symbol) - 1),
years AS (SELECT symbol, fy FROM requests UNION SELECT symbol, fy - 1 FROM requests)"""


@query("s1_two_year_window", V.sql(
    REQUESTS_SQL, select="SELECT symbol, fy, tag, val FROM annual SEMI JOIN years USING (symbol, fy)"))
def s1(spark, sf_dir):
    facts = annual(spark, sf_dir)
    return two_year_window(facts, requests(spark, sf_dir, keep_last(facts))).select("symbol", "fy", "tag", "val")


def _history_and_new(spark, sf_dir):
    panel = complete(spark, sf_dir).select("symbol", "fy", KEY, *V.PANEL_COLUMNS)
    history = panel.filter(F.col("fy") <= 1999)
    return history, panel.filter(F.col("fy") >= 1999).withColumn("Assets", F.col("Assets") + 1)


_COMBINED_SQL = COMPLETE_SQL + """,
combined AS (
  SELECT symbol, fy, FY_symbol, %s FROM complete WHERE fy <= 1999
  UNION ALL SELECT symbol, fy, FY_symbol, %s FROM complete WHERE fy > 1999)""" % (
    ", ".join(V.PANEL_COLUMNS), ", ".join("Assets + 1 AS Assets" if c == "Assets" else c for c in V.PANEL_COLUMNS))


@query("s2_append_to_history", V.sql(_COMBINED_SQL, select='SELECT symbol, fy, FY_symbol AS "FY_symbol", Assets, Equity, Revenues FROM combined'))
def s2(spark, sf_dir):
    return append_to_history(*_history_and_new(spark, sf_dir)).select("symbol", "fy", KEY, "Assets", "Equity", "Revenues")


_CLIPPED = ", ".join(
    f"greatest(quantile_cont({c}, 0.0001) OVER (), least(quantile_cont({c}, 0.9999) OVER (), {c})) AS {c}"
    for c in V.PANEL_COLUMNS
)
_SCALED = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) + 0.0 AS {c}" for c in V.PANEL_COLUMNS
)


@query("s3_normalise_with_history", V.sql(
    _COMBINED_SQL, f"clipped AS (SELECT symbol, fy, {_CLIPPED} FROM combined)",
    select=f"SELECT * FROM (SELECT symbol, fy, {_SCALED} FROM clipped) WHERE fy >= 1999"))
def s3(spark, sf_dir):
    columns = list(V.PANEL_COLUMNS)
    rows = normalise_with_history(*_history_and_new(spark, sf_dir), columns)
    return rows.select("symbol", "fy", *[(F.round(c, 5) + 0.0).alias(c) for c in columns])


_LIMITS = ", ".join(f"quantile_cont({f}, 0.0001) AS lo_{f}, quantile_cont({f}, 0.9999) AS hi_{f}" for f in FEATURES)
_FITTED_SQL = ACCRUALS_SQL + f""",
limits AS MATERIALIZED (SELECT {_LIMITS} FROM lagged WHERE rn > 1),
clipped AS MATERIALIZED (SELECT symbol, fy, {", ".join(f"greatest(lo_{f}, least(hi_{f}, {f})) AS {f}" for f in FEATURES)} FROM lagged, limits WHERE rn > 1),
moments AS MATERIALIZED (SELECT {", ".join(f"avg({f}) AS m_{f}, nullif(stddev_samp({f}), 0) AS s_{f}" for f in FEATURES)} FROM clipped)"""


@query("s3_normalise_by_state", V.sql(_FITTED_SQL, select=f"""SELECT symbol, fy, {", ".join(f"round(coalesce(({f} - m_{f}) / s_{f}, 0), 5) + 0.0 AS {f}" for f in FEATURES)}
  FROM clipped, moments WHERE fy > 1999"""))
def s3_state(spark, sf_dir):
    """All 36 features of the new firm-years, normalised by state of three batches: the history's rows are read once, when they come."""
    rows, path = accruals(spark, sf_dir), scratch_path(spark, "value-state")
    for batch, years in enumerate(("fy <= 1996", "fy BETWEEN 1997 AND 1999", "fy > 1999")):
        store_batch(rows.filter(years), path, batch, FEATURES)
    scaled = apply_normalisation(rows.filter("fy > 1999"), FEATURES, stored_normalisation(spark, path, FEATURES))
    return scaled.select("symbol", "fy", *[(F.round(f, 5) + 0.0).alias(f) for f in FEATURES])


ranks = stage("ranks", lambda spark, sf_dir: rank_candidates(last_facts(spark, sf_dir)))
history = stage("history", lambda spark, sf_dir: labelled_features(
    facts_to_panel(annual_facts(V.facts(spark, sf_dir)), years=V.YEARS, ranks=ranks(spark, sf_dir))
))
fitted = stage("fitted", lambda spark, sf_dir: fit_normalisation(history(spark, sf_dir), FEATURES))
_MODELS: dict[tuple, object] = {}


def saved_models(spark, sf_dir):
    """The three models, trained on normalised history once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        past = history(spark, sf_dir)
        table = apply_normalisation(past, FEATURES, fitted(spark, sf_dir))
        labelled = table.select("symbol", "fy", KEY, LABEL, *FEATURES)
        _MODELS[key] = scoring_models(cut_lineage(labelled))
    return _MODELS[key]


_VOTES = ["pred_forest", "pred_boosting", "pred_kernel"]


def _voted(scored, *more):
    """Scored firm-years; `voted` says that all three models and their majority are there."""
    extreme = sum((F.col(c) for c in _VOTES), F.lit(0)) >= 2
    agrees = F.col("overall") == F.when(extreme, "Extremely").otherwise("Moderately")
    return scored.select("symbol", "fy", KEY, F.coalesce(agrees, F.lit(False)).alias("voted"), *more)


# Requests are scored if their year and the year before are whole.
_SCORED_SQL = """SELECT w.symbol, w.fy, w.FY_symbol, true AS voted FROM whole w
  JOIN whole p ON p.symbol = w.symbol AND p.fy = w.fy - 1"""


@query("s4_score_batch", V.sql(whole_panel_sql(), "asked AS (SELECT symbol, max(fy) AS newest FROM kept GROUP BY symbol)",
    select=_SCORED_SQL + " JOIN asked a ON a.symbol = w.symbol AND w.fy >= a.newest - 1"))
def s4(spark, sf_dir):
    """Votes on every firm's last two years by the whole models of `SCORING_PARAMS`."""
    return _voted(score_batch(
        annual_facts(V.facts(spark, sf_dir)), requests(spark, sf_dir), ranks(spark, sf_dir),
        history(spark, sf_dir), models=saved_models(spark, sf_dir), fitted=fitted(spark, sf_dir),
    ))


@query("s5_report", V.sql(V.SCORES_SQL, V.DIRECTORY_SQL, f"""scored AS (
  SELECT concat('C', CAST(doc_id AS VARCHAR)) AS symbol, 2000 + fold AS fy, CASE WHEN score < 1 THEN 'Moderately' ELSE 'Extremely' END AS overall,
    CASE WHEN score < 1 THEN 'did not engage' ELSE 'engaged' END AS engaged, pred FROM scores)""", select=f"""SELECT symbol, fy,
  CASE WHEN pred = 0 THEN '{E.MODERATE_TEXT}' ELSE '{E.EXTREME_TEXT}' END AS text_forest, overall,
  CASE WHEN title IS NULL THEN printf('{E.ANONYMOUS_SENTENCE}', overall, engaged) ELSE printf('{E.NAMED_SENTENCE}', title, fy, engaged) END AS sentence
  FROM scored LEFT JOIN dir1 ON symbol = ticker"""))
def s5(spark, sf_dir):
    scored = V.scores(spark, sf_dir).select(
        F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("symbol"), (F.col("fold") + 2000).alias("fy"),
        F.when(F.col("score") < 1, "Moderately").otherwise("Extremely").alias("overall"), F.col("pred").alias("pred_forest"),
    )
    _, sentences = report(scored, V.directory(spark, sf_dir, 1), [])
    return sentences


@query("s5_report_table", V.sql(V.PANEL_SQL, select=" UNION ALL ".join(f"""SELECT symbol, fy, '{name}' AS "Name", {value} AS "Value" FROM panel"""
  for name, value in [("Ticker", "symbol"), ("Year", "CAST(fy AS VARCHAR)"), *((c, f"CASE WHEN {c} IS NOT NULL THEN printf('%.2f', CAST({c} AS DOUBLE)) END") for c in V.PANEL_COLUMNS)])))
def s5_table(spark, sf_dir):
    """The Name/Value half of the report, for every column of a firm-year."""
    scored = V.panel(spark, sf_dir).withColumn("overall", F.lit("Moderately"))
    table, _ = report(scored, V.directory(spark, sf_dir, 1), list(V.PANEL_COLUMNS))
    return table


@query("s6_score_stream", V.sql(whole_panel_sql(), select=_SCORED_SQL.replace("AS voted", "AS voted, true AS as_batch")))
def s6(spark, sf_dir):
    """Documents scored as they arrive, every firm-year; `as_batch`: the same features and votes as `score_batch` on all documents."""
    folder = scratch_path(spark, "stream")
    texts = documents(spark, sf_dir)
    texts.write.json(f"{folder}/landing")
    known, models, past = ranks(spark, sf_dir), saved_models(spark, sf_dir), history(spark, sf_dir)
    stored = fitted(spark, sf_dir)

    def score(facts, touched):
        return score_batch(facts, touched, known, past, models=models, fitted=stored)

    start_scoring(
        spark, f"{folder}/landing", f"{folder}/facts", f"{folder}/sink", f"{folder}/state", score
    ).awaitTermination()
    facts = annual_facts(explode_facts(parse_documents(read_company_facts(spark, f"{folder}/landing"))))
    columns = ["symbol", "fy", *FEATURES, *_VOTES]
    batch = score(facts, facts.select("symbol", "fy").distinct()).select(*columns, F.lit(True).alias("_same"))
    scored = latest_scores(spark, f"{folder}/sink")
    rounded = lambda df: df.withColumns({f: F.round(f, 9) for f in FEATURES})
    met = rounded(scored).join(rounded(batch), columns, "left")
    return _voted(met, F.coalesce("_same", F.lit(False)).alias("as_batch"))
