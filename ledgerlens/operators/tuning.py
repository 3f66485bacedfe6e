"""Grid tuning with several metrics per fit, model selection, last fit and permutation importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.operators.forest import StoredForest
from ledgerlens.operators.metrics import confusion_matrix, fold_metrics, roc_auc, summarise_folds
from ledgerlens.operators.models import FITTERS, fit_balanced, fit_rows, predict
from ledgerlens.operators.ordering import hash_row_number
from ledgerlens.operators.penalty_path import PenaltyPath, path_scores, penalty_path
from ledgerlens.operators.resample import downsample_folds
from ledgerlens.operators.staged import staged_scores
from ledgerlens.session import cut_lineage, parts_dropped, scratch_path

#: Trees of one block of a tuned forest.
FOREST_BLOCK = 50
#: Scores of penalties, rows times configurations, that are stored at once.
SCORES_AT_ONCE = 25_000_000


def _prefix_groups(kind: str, grid: list[dict]) -> list[list[dict]]:
    """Configurations that one fit can serve: boosting with the same parameters but for the number of trees."""
    if kind != "boosting":
        return [[point] for point in grid]
    groups: dict[tuple, list[dict]] = {}
    for point in grid:
        rest = tuple(sorted((k, v) for k, v in point.items() if k not in ("trees", "config")))
        groups.setdefault(rest, []).append(point)
    return list(groups.values())


def prefix_scores(model: PipelineModel, df: DataFrame, sizes: list[int]) -> DataFrame:
    """Scores of the boosted ensembles that consist of the first k trees, `score_<k>`, from one fitted model, as columns.

    The plan has a column for each tree; `staged_scores` has no such bound.
    """
    ensemble = model.stages[-1]
    scored = model.stages[0].transform(df)
    terms: list[Column] = []
    for t, (tree, weight) in enumerate(zip(ensemble.trees, ensemble.treeWeights)):
        tree.setFeaturesCol("_features").setPredictionCol(f"_t{t}")
        terms.append(F.col(f"_t{t}") * weight)
        scored = tree.transform(scored)

    def total(k: int) -> Column:
        summed = F.aggregate(F.array(*terms[:k]), F.lit(0.0), lambda acc, x: acc + x)
        return 1.0 / (1.0 + F.exp(-2.0 * summed))

    return scored.select(*df.columns, *[total(k).alias(f"score_{k}") for k in sizes])


def _configs(points: list[dict], trees: Column) -> Column:
    """The configuration among `points` that has so many trees."""
    pairs = [x for p in points for x in (F.lit(p["trees"]), F.lit(p["config"]))]
    return F.create_map(*pairs)[trees]


def forest_block_scores(
    folder: str, f: int, analysis: DataFrame, assessed: DataFrame, features: list[str], label: str, key: str, grid: list[dict], seed: int,
) -> list:
    """Jobs that each fit one block of `FOREST_BLOCK` trees and write its scores of the assessment rows.

    A tuned forest of k trees is defined as the first k / `FOREST_BLOCK` blocks, block b drawn with its own seed, and its
    score is their mean. So all sizes of one `mtry` take as many trees as the largest, and none depends on the grid.
    """
    jobs = []
    for point in {p["mtry"]: p for p in sorted(grid, key=lambda p: p["trees"])}.values():
        rest = {k: v for k, v in point.items() if k not in ("config", "trees")}
        for block in range(point["trees"] // FOREST_BLOCK):

            def run(rest=rest, block=block) -> None:
                model = FITTERS["forest"](analysis, features, label, trees=FOREST_BLOCK, seed=seed * 1000 + block, **rest)
                scored = predict(model, assessed).select(F.col(key).alias("key"), F.col(label).alias("truth"), "score")
                scored.write.parquet(f"{folder}/fold={f}/mtry={rest['mtry']}/block={block}")
                model.stages[-1].drop()

            jobs.append(run)
    return jobs


def _forest_sizes(folder: str, rows: DataFrame, grid: list[dict]) -> DataFrame:
    """(config, fold, truth, pred, score) from the blocks' scores: running means over blocks, per row."""
    blocks = rows.sparkSession.read.parquet(folder)
    so_far = Window.partitionBy("fold", "mtry", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    means = blocks.withColumns({"score": F.avg("score").over(so_far), "trees": (F.col("block") + 1) * FOREST_BLOCK})
    points = F.create_map(*[x for p in grid for x in (F.lit(f"{p['mtry']}/{p['trees']}"), F.lit(p["config"]))])
    named = means.withColumn("config", points[F.concat_ws("/", F.col("mtry").cast("string"), F.col("trees").cast("string"))])
    return named.filter("config IS NOT NULL").select("config", F.col("fold").cast("int").alias("fold"), "truth", (F.col("score") > 0.5).cast("int").alias("pred"), "score")


def tune_grid(
    kind: str, df: DataFrame, features: list[str], label: str, key: str, grid: list[dict], fold: str = "fold",
    seed: int = 1, threads: int = 4,
) -> DataFrame:
    """(config, fold, metric, value) of every configuration on every fold.

    A LASSO grid is one penalty path for all folds (`penalty_path`); sizes of a forest are blocks (`forest_block_scores`);
    sizes of a boosted ensemble are prefixes of one fit (`staged_scores`). The analysis rows of all folds are down-sampled by one pass (`downsample_folds`), the assessment rows stay as they are. Each fit writes
    its predictions to its own folder, and one aggregate over all of them yields the metrics: the plan's size
    does not grow with the grid. Threads on the driver only submit jobs.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.select(key, label, fold, *features))
    if kind == "lasso":
        path = penalty_path(rows, features, label, key, [p["penalty"] for p in grid], fold, seed)
        return _path_metrics(path, rows, label, fold, [p["config"] for p in grid])
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    target = scratch_path(spark, f"tune-{kind}")

    def run(f: int, points: list[dict], analysis: DataFrame) -> None:
        assessed = rows.filter(F.col(fold) == f)
        largest = max(points, key=lambda p: p.get("trees", 0))
        model = FITTERS[kind](analysis, features, label, seed=seed, **{k: v for k, v in largest.items() if k != "config"})
        if len(points) == 1:
            scored = predict(model, assessed).select(
                F.lit(points[0]["config"]).alias("config"), F.col(label).alias("truth"), "pred", "score"
            )
        else:
            sized = staged_scores(model, assessed, features, label, [p["trees"] for p in points])
            scored = sized.select(_configs(points, F.col("size")).alias("config"), "truth", (F.col("score") > 0.5).cast("int").alias("pred"), "score")
        scored.write.parquet(f"{target}/fold={f}/first={points[0]['config']}")
        if kind == "forest":
            model.stages[-1].drop()

    in_blocks = kind == "forest" and all(p["trees"] % FOREST_BLOCK == 0 for p in grid)
    marked = downsample_folds(rows, label, key, fold, folds, seed)
    for place, f in enumerate(folds):
        learned = marked.filter(F.array_contains("models", place)).select(*rows.columns)
        with fit_rows(learned) as analysis, ThreadPoolExecutor(threads) as pool:
            if in_blocks:
                assessed = rows.filter(F.col(fold) == f)
                runs = forest_block_scores(target, f, analysis, assessed, features, label, key, grid, seed)
            else:
                runs = [partial(run, f, points, analysis) for points in _prefix_groups(kind, grid)]
            for job in [pool.submit(inheritable_thread_target(spark)(one)) for one in runs]:
                job.result()
    if in_blocks:
        scored = cut_lineage(_forest_sizes(target, rows, grid))
        return fold_metrics(scored, ["config", "fold"], group_bound=len(grid) * len(folds))

    scored = spark.read.parquet(target).select("config", F.col("fold").cast("int").alias("fold"), "truth", "pred", "score")
    return fold_metrics(scored, ["config", "fold"], group_bound=len(grid) * len(folds))


def _path_metrics(path: PenaltyPath, rows: DataFrame, label: str, fold: str, configs: list[int]) -> DataFrame:
    """Metrics of all penalties, of so many at a time that their scores stay under `SCORES_AT_ONCE`; what was stored for some goes before the next."""
    at_once, found = max(1, SCORES_AT_ONCE // max(rows.count(), 1)), None
    for at in range(0, len(configs), at_once):
        with parts_dropped():
            scored = path_scores(path, rows, label, fold, configs, slice(at, at + at_once))
            some = cut_lineage(fold_metrics(scored, ["config", "fold"], group_bound=len(configs) * len(path.folds)).coalesce(1))
        found = some if found is None else found.unionByName(some)
    return found


def tuning_table(metrics: DataFrame, grid: list[dict]) -> DataFrame:
    """Fold summary with the parameters next to each configuration."""
    points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in grid])
    parameters = metrics.sparkSession.range(1).select(F.inline(points))
    return summarise_folds(metrics, ["config"]).join(F.broadcast(parameters), "config")


def last_fit(
    kind: str, df: DataFrame, features: list[str], label: str, key: str, seed: int = 1, **params
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on `is_train` rows and evaluate on the others: (model, metrics, confusion matrix)."""
    model = fit_balanced(kind, df.filter("is_train"), features, label, key, seed, **params)
    tested = predict(model, df.filter(~F.col("is_train"))).withColumnRenamed(label, "truth")
    scored = cut_lineage(tested.select(F.lit(kind).alias("model"), "truth", "pred", "score"))
    return model, fold_metrics(scored, ["model"], group_bound=1), confusion_matrix(scored)


def _swapped_scores(model: PipelineModel, paired: DataFrame, features: list[str]) -> DataFrame:
    """(_j, truth, score) of every row as it is (-1) and with the donor's value of each feature."""
    variants = paired.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = F.transform("_x", lambda x, i: F.when(i == F.col("_j"), F.get("_d", i)).otherwise(x))
    inputs = variants.select("truth", "_j", array_to_vector(swapped).alias("_features"))
    for stage in model.stages[1:]:
        inputs = stage.transform(inputs)
    evidence = "probability" if "probability" in inputs.columns else "rawPrediction"
    return inputs.select("_j", "truth", F.element_at(vector_to_array(evidence), 2).alias("score"))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: list[str], label: str, key: str, seed: int = 1
) -> DataFrame:
    """(feature, importance): loss of AUC when one feature's values are shuffled among the rows.

    Two hash orders of the rows give each row a donor, one even join on the rank. Every row is then scored
    once per feature with the donor's value in that place, and once unchanged; all AUCs are one grouped job.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(F.col(key).alias("_k"), F.col(label).alias("truth"), values.alias("_x"))
    left = hash_row_number(rows, [], "_k", seed, "_place")
    donors = hash_row_number(rows.select("_k", "_x"), [], "_k", seed + 1, "_place").select("_place", F.col("_x").alias("_d"))
    if isinstance(model.stages[-1], StoredForest):
        forest = model.stages[-1]
        both = left.join(donors, "_place").select(F.col("_place").alias("id"), F.col("truth").cast("int").alias("truth"), F.col("_d").alias("d"), F.col("_x").alias("x"))
        # Bins are all that a forest looks at.
        paired = cut_lineage(forest.coded(forest.coded(both).select("id", "truth", F.col("x").alias("own"), F.col("d").alias("x"))).select(
            "id", "truth", F.col("x").alias("d"), F.col("own").alias("x")
        ))
        wide = forest.swapped_scores(paired)
        each = [F.struct(F.lit(j - 1).alias("_j"), F.col(f"v{j}").alias("score")) for j in range(len(features) + 1)]
        scored = wide.select("truth", F.inline(F.array(*each))).select("_j", "truth", "score")
    else:
        scored = _swapped_scores(model, cut_lineage(left.join(donors, "_place")), features)
    areas = roc_auc(cut_lineage(scored), ["_j"], group_bound=len(features) + 1)
    base = areas.filter(F.col("_j") == -1).select("roc_auc").scalar()
    names = F.array(*[F.lit(f) for f in features])
    return areas.withColumn("_base", base).filter(F.col("_j") >= 0).select(
        F.get(names, F.col("_j")).alias("feature"), (F.col("_base") - F.col("roc_auc")).alias("importance")
    )
