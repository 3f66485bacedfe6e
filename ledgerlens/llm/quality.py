"""Quality classifier: a sparse ensemble of rules over text statistics (operator 7)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import stored, text_or_empty

_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SENTENCE, _SYMBOLS = b".,;:'\"?-()", b"!#$%&*+/<=>@[\\]^_`{|}~"
STATISTICS = (
    "words", "word_length", "long_words", "short_words", "upper", "digits", "sentence_marks", "symbols", "pipes", "shouts",
    "upper_words", "symbol_words", "distinct_words", "top_word", "distinct_pairs", "lines", "line_words", "distinct_lines",
    "ended_lines", "ascii",
)


def statistics(text: str) -> tuple[float, ...]:
    """The values of STATISTICS for one whole text: shares of its bytes, words or lines, and plain counts."""
    data, words, lines = text.encode(), text.split(), [x for x in text.splitlines() if x.strip()]
    size, n, m = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    top = max(Counter(words).values(), default=0)
    return (
        float(len(words)), sum(map(len, words)) / n, sum(len(w) > 14 for w in words) / n, sum(len(w) < 4 for w in words) / n,
        share(_UPPER), share(_DIGITS), share(_SENTENCE), share(_SYMBOLS), data.count(b"|") / size, data.count(b"!") / size,
        sum(w.isupper() for w in words) / n, sum(not (w[-1].isalnum() or w[-1] in ".,;:?'\")") for w in words) / n,
        len(set(words)) / n, top / n, len(set(zip(words, words[1:], strict=False))) / n, float(len(lines)), len(words) / m,
        len(set(lines)) / m, sum(x.rstrip()[-1] in ".?!" for x in lines) / m, text.isascii() * 1.0,
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)


Rule = tuple[tuple[str, float, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules are conjunctions of `low < statistic <= high`; the score is the logistic of the weights of those that hold."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, values: str = "statistics") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule, values), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, values: str) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        value = F.col(f"{values}.{name}")
        if low != float("-inf"):
            out = out & (value > low)
        if high != float("inf"):
            out = out & (value <= high)
    return out


def tree_rules(model) -> list[Rule]:
    """Every path from a root to a node of the forest, as one interval per statistic; equal rules once."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[tuple(sorted((k, *v) for k, v in bounds.items()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            name, cut = STATISTICS[node.split().featureIndex()], node.split().threshold()
            low, high = bounds.get(name, (float("-inf"), float("inf")))
            walk(node.leftChild(), bounds | {name: (low, min(high, cut))})
            walk(node.rightChild(), bounds | {name: (max(low, cut), high)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = 30_000, trees: int = 20, depth: int = 3, penalty: float = 0.002,
) -> RuleEnsemble:
    """Learn from labelled rows that are not held out.

    About `max_rows` labelled doc_ids at most are learnt from, chosen by a hash of doc_id: the bound of the fit, and of
    the broadcast that picks their texts. A forest is grown on the statistics, its paths become rules, and an L1-penalised
    logistic regression gives most rules no weight. Null labels and null ids are left out; a doc_id with contradicting
    labels counts with each; with labels of one kind or none the score is a smoothed share of good labels.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"),
    ).distinct()
    total = known.count()
    share = min(1.0, max_rows / max(total, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = stored(texts.join(F.broadcast(chosen), "doc_id").select("label", _statistics("text").alias("statistics")), "quality-rows")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        good, every = seen.get(1.0, 0), sum(seen.values())
        share_good = (good + 1) / (every + 2)
        return RuleEnsemble((), (), log(share_good / (1 - share_good)))
    wide = rows.select("label", "statistics.*").coalesce(8)
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(wide).select("label", "features").cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=7).fit(vectors)
    vectors.unpersist()
    rules = tree_rules(forest)
    if not rules:
        share_good = (seen[1.0] + 1) / (sum(seen.values()) + 2)
        return RuleEnsemble((), (), log(share_good / (1 - share_good)))
    fired = rows.coalesce(8).select("label", array_to_vector(F.array(*(holds(r, "statistics").cast("double") for r in rules))).alias("features")).cache()
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(fired)
    fired.unpersist()
    weights = lasso.coefficients.toArray()
    used = [k for k in range(len(rules)) if weights[k] != 0.0]
    return RuleEnsemble(tuple(rules[k] for k in used), tuple(float(weights[k]) for k in used), float(lasso.intercept))


def with_score(docs: DataFrame, model: RuleEnsemble, name: str = "score") -> DataFrame:
    """All rows and columns of `docs` and the score of their whole text, 0 to 1; null text is scored as empty."""
    marked = docs.withColumn("__statistics", _statistics(text_or_empty()))
    return marked.withColumn(name, model.column("__statistics")).drop("__statistics")
