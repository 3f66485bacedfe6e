from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.canonical import rank_candidates
from ledgerlens.operators.dedup import annual_facts, keep_last
from ledgerlens.operators.features import FEATURES
from ledgerlens.operators.stats import apply_normalisation, fit_normalisation
from ledgerlens.plans import scoring
from ledgerlens.plans.feature_table import LABEL, feature_table, labelled_features
from ledgerlens.plans.panel import facts_to_panel
from ledgerlens.plans.scoring import (
    append_to_history, complete_requests, normalise_with_history, report, request_features, score_batch,
)
from ledgerlens.plans.training import scoring_models
from ledgerlens.rules import PANEL_ITEMS
from ledgerlens.sources.company_facts import explode_facts, parse_documents
from ledgerlens.sources.readers import DOCUMENT
from ledgerlens.streaming.score_stream import latest_scores, start_scoring

YEARS = range(2017, 2021)
SMALL = {"forest": {"mtry": 3, "trees": 5}, "boosting": {"trees": 3, "depth": 2, "learn_rate": 0.1}, "kernel": {"cost": 10.0, "sigma": 0.01, "dims": 32}}


def document(symbol, part, years, skip=(), end_month=12):
    generator = random.Random(f"{symbol}{part}")
    concepts = {
        item: {"label": item, "units": {"USD": [
            {"end": f"{y}-{end_month:02d}-30", "val": generator.randint(1, 10**6), "accn": "a", "fy": y, "fp": "FY", "form": "10-K", "filed": f"{y + 1}-02-01"}
            for y in years if (item, y) not in skip
        ]}}
        for item in PANEL_ITEMS
    }
    return symbol, part, json.dumps({"facts": {"us-gaap": concepts}})


@pytest.fixture(scope="module")
def world(spark):
    """Forty firms with a past, their models, and new documents to score."""
    past = spark.createDataFrame([document(f"H{i}", 0, YEARS) for i in range(40)], DOCUMENT)
    facts = annual_facts(explode_facts(parse_documents(past)))
    ranks = rank_candidates(keep_last(facts)).cache()
    history = labelled_features(facts_to_panel(facts, ranks=ranks)).cache()
    fitted = fit_normalisation(history, FEATURES)
    table = apply_normalisation(history, FEATURES, fitted)
    models = scoring_models(table.select("symbol", "fy", "FY_symbol", *FEATURES, LABEL).cache(), SMALL)
    return ranks, history, models, fitted


NEW = [
    document("A", 0, [2019, 2020]),
    document("B", 0, [2020]),
    document("C", 0, [2019, 2020], skip={("Cash", 2019)}),
    document("A", 1, [2020], end_month=12),
    document("H1", 1, [2021]),
]


def test_batch(spark, world):
    ranks, history, models, fitted = world
    facts = annual_facts(explode_facts(parse_documents(spark.createDataFrame(NEW[:3], DOCUMENT))))
    requests = spark.createDataFrame([("A", 2020), ("A", 2019), ("B", 2020), ("C", 2020), ("ZZ", 2020)], "symbol string, fy int")
    panel_rows = request_features(facts, requests, ranks)
    assert {(r.symbol, r.fy) for r in panel_rows.collect()} == {("A", 2020)}
    scored = score_batch(facts, requests, ranks, history, models=models).cache()
    row = scored.collect()
    assert [(r.symbol, r.fy) for r in row] == [("A", 2020)]
    votes = [row[0][f"pred_{k}"] for k in SMALL]
    assert row[0].overall == ("Moderately" if votes.count(0) >= 2 else "Extremely")
    directory = spark.createDataFrame([("A", "Acme")], "ticker string, title string")
    table, sentences = report(scored, directory)
    assert {r.Name for r in table.collect()} == {"Ticker", "Year", *FEATURES}
    assert "Acme in the year 2020" in sentences.first().sentence


def test_refit(spark, world, monkeypatch):
    """Without saved models the training rows of the requested firm-years are left out of the fit."""
    ranks, history, models, fitted = world
    past = annual_facts(explode_facts(parse_documents(spark.createDataFrame([document("H1", 0, YEARS)], DOCUMENT))))
    requests = spark.createDataFrame([("H1", 2019)], "symbol string, fy int")
    table = apply_normalisation(history, FEATURES, fitted).select("symbol", "fy", "FY_symbol", *FEATURES, LABEL)
    seen = []
    monkeypatch.setattr(scoring, "scoring_models", lambda rows: seen.append(rows) or models)
    assert score_batch(past, requests, ranks, history, training=table).count() == 1
    assert seen[0].count() == table.count() - 1 and seen[0].filter("FY_symbol = '2019 H1'").count() == 0


def test_history_wins(spark):
    history = spark.createDataFrame([("2020 A", 1.0, 9)], "FY_symbol string, x double, extra int")
    new = spark.createDataFrame([("2020 A", 5.0), ("2021 A", 3.0)], "FY_symbol string, x double")
    rows = {tuple(r) for r in append_to_history(history, new).collect()}
    assert rows == {("2020 A", 1.0), ("2021 A", 3.0)}


def test_new_rows_that_repeat_a_key_count_once(spark):
    history = spark.createDataFrame([("a", 1.0)], "FY_symbol string, x double")
    new = spark.createDataFrame([("b", 2.0), ("b", 3.0), ("a", 9.0)], "FY_symbol string, x double")
    assert {tuple(r) for r in append_to_history(history, new).collect()} == {("a", 1.0), ("b", 2.0)}


def test_frozen_statistics_do_not_depend_on_the_batch(spark):
    history = spark.createDataFrame([(f"h{i}", float(i)) for i in range(20)], "FY_symbol string, x double")
    one = spark.createDataFrame([("n1", 3.0)], "FY_symbol string, x double")
    two = spark.createDataFrame([("n1", 3.0), ("n2", 500.0)], "FY_symbol string, x double")

    stored = fit_normalisation(history, ["x"])

    def value(new, frozen):
        fitted = stored if frozen else None
        return normalise_with_history(history, new, ["x"], fitted=fitted).filter("FY_symbol = 'n1'").first().x

    assert value(one, True) == value(two, True)
    assert value(one, False) != value(two, False)


def test_incomplete_requests_are_flagged(spark):
    columns = [*PANEL_ITEMS, "debt", "EBITDA"]
    rows = [("A", 2019, *[1.0] * 16), ("A", 2020, *[1.0] * 16), ("B", 2020, *[1.0] * 16), ("C", 2019, *[1.0] * 16), ("C", 2020, None, *[1.0] * 15)]
    panel = spark.createDataFrame(rows, ", ".join(["symbol string", "fy int", *[f"{c} double" for c in columns]]))
    requests = panel.select("symbol", F.lit(2020).alias("fy")).distinct()
    assert {r.symbol: r.valid for r in complete_requests(panel, requests).collect()} == {"A": True, "B": False, "C": False}


def test_feature_table_shape(world, spark):
    _, history, _, _ = world
    rows = spark.createDataFrame([document(f"F{i}", 0, YEARS) for i in range(15)], DOCUMENT)
    table = feature_table(facts_to_panel(annual_facts(explode_facts(parse_documents(rows)))), winsor="mad")
    assert len(table.columns) == 40 and table.count() == 45
    assert {r[0] for r in history.select(LABEL).distinct().collect()} == {0, 1}


def two_namespaces(symbol, part, years):
    """A document whose every tag is reported by two namespaces for one period end, and by two units."""
    _, _, text = document(symbol, part, years)
    concepts = json.loads(text)["facts"]["us-gaap"]
    other = {
        tag: {"label": tag, "units": {"USD": [x | {"val": x["val"] * 3 + 1} for x in concept["units"]["USD"]][::-1], "EUR": [x | {"val": 7} for x in concept["units"]["USD"]]}}
        for tag, concept in concepts.items()
    }
    late = {"Cash": {"label": "", "units": {"USD": [{"end": f"{years[0]}-12-31", "val": 5, "accn": "a", "fy": years[0], "form": "10-K"}, *concepts["Cash"]["units"]["USD"]]}}}
    return symbol, part, json.dumps({"facts": {"dei": other, "us-gaap": concepts | late}})


def land(folder, documents):
    folder.mkdir(exist_ok=True)
    for symbol, part, text in documents:
        path = folder / f"{len(list(folder.iterdir()))}.json"
        path.write_text(json.dumps({"symbol": symbol, "part": part, "text": text}))
        at = 1_600_000_000 + len(list(folder.iterdir()))  # files are taken in by their time
        os.utime(path, (at, at))


def test_stream_equals_batch(spark, world, tmp_path):
    """One file per micro-batch: new years, an incomplete firm, a restatement, two namespaces and a broken document."""
    ranks, history, models, fitted = world

    def score(facts, requests):
        return score_batch(facts, requests, ranks, history, models=models, fitted=fitted)

    documents = [*NEW[:4], two_namespaces("N", 0, [2019, 2020]), document("N", 1, [2018, 2021])]
    land(tmp_path / "landing", [*documents, ("X", 0, NEW[0][2][:50])])
    paths = [str(tmp_path / n) for n in ("landing", "scratch", "sink", "state")]
    start_scoring(spark, *paths, score, files_per_batch=1).awaitTermination()
    facts = annual_facts(explode_facts(parse_documents(spark.createDataFrame(documents, DOCUMENT))))
    expected = score(facts, facts.select("symbol", "fy").distinct())
    keep = ["symbol", "fy", *FEATURES[:12], "pred_forest", "pred_boosting", "pred_kernel", "overall"]
    got = {tuple(r) for r in latest_scores(spark, paths[2]).select(*keep).collect()}
    assert got == {tuple(r) for r in expected.select(*keep).collect()}
    assert {(r[0], r[1]) for r in got} == {("A", 2020), ("N", 2019), ("N", 2020), ("N", 2021)}
    assert not [f for f in os.listdir(paths[1]) if f.startswith("batch")]


def test_stream_passes_over_what_is_filed_again(spark, tmp_path):
    """A document filed again, alone, in a later batch or inside a larger one, touches only what is new."""
    seen = []

    def score(facts, requests):
        seen.append((facts.count(), sorted(tuple(r) for r in requests.collect())))
        return requests

    first, later = document("A", 0, [2019, 2020]), document("B", 0, [2020])
    larger = json.loads(first[2])
    larger["facts"]["us-gaap"]["Cash"]["units"]["USD"].append(
        {"end": "2021-12-30", "val": 1, "accn": "b", "fy": 2021, "fp": "FY", "form": "10-K"},
    )
    restated = first[2].replace('"accn": "a"', '"accn": "c"')
    land(tmp_path / "landing", [first, first, later, ("A", 0, json.dumps(larger)), ("A", 5, restated)])
    paths = [str(tmp_path / n) for n in ("landing", "scratch", "sink", "state")]
    query = start_scoring(spark, *paths, score, files_per_batch=1)
    query.awaitTermination()
    items = len(PANEL_ITEMS)
    busy = [x for x in seen if x[1]]
    assert busy == [
        (4 * items, [("A", 2019), ("A", 2020), ("A", 2021)]),
        (2 * items, [("B", 2020), ("B", 2021)]),
        (items + 2, [("A", 2021), ("A", 2022)]),
    ]
    # A later start goes on with the state it finds.
    land(tmp_path / "landing", [first, document("A", 9, [2022])])
    seen.clear()
    start_scoring(spark, *paths, score, files_per_batch=1).awaitTermination()
    assert [x for x in seen if x[1]] == [(2 * items + 1, [("A", 2022), ("A", 2023)])]


def test_scores_come_from_all_rounds(spark):
    """`s4_score_batch` and `s6_score_stream` vote with the models of `SCORING_PARAMS`, not with their first rounds."""
    from ledgerlens.catalog.evaluation import saved_models
    from ledgerlens.operators.models import SCORING_PARAMS

    models = saved_models(spark, "/root/testdata/sf0.001")
    assert {k: len(models[k].stages[-1].trees) for k in ("forest", "boosting")} == {k: SCORING_PARAMS[k]["trees"] for k in ("forest", "boosting")}
