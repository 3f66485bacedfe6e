"""Decontamination (2), sharding (3), quality (7), language models (9) and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import brute
import corpus_pipeline
import pytest
from brute import edge_rows
from compare import compare, oracle_connection
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, lm_scoring, quality, sharding
from ledgerlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    assert compare(QUERIES[key](spark, SF), oracle_connection(SF), ORACLES[key]) is None


def test_tiles_equal_the_plain_tiling():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(2, 22))]
        doc = [rng.choice("abcdef") for _ in range(10)] + item[8:] + ["x"] + item[:8] + [rng.choice("abcdef") for _ in range(10)]
        tiles = decontamination.tile(doc, item, 3)
        assert sum(n for *_, n in tiles) == brute.tiling(doc, item, 3)
        assert all(item[i:i + n] == doc[j:j + n] for i, j, n in tiles)
        assert len({i + k for i, _, n in tiles for k in range(n)}) == len({j + k for _, j, n in tiles for k in range(n)}) == sum(n for *_, n in tiles)


def test_reordered_passages_are_found_in_both_ways(spark, frame):
    rng = random.Random(8)
    item = [f"word{rng.randrange(999)}" for _ in range(40)]
    other = [f"other{k}" for k in range(30)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    rows = [
        (1, " ".join(filler(20) + item[20:] + filler(5) + item[:20] + filler(9))), (2, " ".join(item[:30])), (3, " ".join(item).upper().replace(" ", ", ")),
        (4, " ".join(filler(50))), (5, " ".join(item[:34])), (6, None), (7, " ".join(other[:28] + item)),
    ]
    benchmark = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, "too short"), (14, "")], "item_id long, text string")
    expected = {(i, b) for i, t in rows for b, x in ((10, item), (11, other)) if brute.tiling(decontamination.tokens(t or ""), x, 5) >= 0.8 * len(x)}
    assert (1, 10) in expected and (2, 10) not in expected
    for limit in (10**6, 0):
        got = decontamination.with_leaks(frame(rows), benchmark, broadcast_words=limit)
        assert got.columns == [*frame(rows).columns, "leaks"]
        assert {(r.doc_id, r.leak.item_id) for r in got.select("doc_id", F.explode("leaks").alias("leak")).collect()} == expected
        assert got.count() == len(rows)


def test_leak_query_and_edges(spark, small, edges, empty):
    items = {r["item_id"]: decontamination.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_decontamination"](spark, SF).collect()}
    texts = {i: decontamination.tokens(t or "") for i, t in small}
    whole = {(i, b) for i, t in texts.items() for b, x in items.items() if f" {' '.join(x)} " in f" {' '.join(t)} "}
    assert whole <= got and all(sum(n for *_, n in decontamination.tile(texts[i], items[b], 5)) >= 0.8 * len(items[b]) for i, b in got)
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six")], "item_id long, text string")
    for limit in (10**6, 0):
        rows = decontamination.with_leaks(edges, benchmark, broadcast_words=limit).collect()
        assert len(rows) == len(edge_rows()) and sum(len(r.leaks) == 2 for r in rows) == 5 and {r.digest for r in rows} == {"clash"}
        assert decontamination.with_leaks(empty, benchmark, broadcast_words=limit).count() == 0
        nothing = decontamination.with_leaks(edges, benchmark.limit(0), broadcast_words=limit - 1 if limit == 0 else limit)
        assert nothing.where(F.size("leaks") > 0).count() == 0


def test_shards_fit_and_split_only_where_needed(frame, small):
    limit = 40_000
    rows = sharding.assign_shards(frame(small), limit=limit).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in small)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for shard, held in by_shard.items():
        assert sum(r.bytes for r in held) == held[0].shard_bytes and len(held) == held[0].shard_docs and len(shard) == held[0].depth
        assert held[0].shard_bytes <= limit or len(held) == 1
        if shard:
            assert sum(r.bytes for r in rows if r.shard.startswith(shard[:-1])) > limit
        assert not [s for s in by_shard if s != shard and s.startswith(shard)]


def test_shards_of_repeated_ids_and_edges(frame, edges, empty):
    rows = sharding.assign_shards(frame([(5, "x" * 100)] * 50 + [(6, "y" * 5000), (7, None)]), limit=1000).collect()
    assert len(rows) == 52 and all(r.shard_bytes <= 1000 for r in rows if r.doc_id == 5) and max(r.depth for r in rows if r.doc_id == 5) > 31
    assert [r.shard_docs for r in rows if r.doc_id == 6] == [1]
    assert sharding.assign_shards(edges, limit=1000).count() == len(edge_rows())
    assert sharding.assign_shards(empty).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality_classifier"](spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in unseen) / len(unseen) > 0.95


def test_quality_never_reads_held_out_labels(spark, frame, small):
    texts = frame(small)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in small], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(texts, labels) == quality.fit(texts, flipped)


def test_quality_edges(spark, edges, empty, frame, small):
    labels = spark.createDataFrame([(i, 1) for i, _ in small], "doc_id long, quality int")
    one_kind = quality.fit(frame(small), labels)
    assert not one_kind.rules and one_kind.intercept > 0
    none = quality.fit(empty, labels.limit(0))
    rows = quality.with_score(edges.drop("score"), none).collect()
    assert len(rows) == len(edge_rows()) and {r.score for r in rows} == {0.5}
    mixed = quality.fit(frame(small), spark.createDataFrame([(i, i % 2) for i, _ in small], "doc_id long, quality int"), depth=2)
    rows = quality.with_score(edges, mixed, "quality_score").collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.with_score(empty, mixed).count() == 0


def test_language_models_equal_plain_counts(spark, frame, small):
    rows = small[:40]
    docs, target = frame(rows), {i for i, _ in rows if i % 3 == 0}
    shares = {"word_share": 5e-4, "pair_share": 3e-4, "weight": 0.6, "add": 0.5}
    got = lm_scoring.cross_entropy_difference(docs, docs.where("doc_id % 3 = 0"), **shares).collect()
    expected = brute.language_models(rows, target, **shares)
    for r in got:
        n, own, background = expected[r.doc_id]
        assert r.n_tokens == n and r.target_loss == pytest.approx(own) and r.background_loss == pytest.approx(background)
        assert r.score == pytest.approx(own - background)


def test_language_models_keep_every_word_and_pair(spark, frame):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(2000))) for k in range(60)] + [(99, "once only words here " + "the " * 50)]
    docs = frame(rows)
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, docs.where("doc_id < 20")).collect()}
    classes = 120_000 + 5 + 1
    plain = lambda n, after: 0.6 / after + 0.4 * 1.5 / (n + 0.5 * classes)
    for name, n, texts in (("background_loss", 120_054, 61), ("target_loss", 40_000, 20)):
        bits = -math.log2(plain(n, texts)) - 1999 * math.log2(plain(n, 1))
        assert getattr(got[3], name) == pytest.approx(bits / 2000)


@pytest.mark.parametrize("block_bytes,bucket_keys", [(8 << 20, 1 << 20), (3000, 500)])
def test_language_model_query_equals_plain_counts(spark, monkeypatch, block_bytes, bucket_keys):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", bucket_keys)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    expected = brute.cross_entropies([tuple(r) for r in docs], good)
    got = QUERIES["op9_lm_scoring"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(expected[r.doc_id])


def test_language_model_query_prefers_good_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.score for r in QUERIES["op9_lm_scoring"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    mean = lambda q: sum(rows[r["doc_id"]] for r in labels if r["quality"] == q) / sum(r["quality"] == q for r in labels)
    assert len(rows) == 1000 and mean(1) < mean(0)


def test_language_model_edges(edges, empty):
    rows = lm_scoring.cross_entropy_difference(edges, edges.where("doc_id < 6")).collect()
    assert len(rows) == len(edge_rows()) and {r.score is None for r in rows if r.n_tokens == 0} == {True}
    assert all(r.score is not None for r in rows if r.n_tokens)
    assert all(r.score is not None for r in lm_scoring.cross_entropy_difference(edges, empty).where("n_tokens > 0").collect())
    assert lm_scoring.cross_entropy_difference(empty, edges).count() == 0


def test_pipeline_equals_plain_stages(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    good = {r.doc_id for r in quality.with_score(docs, model).where("score >= 0.5").collect()}
    rows = [(i, t) for i, t in small if i in good]
    kept = {x[0] for x in brute.exact(rows) if x[3]}
    rows = [(i, t) for i, t in rows if i in kept]
    kept = {i for i, (_, _, stays) in brute.near(rows, percent=80).items() if stays}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [decontamination.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda t: any(sum(n for *_, n in decontamination.tile(decontamination.tokens(t or ""), x, 5)) >= 0.8 * len(x) for x in items)
    rows = [(i, t) for i, t in rows if not leaks(t)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for found in pieces.values():
        assert sum(n for _, n, _ in found) == found[0][2] and sorted(s for s, *_ in found)[0] == 0


def test_near_copy_stage_takes_pairs_from_eighty_percent_on(spark, frame):
    rng, rows = random.Random(10), []
    for base in range(5):
        text = [f"t{base}x{k}" for k in range(120)]
        rows.append((base * 10, " ".join(text)))
        for copy, edits in enumerate((1, 2, 2, 3, 3)):
            changed = list(text)
            for at in rng.sample(range(len(text)), edits):
                changed[at] = f"n{rng.randrange(10**6)}"
            rows.append((base * 10 + copy + 1, " ".join(changed)))
    kept = [{i for i, (_, _, stays) in brute.near(rows, percent=p).items() if stays} for p in (80, 85)]
    got = corpus_pipeline.one_of_near_copies(spark, frame(rows), SF).collect()
    assert {r.doc_id for r in got} == kept[0] != kept[1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, edges, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs, most in ((edges, len(edge_rows())), (empty, 0)):
        found = stage(spark, docs, SF)
        if name != "packing":
            assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert found.count() <= most
        else:
            assert (found.count() > 0) == (most > 0)
