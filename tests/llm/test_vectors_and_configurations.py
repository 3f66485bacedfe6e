"""Configuration packing (11), whitening (12) and hard negatives (13) against plain versions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import config_packing as C
from ledgerlens.llm import negatives as N
from ledgerlens.llm import whitening as W
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score double, x string"


# ---------------------------------------------------------------- configuration packing


def _check_groups(counts, groups, capacity):
    held = Counter()
    for copies, parts in groups:
        assert copies > 0 and sum(n * k for n, k in parts) <= capacity
        for n, k in parts:
            held[n] += copies * k
    assert +held == +Counter(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_rounded_program_holds_every_piece_once(counts):
    solution = C.configuration_program(counts, 40)
    groups = C.rounded(counts, solution, 40)
    _check_groups(counts, groups, 40)
    volume = sum(n * k for n, k in counts.items())
    used = sum(k for k, _ in groups)
    # Any best-fit packing has at most one sequence that is half empty.
    assert -(-volume // 40) <= used <= max(2 * volume // 40 + 1, 0)
    places = C.Places(groups, 40)
    seen = defaultdict(set)
    for n, k in counts.items():
        sequence, offset = places.of(np.full(k, n), np.arange(k))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            assert not seen[s] & set(range(o, o + n)) and o + n <= 40
            seen[s] |= set(range(o, o + n))
    assert all(x == set(range(len(x))) for x in seen.values()) and len(seen) == used == places.sequences


def test_knapsack_equals_every_multiset():
    weights = np.zeros(13)
    weights[[3, 4, 7, 12]] = 0.3, 0.45, 0.7, 1.0
    best = max(
        0.3 * a + 0.45 * b + 0.7 * c + 1.0 * d
        for a in range(5) for b in range(4) for c in range(2) for d in range(2) if 3 * a + 4 * b + 7 * c + 12 * d <= 12
    )
    found = C.best_configuration(weights, 12)
    assert math.isclose(sum(weights[n] * k for n, k in found.items()), best) and sum(n * k for n, k in found.items()) <= 12


def test_program_finds_perfect_pairs():
    counts = {n: 50 for n in (10, 30, 15, 25, 20)}
    assert sum(k for k, _ in C.rounded(counts, C.configuration_program(counts, 40), 40)) == 125


def test_configuration_packing_holds_every_id_once(spark, small):
    pieces = QUERIES["op11_config_packing"](spark, SF).collect()
    encode = brute.encoder(public_path("word_bpe_49k.json"))
    documents, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents[p.doc_id].append(p)
        held[p.sequence_id].append(p)
    total = 0
    for i, text in small:
        ids = [*encode(text), 1]
        total += len(ids)
        parts = sorted(documents[i], key=lambda p: p.piece)
        assert [(p.piece, p.start, p.length) for p in parts] == [(k // 4096, k, min(4096, len(ids) - k)) for k in range(0, len(ids), 4096)]
        assert [p.ids_crc32 for p in parts] == [brute.crc(ids[p.start:p.start + p.length]) for p in parts]
    for q in held.values():
        at = 0
        for p in sorted(q, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert len(held) <= -(-total // 4096) + 1


def test_configuration_packing_edges(spark, edges, empty):
    path = public_path("word_bpe_49k.json")
    pieces = C.pack_best_fit(edges, path, capacity=64).cache()
    encode = brute.encoder(path)
    sizes = [len(encode(t)) + 1 for _, t in edge_rows()]
    assert sorted(r.length for r in pieces.collect()) == sorted(min(64, n - k) for n in sizes for k in range(0, n, 64))
    packed = C.sequences(pieces).collect()
    assert all(r.length <= 64 and len(r.ids) == 4 * r.length for r in packed) and sum(r.length for r in packed) == sum(sizes)
    assert C.pack_best_fit(empty, path).count() == 0


# ---------------------------------------------------------------- whitening


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=3, max_size=3), max_size=150))
def test_bit_planes_give_cross_products(rows):
    x = np.array(rows, np.int64).reshape(-1, 3)
    assert (W.cross_products(x) == x.T.astype(object) @ x.astype(object)).all()


def _usable(rows):
    return [(i, v, y) for i, v, y, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def test_whitening_equals_plain_statistics(spark):
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = {r.vec_id: int(d) for r, d in zip(rows, ((n * x - sums) ** 2).sum(axis=1), strict=True)}
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    assert len(got) == n * 32 and all(r.n == n and r.deviation == deviation[r.vec_id] for r in got)
    white = np.zeros((n, 32))
    place = {r.vec_id: k for k, r in enumerate(rows)}
    for r in got:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(covariance), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9
    directions = np.linalg.lstsq(white, centred, rcond=None)[0]  # rows: root of the eigenvalue times a unit vector
    assert np.allclose(covariance @ directions.T, directions.T * values[:32], atol=1e-6)


EDGE_VECTORS = [
    (1, [1.0, 2.0], 1, 0.0, ""), (2, None, 1, 0.0, ""), (3, [1.0, None], 2, 0.0, ""), (4, [float("nan"), 1.0], 2, 0.0, ""),
    (5, [], 1, 0.0, ""), (6, [3.0], 1, 0.0, ""), (7, [-1.5, 0.25], 1, 0.0, ""), (7, [-1.5, 0.25], 1, 0.0, ""), (None, [0.0, 0.5], 3, 0.0, ""),
    (100, [2.0, -4.0], None, 0.0, ""), (200, [1.0, 1.0], 1, 0.0, ""), (200, [1.0, 1.0], 1, 0.0, ""), (300, [0.0, 0.0], 4, 0.0, ""),
    (8, [float("inf"), 0.0], 1, 0.0, ""), (9, [0.5, 0.25], 2, 0.0, ""), (10, [0.25, 0.5], 2, 0.0, ""),
]


def test_whitening_edges(spark):
    df = spark.createDataFrame(EDGE_VECTORS, VECTORS)
    usable = [v for _, v, _ in _usable(EDGE_VECTORS) if len(v) == 2]
    fit = W.fit_whitening(df)
    x = np.floor(64 * np.array(usable)).astype(int) + 1_000_000
    assert fit.n == len(usable) and list(fit.sums) == x.sum(axis=0).tolist()
    got = W.whiten(df, fit).collect()
    assert Counter(r.vec_id for r in got) == Counter({i: 2 * k for i, k in Counter(i for i, v, _ in _usable(EDGE_VECTORS) if len(v) == 2).items()})
    assert W.identity_error(df, fit) < 1e-12
    same = spark.createDataFrame([(i, [0.5, 0.5], 0, 0.0, "") for i in range(4)], VECTORS)
    fit = W.fit_whitening(same)
    rows = W.whiten(same, fit).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in rows)
    assert W.identity_error(same, fit) is None
    none = spark.createDataFrame([], VECTORS)
    assert W.whiten(none, W.fit_whitening(none)).count() == 0 and W.identity_error(none, W.fit_whitening(none)) is None


def test_one_dimension_of_many_bits_is_exact(spark):
    rows = [(i, [float(10_000_000 * (i == 3)), i / 7], 0, 0.0, "") for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double, x string")
    x = np.floor(64 * np.array([v for _, v, *_ in rows])).astype(int).astype(object)
    sums = x.sum(axis=0)
    want = len(x) * (x.T @ x) - np.outer(sums, sums)
    assert [list(r) for r in W.fit_whitening(df).scatter] == want.tolist()
    with pytest.raises(Exception, match="beyond"):
        W.fit_whitening(spark.createDataFrame([(1, [1e30], 0, 0.0, "")], VECTORS))


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    rows = [(i, [math.floor(scale * c) for c in v], y) for i, v, y in rows if i is not None and y is not None]
    out = []
    for a, (anchor, u, label) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(u, v, strict=True)), i, y) for k, (i, v, y) in enumerate(rows) if k != a)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s][:negatives]
            out += [(anchor, i, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_equal_plain_search(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_hard_negatives"](spark, SF)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    several = N.mine(df, every=20, positives=3, negatives=4, low_percent=-50, high_percent=80, block_bytes=4096)
    assert sorted(map(tuple, several.collect())) == plain_negatives(rows, 20, 3, 4, -50, 80)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(5)
    for size in (1, 3, 64, 100):
        x = np.concatenate((rng.integers(-200, 200, (60, size)), np.zeros((2, size), np.int64), np.full((1, size), 10**6), np.eye(size, dtype=np.int64)[:1]))
        codes, alignment, norms = N.encode(x)
        low, high = N.intervals(x, codes, alignment, norms)
        scores = x @ x.T
        assert (low <= scores).all() and (scores <= high).all()


def test_hard_negative_edges(spark):
    df = spark.createDataFrame(EDGE_VECTORS, VECTORS)
    usable = [r for r in _usable(EDGE_VECTORS) if len(r[1]) == 2]
    assert sorted(map(tuple, N.mine(df).collect())) == plain_negatives(usable)
    ties = [(i, [1.0, float(i % 3)], i % 2) for i in range(90)] + [(100, [1.0, 1.0], 0), (100, [1.0, 1.0], 0)]
    twins = spark.createDataFrame(ties, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, N.mine(twins, low_percent=0, high_percent=100).collect())) == plain_negatives(ties, low=0, high=100)
    assert N.mine(spark.createDataFrame([], VECTORS)).count() == 0
