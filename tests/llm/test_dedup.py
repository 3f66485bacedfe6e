"""Exact, substring, near and line deduplication (4, 5, 8, 6) and components, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import brute
import pytest
from brute import edge_rows
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, line_dedup, lm_scoring, minhash, substring_dedup
from ledgerlens.llm.components import connected, link_within
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_exact_query(spark, small):
    got = {tuple(r) for r in QUERIES["op4_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute.exact(small)


@pytest.mark.parametrize("hot_share", [0.0, 0.3, 1.0])
def test_exact_groups_survive_digest_collisions(frame, hot_share):
    rows = [(i, ["a  b", "a b", "c", "", "d"][i % 5] if i % 3 else "hot\ttext") for i in range(200)]
    weak = lambda c: (F.length(c) % 2).cast("string")
    for digest in (exact_dedup.sha256, weak):
        got = exact_dedup.exact_groups(frame(rows), digest=digest, hot_share=hot_share, salts=4).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {x[:4] for x in brute.exact(rows)}


def test_exact_edges(edges, empty):
    rows = exact_dedup.exact_groups(edges, carry=("text", "row_id")).collect()
    assert len(rows) == len(edge_rows())
    again = [r for r in rows if r.text == edge_rows()[4][1]]
    assert len(again) == 4 and sum(r.kept for r in again) == 1 and {(r.keep_id, r.group_size) for r in again} == {(5, 4)}
    blank = [r for r in rows if not r.text]
    assert {r.keep_id for r in blank} == {1} and sum(r.kept for r in blank) == 1
    assert {r.row_id for r in rows} == {"clash"}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_cover_is_a_difference_cover():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substring_query(spark, small):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, SF).collect()}
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute.repeats(small, 35).items()}


def test_substring_overlaps_and_alignments(frame):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, short = [word() for _ in range(60)], [word() for _ in range(24)]
    rows = []
    for i in range(40):
        head, tail = [word() for _ in range(rng.randrange(30))], [word() for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(head + (passage[i % 7:] if i % 2 else short) + tail)))
    rows += [(100, "a b " * 60), (101, " ".join(passage)), (102, " ".join(passage)), (103, " ".join(passage[:34]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame(rows), window=25).collect()}
    assert got == brute.repeats(rows, 25)


def test_substring_edges(edges, empty):
    rows = substring_dedup.remove_repeats(edges).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].n_removed == by_id[7].n_words == 30_000 and by_id[8].kept == "tail" and by_id[1].n_words == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(empty, window=21)


def test_near_query(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_minhash_near_dedup"](spark, SF).collect()}
    assert got == brute.near(small)


def test_near_groups_around_the_threshold(frame):
    rng, rows = random.Random(5), []
    for base in range(6):
        text = [f"t{base}x{k}" for k in range(rng.choice([3, 5, 9, 60, 120]))]
        for copy in range(12):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                changed[rng.randrange(len(changed))] = f"n{rng.randrange(10**6)}"
            rows.append((base * 100 + copy, " ".join(changed).upper() if copy % 2 else "\n".join(changed)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(frame(rows)).collect()}
    assert got == brute.near(rows)


def test_near_edges(edges, empty):
    rows = minhash.near_groups(edges, carry=("text", "key")).collect()
    assert len(rows) == len(edge_rows())
    again = [r for r in rows if r.text == edge_rows()[4][1]]
    assert {r.component_id for r in again} == {5} and sum(r.kept for r in again) == 1
    blank = [r for r in rows if not (r.text or "").strip()]
    assert all(r.kept and r.component_id == r.doc_id and r.n_shingles == 0 for r in blank)
    assert {r.key for r in rows} == {"clash"} and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert minhash.near_groups(empty).count() == 0


def test_connected_components_of_any_shape(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(1, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(7, 7)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    expected = brute.components(linked, [x for x in links if x[0] != x[1]])
    assert set(found) == linked
    assert {frozenset(n for n in found if found[n] == c) for c in found.values()} == {frozenset(n for n in linked if expected[n] == c) for c in expected.values()}


def test_links_within_lists_equal_all_pairs(spark):
    rng = random.Random(2)
    postings = sorted({(rng.randrange(6), rng.randrange(60)) for _ in range(150)})
    alike = lambda a, b: (a * b) % 7 in (1, 2) or abs(a - b) == 1
    test = lambda pairs: pairs.where("(a * b) % 7 IN (1, 2) OR b - a = 1")
    nodes = {n for _, n in postings}
    links = [(a, b) for k, a in postings for j, b in postings if k == j and a < b and alike(a, b)]
    for rounds in (0, 1, 3):
        labels = {r.node: r.component for r in link_within(spark.createDataFrame(postings, "key long, node long"), test, rounds).collect()}
        expected, found = brute.components(nodes, links), {n: labels.get(n, n) for n in nodes}
        assert {frozenset(n for n in nodes if found[n] == c) for c in found.values()} == {frozenset(n for n in nodes if expected[n] == c) for c in expected.values()}


def _plain_lines(rows):
    norm = lambda s: re.sub(r"\d+", "0", re.sub(r"[\W_]+", " ", s.lower()).strip())
    return [(i, k, norm(s)) for i, t in rows for k, s in enumerate(re.split("\r\n|[\n\r]", t or ""))]


def test_lines_against_all_pairs(spark, frame):
    rng = random.Random(4)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99999)}q" for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(30):
        picked = [base[rng.randrange(5)] for _ in range(4)]
        picked = [x.replace("q", "Q", 1) if rng.random() < .3 else x + rng.choice(["", "!", " zz"]) for x in picked]
        rows.append((i, "\n".join(picked)))
    docs, plain = frame(rows), _plain_lines(rows)
    distinct = sorted({n for *_, n in plain})
    sims = {r.norm: (r.sim_a, r.sim_b) for r in line_dedup.simhashes(spark.createDataFrame([(k, -k, n) for k, n in enumerate(distinct)], "h1 long, h2 long, norm string")).collect()}
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sims[a], sims[b], strict=True))
    links = [
        (a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:]
        if bits(a, b) <= line_dedup.DISTANCE and brute.levenshtein(a, b) <= int(max(len(a), len(b)) * 0.15 + 1e-9)
    ]
    assert links
    group = brute.components(distinct, links)
    first = {}
    for i, k, n in plain:
        first.setdefault(group[n], (i, k))
    sizes = {g: sum(group[n] == g for *_, n in plain) for g in set(group.values())}
    expected = {(i, k, sizes[group[n]], *first[group[n]], first[group[n]] == (i, k)) for i, k, n in plain}
    got = line_dedup.fuzzy_lines(docs).select("doc_id", "line_no", "group_size", "keep_doc_id", "keep_line_no", "kept").collect()
    assert {tuple(r) for r in got} == expected


def test_lines_of_any_edits_against_brute_edit_similarity(frame):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("aeioubdknrst\U00010400") for _ in range(rng.randrange(2, 9)))
    lines = []
    for n in (1, 2, 3, 5, 8, 15, 15, 30):
        base = [word() for _ in range(n)]
        one = list(base)
        one[n // 2] = word()
        lines += [" ".join(base), " ".join(one), " ".join([*base, word()])]
        for share in (.05, .1, .14, .15, .16):
            text = list(" ".join(base))
            for at in rng.sample(range(len(text)), int(len(text) * share)):
                text[at] = rng.choice(["", "z", text[at] + "z"])
            lines.append("".join(text))
    rows = list(enumerate(lines))
    norms = {n for *_, n in _plain_lines(rows)}
    links = [(a, b) for a in norms for b in norms if a < b and brute.levenshtein(a, b) <= int(max(len(a), len(b)) * 0.15 + 1e-9)]
    group = brute.components(norms, links)
    first = {}
    for i, _, n in _plain_lines(rows):
        first.setdefault(group[n], i)
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.fuzzy_lines(frame(rows)).collect()}
    assert len(links) > 20 and got == {i: first[group[n]] for i, _, n in _plain_lines(rows)}


def test_segments_list_every_link_and_few_unlike_lines_in_any_number_of_rounds(spark, monkeypatch):
    """Lines of a few syllables share segments by chance, and a pair that does was listed before; some lines repeat one word."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["th", "an", "ed", "in", "re", "on", "st", "\U00010400e"]) for _ in range(rng.randrange(1, 5)))
    norms = set()
    for size in [3, 8, 12, 20, 30, 40, 60, 80, 120] * 12:
        base = " ".join(word() for _ in range(size // 5 + 1))
        norms.add(base)
        for share in (.08, .15):
            text = list(base)
            for at in rng.sample(range(len(text)), int(len(text) * share)):
                text[at] = rng.choice(["", "z", text[at] + "z"])
            norms.add(" ".join("".join(text).split()))
        norms.add(base[int(len(base) * .15):].strip())
    norms |= {"an ed " * n + tail for n in (40, 42, 300, 310) for tail in ("x", "in st")}
    norms = sorted(norms - {""})
    lines = spark.createDataFrame([(i, n, i) for i, n in enumerate(norms)], "node long, norm string, component long")
    both = lines.selectExpr("node as a", "norm as x").join(lines.selectExpr("node as b", "norm as y"), F.expr(
        "a < b AND levenshtein(x, y) <= cast(floor(greatest(length(x), length(y)) * 0.15D + 1e-9D) as int)"))
    links = {(r.a, r.b) for r in both.select("a", "b").collect()}
    for least in (1_000_000, 2_000):
        monkeypatch.setattr(line_dedup, "_ROUND", least)
        got = {(r.a, r.b) for r in line_dedup.segment_pairs(lines, 0.85).collect()}
        assert len(links) > 100 and links <= got
        assert len(got - links) < len(links)


def test_rounds_hold_each_pair_of_classes_once(monkeypatch):
    monkeypatch.setattr(line_dedup, "_ROUND", 100)
    chars = {1: 5, 4: 90, 5: 20, 6: 1000, 7: 130, 9: 3, 10: 90}
    rounds = line_dedup._rounds(chars, 0.85)
    for c in chars:
        for place in range(12):
            assert sum(first <= c <= last and here <= place <= there for first, last, here, there in rounds) == 1
    assert len(rounds) > len(chars)


def test_edits_without_common_ends(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(9)))
    rows = [(word(), word(), rng.randrange(9)) for _ in range(300)] + [("", "", 0), ("ab", "ab", 0), ("aba", "ababa", 2), ("x" * 70_000 + "y", "x" * 70_000, 9_000)]
    df = spark.createDataFrame(rows, "p string, q string, most int").withColumns({
        "got": F.expr(line_dedup._edits("p", "q", "most")), "plain": F.expr("levenshtein(p, q)"),
    })
    for r in df.where("length(p) < 100").collect():
        assert r.got == (r.plain if r.plain <= r.most else -1)
    assert df.where("length(p) > 100").select("got").first()["got"] == 1


def test_line_query_equals_normalised_lines_where_nothing_is_fuzzy(spark, small):
    got = QUERIES["op6_line_dedup"](spark, SF).collect()
    plain = {(i, k): n for i, k, n in _plain_lines(small)}
    assert {(r.doc_id, r.line_no) for r in got} == set(plain)
    for r in got:
        if plain[r.doc_id, r.line_no] == plain[r.keep_doc_id, r.keep_line_no]:
            assert (r.keep_doc_id, r.keep_line_no) <= (r.doc_id, r.line_no)
    assert len({n for n in plain.values() if n}) >= sum(r.kept for r in got) - sum(not n for n in plain.values())


def test_line_edges(edges, empty):
    rows = line_dedup.fuzzy_lines(edges).collect()
    assert len(rows) == sum(len((t or "").split("\n")) for _, t in edge_rows())
    again = [r for r in rows if r.line == edge_rows()[4][1]]
    assert sum(r.kept for r in again) == 1 and {(r.keep_doc_id, r.group_size) for r in again} == {(5, len(again))}
    assert all(r.kept for r in rows if not r.line.strip())
    assert line_dedup.fuzzy_lines(empty).count() == 0


def test_words_whose_polynomials_agree_modulo_a_power_of_two_stay_apart(spark, frame):
    """A Thue-Morse word and its complement have one hash modulo 2^64 from 1024 letters on, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    p, q = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    tail = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{p} {tail}"), (2, f"{q} {tail}"), (3, f"a {p} x r s b {q} x r s"), (4, p * 3), (5, q * 3)]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(rows)).collect()}
    assert all(r.n_removed == 0 for r in got.values())
    twins = [(1, " ".join([p, *tail.split()])), (2, " ".join([q, *tail.split()]))]
    assert {r.doc_id: r.n_shingles for r in minhash.near_groups(frame(rows)).collect()} == {i: n for i, (n, *_) in brute.near(rows).items()}
    scores = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame(twins), frame(twins[:1])).collect()}
    want = brute.language_models(twins, {1}, 0.0, 0.0, 0.6, 0.5)
    for i, (n, target, background) in want.items():
        assert scores[i].n_tokens == n and abs(scores[i].target_loss - target) < 1e-9 and abs(scores[i].background_loss - background) < 1e-9
