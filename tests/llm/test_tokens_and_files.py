"""Token ids, packing (1) and binary files (10): exact round trips."""

from __future__ import annotations

import os
from collections import defaultdict

import brute
import numpy as np
import pytest
from brute import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import binary_output, packing
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.tokens import Codec, public_path
from ledgerlens.session import scratch_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ALPHABET = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "　", ".", "1", "!", "'s", "'", "́", "\xa0", "Σ", "日", "😀", "\r", "<|endoftext|>", "_", "İ", "ª", "—", "foo", "$$$", "<", "̸"]
CODECS = {name: (Codec(public_path(name), max_known=50), brute.encoder(public_path(name))) for name in FILES}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), max_size=4))
def test_codec_equals_whole_text_encoding(name, texts):
    codec, whole = CODECS[name]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_many(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_marks_and_line_ends_make_no_new_words(name):
    text = "alpha beta alpha. beta, alpha\nbeta (alpha)\nbeta alpha.\nBéta\nβeta"
    codec = Codec(public_path(name))
    assert np.frombuffer(codec.encode_many([text])[0], "<u4").tolist() == CODECS[name][1](text)
    words = {x.strip("\n") for x in codec.known}
    assert {x for x in words if "alpha" in x} <= {"alpha", "(alpha"} and {x for x in words if "beta" in x} <= {"beta"}


def _check_pieces(rows, pieces, encode, capacity, end_id):
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, text in rows:
        ids, at = [*encode(text), end_id], 0
        for p in sorted(documents[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == brute.crc(ids[at:at + p.length])
            at += p.length
        assert at == len(ids)
    for q in sequences.values():
        at = 0
        for p in sorted(q, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    return sequences


def test_packing_holds_every_id_once(spark, small):
    pieces = QUERIES["op1_packing"](spark, "/root/testdata/sf0.001").collect()
    sequences = _check_pieces(small, pieces, CODECS["word_bpe_49k.json"][1], 4096, 2)
    tokens = sum(p.length for p in pieces)
    assert len(sequences) == -(-tokens // 4096)


def test_assignment_prefers_cheap_sequences():
    placed = packing.assign([90, 60, 50, 40, 30, 20, 10], 100, 1.0, 0.01)
    assert placed[0] == (0, 0, 90, 0, 0) and placed[1][:4] == (1, 0, 60, 1) and placed[2][3] == 2
    assert sorted(s for *_, s, _ in placed) == [0, 0, 1, 1, 2, 2, 2] or len(placed) >= 7
    assert packing.assign([], 100, 1.0, 1.0) == []
    cut = packing.assign([250], 100, 1.0, 1.0)
    assert sorted((s, n) for _, s, n, _, _ in cut) == [(0, 100), (100, 100), (200, 50)]


def test_packing_edges(edges, empty):
    path = public_path("word_bpe_49k.json")
    rows = packing.pack(edges, path, capacity=512, block_bytes=100_000).collect()
    encode = CODECS["word_bpe_49k.json"][1]
    assert sum(r.length for r in rows) == sum(len(encode(t)) + 1 for _, t in edge_rows())
    assert packing.pack(empty, path).count() == 0


def test_files_give_the_ids_back(spark, small):
    found = {r.doc_id: r for r in QUERIES["op10_binary_output"](spark, "/root/testdata/sf0.001").collect()}
    start, encode = 0, CODECS["byte_bpe_50k.json"][1]
    for i, text in sorted(small):
        ids = [*encode(text), 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_file_edges_and_random_access(spark, edges, empty):
    folder, path = scratch_path(spark, "test-sequences"), public_path("byte_bpe_50k.json")
    manifest = binary_output.write_sequences(edges, folder, path, length=64)
    encode = CODECS["byte_bpe_50k.json"][1]
    back = binary_output.read_documents(spark, folder, manifest).orderBy("start").collect()
    assert sorted(len(encode(t)) + 1 for _, t in edge_rows()) == sorted(r.n_tokens for r in back)
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    stream = b"".join(r.ids for r in back)
    got = b""
    for _, name, _, n_tokens, n_sequences in manifest:
        file = binary_output.SequenceFile(folder, name)
        assert sum(b.num_rows for b in file.batches) == n_sequences == -(-n_tokens // 64)
        parts = [file[k] for k in range(n_sequences)]
        assert all(not x.flags.owndata and len(x) == len(m) == 64 for x, m in parts)
        got += b"".join(x[m.to_numpy(zero_copy_only=False)].astype("<u4").tobytes() for x, m in parts)
    assert got == stream
    assert not [f for f in os.listdir(folder) if f.startswith(".part") and not f.endswith(".crc")]
    nothing = binary_output.write_sequences(empty, scratch_path(spark, "test-none"), path)
    assert nothing == [] and binary_output.read_documents(spark, folder, nothing).count() == 0
