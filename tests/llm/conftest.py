from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import edge_rows  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like those that the operators make for themselves.
CLASHING = ("row_id", "kept", "digest", "leaks", "score", "hash", "place", "key", "words", "carry_text", "target", "block", "bits", "norm", "node")


@pytest.fixture(scope="session")
def small(spark):
    """(doc_id, text) rows of the smallest table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def edges(frame):
    from pyspark.sql import functions as F

    return frame(edge_rows()).withColumns({name: F.lit("clash") for name in CLASHING})


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
