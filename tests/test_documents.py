"""Documents are built by one shuffle of the facts."""

from __future__ import annotations

import re

from ledgerlens.catalog import views as V


def test_facts_are_shuffled_once(spark):
    plan = V.documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    by_document = [e for e in exchanges if "symbol" in e]
    assert len(by_document) == 1 and "tag" not in by_document[0]


def test_landed_texts_are_compressed(spark, monkeypatch):
    """`src3_read_company_facts` writes every fact as text: as it is, that is several times its input."""
    import glob

    from ledgerlens.catalog import relational
    from ledgerlens.session import scratch_path

    folders = []
    monkeypatch.setattr(relational, "scratch_path", lambda *args: folders.append(scratch_path(*args)) or folders[-1])
    assert relational.src3(spark, "/root/testdata/sf0.001").count() > 0
    names = glob.glob(f"{folders[0].removeprefix('file:')}/part-*")
    assert names and all(n.endswith(".json.snappy") for n in names)
