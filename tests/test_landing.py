from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.catalog import views as V
from ledgerlens.sources import landing as L
from ledgerlens.sources.company_facts import explode_facts, parse_documents

SF = "/root/testdata/sf0.001"


def texts(spark, rows):
    return spark.createDataFrame(rows, "symbol string, part int, text string")


def fact(end, val, **more):
    return {"end": end, "val": val, "accn": "1", "fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01", **more}


ODD = [
    ("A", 0, json.dumps({"cik": 1, "facts": {
        "dei": {"Z": {"units": {"USD": [fact("2020-12-31", 1), fact("2019-12-31", 2.5, start="2019-01-01", frame="CY2019")]}}},
        "us-gaap": {"Z": {"units": {"shares": [fact("2020-12-31", 7)], "USD": [fact("2020-12-31", 8)]}}, "Y": {"units": {}}},
        "other": {"Z": {"units": {"USD": [fact("2020-12-31", 9)]}}},
    }})),
    ("B", 0, "{broken"), ("C", 0, ""), ("D", 0, None), ("E", 0, "{}"), ("F", 0, '{"facts": null}'),
    ("G", 1, json.dumps({"facts": {"us-gaap": {"Z": {"units": {"USD": [fact("no date", -1)]}}}}})),
    ("G", 1, json.dumps({"facts": {"us-gaap": {"Z": {"units": {"USD": [fact("no date", -1)]}}}}})),
]


@pytest.mark.parametrize("units", ["first", "all"])
def test_landed_facts_equal_parsed_facts(spark, tmp_path, units):
    folder, docs = str(tmp_path / "landed"), texts(spark, ODD)
    L.land_documents(docs, folder, 0)
    expected = explode_facts(parse_documents(docs), units=units)
    found = L.landed_facts(L.read_landed(spark, folder), units=units)
    assert found.schema.simpleString() == expected.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) and found.count() > 4


def test_whole_table_in_two_batches(spark, tmp_path):
    folder, docs = str(tmp_path / "landed"), V.documents(spark, SF, units=("USD", "pure")).cache()
    L.land_documents(docs.filter("part % 2 = 0"), folder, 0)
    L.land_documents(docs.filter("part % 2 = 0"), folder, 1)
    L.land_documents(docs.filter("part % 2 = 1"), folder, 1)  # replaces what batch 1 left
    expected = explode_facts(parse_documents(docs))
    found = L.landed_facts(L.read_landed(spark, folder))
    assert found.count() == expected.count() and found.exceptAll(expected).count() == 0


def test_fields_of_another_type_and_unknown_fields(spark, tmp_path):
    folder = str(tmp_path / "landed")
    odd = {"facts": {"us-gaap": {"Z": {"units": {"USD": [{**fact("2020-12-31", 5), "fy": "soon", "note": {"by": "x"}}, 3], "EUR": 4}}}}}
    L.land_documents(texts(spark, [("A", 0, json.dumps(odd))]), folder, 0)
    landed = L.read_landed(spark, folder)
    rows = L.landed_facts(landed, units="all").orderBy("pos.idx").collect()
    assert [(r.fy, r.val, r.form) for r in rows] == [(None, 5.0, "10-K"), (None, None, None)]
    kept = landed.filter("unit = 'USD'").select(F.expr("try_variant_get(facts, '$[0].note.by', 'string')")).first()
    assert kept[0] == "x"


def test_empty_batch(spark, tmp_path):
    folder = str(tmp_path / "landed")
    L.land_documents(texts(spark, ODD[1:3]), folder, 0)
    assert L.landed_facts(L.read_landed(spark, folder, ["Z"])).count() == 0


def rows_read(frame) -> int:
    """Rows that the scan of a plan without exchanges has given."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_few_concepts_read_a_part_of_the_rows(spark, tmp_path):
    folder = str(tmp_path / "landed")
    spark.conf.set("parquet.block.size", str(16 << 10))
    try:
        L.land_documents(V.documents(spark, "/root/testdata/sf0.01"), folder, 0)
    finally:
        spark.conf.unset("parquet.block.size")
    tags = [r["tag"] for r in L.read_landed(spark, folder).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(3).collect()]
    some = L.read_landed(spark, folder, tags).select("tag", "symbol")
    assert "In(tag" in some._jdf.queryExecution().executedPlan().toString()
    whole, part = rows_read(L.read_landed(spark, folder).select("tag", "symbol")), rows_read(some)
    assert 0 < some.count() <= part < 0.5 * whole
