from __future__ import annotations

import json

from ledgerlens import schemas
from pyspark.sql import functions as F

from ledgerlens.operators.dedup import annual_facts, keep_last
from ledgerlens.operators.lookup import layered_directory, manual_identifiers, resolve_identifiers, unresolved
from ledgerlens.plans.constituents import constituent_tickers, worklist
from ledgerlens.sources.company_facts import explode_facts, parse_documents, parse_report
from ledgerlens.sources.readers import (
    read_company_facts, read_constituents, read_delimited, read_industry_codes, read_ticker_directory,
)
from ledgerlens.sources.writers import write_table


def test_industry_codes_keep_zeros_and_read_na_as_missing(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("tic;sic\nCTVA;100\nNA;6099\nIBM;7370\n")
    rows = {r.ticker: r.sic for r in read_industry_codes(spark, str(tmp_path / "codes.csv")).collect()}
    assert rows == {"CTVA": "0100", None: "6099", "IBM": "7370"}


def test_constituents_to_worklist(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,t1,t2\n2020-01-01,OLD,IBM\n2020-12-31,IBM,NA\n2021-03-01,IBM,JPM\n")
    codes = spark.createDataFrame([("IBM", "7370"), ("JPM", "6021")], "ticker string, sic string")
    snapshots = read_constituents(spark, str(tmp_path / "c.csv"), ["t1", "t2"])
    listed = constituent_tickers(snapshots, ["t1", "t2"])
    assert {tuple(r) for r in listed.collect()} == {(2020, 1, "IBM"), (2020, 2, None), (2021, 1, "IBM"), (2021, 2, "JPM")}
    assert {tuple(r) for r in worklist(listed, codes).collect()} == {("IBM", 2020), ("IBM", 2021)}


def test_layered_lookup(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"0": {"cik_str": 51143, "ticker": "IBM", "title": "I B M"}, "1": {"cik_str": 9, "ticker": "IBM", "title": "later"}}))
    first = read_ticker_directory(spark, str(tmp_path / "d.json"))
    second = spark.createDataFrame([(7, "IBM", "x"), (8, "XYZ", "y")], "cik_str bigint, ticker string, title string")
    directory = layered_directory(first, second, manual_identifiers(spark))
    tickers = spark.createDataFrame([("IBM",), ("XYZ",), ("WFM",), ("???",), (None,)], "ticker string")
    got = {r.ticker: (r.source, r.cik) for r in resolve_identifiers(tickers, directory).collect()}
    assert got["IBM"] == (1, "0000051143") and got["XYZ"] == (2, "0000000008") and got["WFM"] == (3, "0000865436")
    assert [r.ticker for r in unresolved(tickers, directory).collect()] == ["???"]


def fact(end, val, form="10-K", fy=2020, **more):
    return {"end": end, "val": val, "accn": "x", "fy": fy, "fp": "FY", "form": form, "filed": "2021-02-01", **more}


DOCUMENT = {"cik": 1, "entityName": "I B M", "facts": {
    "dei": {"Shares": {"label": "s", "units": {"shares": [fact("2020-12-31", 5)]}}},
    "us-gaap": {
        "Cash": {"label": "c", "description": "d", "units": {
            "USD": [fact("2020-12-31", 1, form="10-Q"), fact("2020-12-31", 2), fact("2019-12-31", 3, frame="CY2019")],
            "EUR": [fact("2020-12-31", 9)],
        }},
        "Empty": {"label": "e", "units": {}},
    },
    "other": {"Ignored": {"label": "i", "units": {"USD": [fact("2020-12-31", 1)]}}},
}}


def test_documents(spark, tmp_path):
    (tmp_path / "IBM.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "BAD.json").write_text(json.dumps(DOCUMENT)[:200])
    (tmp_path / "NIL.json").write_text("{}")
    parsed = parse_documents(read_company_facts(spark, str(tmp_path), layout="files"))
    assert {r.symbol: r.status for r in parsed.collect()} == {"IBM": "ok", "BAD": "corrupt", "NIL": "empty"}
    assert {r.status: r.n for r in parse_report(parsed).collect()} == {"ok": 1, "corrupt": 1, "empty": 1}
    rows = explode_facts(parsed).collect()
    assert {(r.ns, r.ns_order, r.tag, r.unit, r.val) for r in rows} == {
        ("dei", 1, "Shares", "shares", 5.0), ("us-gaap", 0, "Cash", "USD", 1.0), ("us-gaap", 0, "Cash", "USD", 2.0), ("us-gaap", 0, "Cash", "USD", 3.0),
    }
    assert {r.frame for r in rows} == {None, "CY2019"} and {r.start for r in rows} == {None}
    assert explode_facts(parsed, units="all").filter("tag = 'Cash'").count() == 4
    assert [r.tag for r in annual_facts(explode_facts(parsed)).collect()] == ["Shares"]


def test_order_of_facts_across_namespaces_and_units(spark, tmp_path):
    """One tag in two namespaces and two units with the same end: the later namespace is last, each unit keeps its fact."""
    both = {"facts": {
        "dei": {"T": {"label": "t", "units": {"USD": [fact("2020-12-31", 2)]}}},
        "us-gaap": {"T": {"label": "t", "units": {"USD": [fact("2019-12-31", 7), fact("2020-12-31", 1)], "shares": [fact("2020-12-31", 4)]}}},
    }}
    (tmp_path / "X.json").write_text(json.dumps(both))
    parsed = parse_documents(read_company_facts(spark, str(tmp_path), layout="files"))
    rows = annual_facts(explode_facts(parsed))
    assert [r.val for r in keep_last(rows.withColumn("fy", F.lit(2020)).filter("val <> 7")).collect()] == [2.0]
    units = annual_facts(explode_facts(parsed, units="all")).filter("ns = 'us-gaap' AND end = '2020-12-31'")
    assert {(r.unit, r.val) for r in units.collect()} == {("USD", 1.0), ("shares", 4.0)}


def test_documents_are_parsed_once(spark, tmp_path):
    (tmp_path / "IBM.json").write_text(json.dumps(DOCUMENT))
    parsed = parse_documents(read_company_facts(spark, str(tmp_path), layout="files"))
    plan = explode_facts(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_partitioned_table_round_trip(spark, tmp_path):
    frame = spark.range(100).selectExpr("id", "int(2015 + id % 3) AS fy")
    write_table(frame, str(tmp_path / "t"), partition_by="fy")
    back = spark.read.parquet(str(tmp_path / "t")).filter("fy = 2016")
    assert back.count() == 33
    assert "PartitionFilters: [isnotnull(fy" in back._jdf.queryExecution().executedPlan().toString()
    write_table(frame, str(tmp_path / "c"), fmt="csv")
    assert read_delimited(spark, str(tmp_path / "c"), frame.schema).count() == 100
    assert schemas.COMPANY_FACTS.fieldNames()[-1] == schemas.CORRUPT
