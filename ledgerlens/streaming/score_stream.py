"""Scoring of filings as they arrive.

Documents land as JSON lines. What a later batch needs of earlier ones is kept as keyed state, in two steps, so a
micro-batch reads and writes the state of the firms, tags and years in it and nothing else:

1. `FirstPerEnd`, by firm and tag: the period ends that have been reported. A fact whose period end is known is dropped,
   whatever document brings it again, so a restatement under a new accession number changes nothing (the batch operator
   keeps the first fact, too).
2. `LatestPerTag`, by firm and requested year: the last fact of each tag of that year and the year before. A firm-year
   with a new fact is given to the scorer with all its facts.

Before them, a document that is filed again unchanged within `REPEAT` is dropped by its digest. Nothing is dropped as
late: the clock of that limit is the arrival, and after it a repeated document still adds nothing. Documents of one batch
are ordered by part, batches by arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ledgerlens.functions.expressions import annual_filing
from ledgerlens.operators.dedup import first_per_key
from ledgerlens.session import delete_folder
from ledgerlens.sources.company_facts import explode_facts, parse_documents
from ledgerlens.sources.readers import DOCUMENT

# How long digests of documents are remembered.
REPEAT = "30 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POS = "ns_order int, unit_place int, turn int, part int, idx int"
_FRESH = f"symbol string, tag string, fy int, `end` string, val double, {_POS}"
_REQUESTED = f"symbol string, requested int, fy int, tag string, `end` date, val double, pos struct<{_POS.replace(' int', ': int')}>"
_ORDER = ["ns_order", "unit_place", "turn", "part", "idx"]


class FirstPerEnd(StatefulProcessor):
    """Per (symbol, tag): the first fact of each (namespace, unit, end) over all batches; the annual ones go on."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "turn int, ends string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, ends = self.known.get() or (0, "[]")
        seen = set(json.loads(ends))
        facts = pd.concat(list(rows)).sort_values(["ns_order", "unit_place", "part", "idx"])
        names = facts["ns"] + "|" + facts["unit"] + "|" + facts["end"].fillna("")
        fresh = facts[~names.duplicated() & ~names.isin(seen)]
        if len(fresh):
            self.known.update((turn + 1, json.dumps(sorted(seen.union(names)))))
            annual = fresh[fresh["annual"]].assign(turn=turn)
            yield annual[["symbol", "tag", "fy", "end", "val", *_ORDER]]

    def close(self) -> None:
        pass


class LatestPerTag(StatefulProcessor):
    """Per (symbol, requested year): the last fact of each tag of that year and the one before, all of them whenever one is new."""

    def init(self, handle) -> None:
        self.facts = handle.getValueState("facts", "held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {(fy, tag): tuple(fact) for fy, tag, *fact in json.loads((self.facts.get() or ("[]",))[0])}
        for frame in rows:
            values = frame[["fy", "tag", "end", "val", *_ORDER]].astype(object).where(lambda x: x.notna(), None)
            for fy, tag, end, val, *pos in values.itertuples(index=False):
                # A missing end counts as last, then the later end, then the later place.
                fact = (end, val, [int(p) for p in pos])
                rank = lambda f: (f[0] is None, f[0] or "", f[2])
                if (int(fy), tag) not in held or rank(fact) > rank(held[int(fy), tag]):
                    held[int(fy), tag] = fact
        flat = sorted([fy, tag, *fact] for (fy, tag), fact in held.items())
        self.facts.update((json.dumps(flat),))
        yield pd.DataFrame({
            "symbol": key[0], "requested": key[1], "fy": [x[0] for x in flat], "tag": [x[1] for x in flat],
            "end": [x[2] and pd.Timestamp(x[2]).date() for x in flat], "val": [x[3] for x in flat],
            "pos": [dict(zip(_ORDER, x[4], strict=True)) for x in flat],
        })

    def close(self) -> None:
        pass


def document_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(landing)


def without_repeats(documents: DataFrame, within: str = REPEAT) -> DataFrame:
    """Documents of a stream, but for those that arrive again unchanged within a time; keeps digests, not texts."""
    marked = documents.withColumns({"_digest": F.sha2("text", 256), "_arrived": F.current_timestamp()})
    return marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["symbol", "part", "_digest"])


def touched_facts(documents: DataFrame) -> DataFrame:
    """Documents of a stream -> the facts of every firm-year that a micro-batch touches and of the year before it:
    symbol, requested, fy, tag, end, val, pos."""
    facts = explode_facts(parse_documents(documents)).select(
        "symbol", "tag", "ns", "unit", F.date_format("end", "yyyy-MM-dd").alias("end"), "fy", "val",
        F.coalesce(annual_filing(), F.lit(False)).alias("annual"), "pos.ns_order", "pos.unit_place", "pos.part", "pos.idx",
    )
    fresh = facts.groupBy("symbol", "tag").transformWithStateInPandas(FirstPerEnd(), _FRESH, "Append", "None")
    asked = fresh.withColumn("requested", F.explode(F.array(F.col("fy"), F.col("fy") + 1)))
    return asked.groupBy("symbol", "requested").transformWithStateInPandas(LatestPerTag(), _REQUESTED, "Append", "None")


def start_scoring(
    spark: SparkSession,
    landing: str,
    scratch: str,
    sink: str,
    checkpoint: str,
    score: Callable[[DataFrame, DataFrame], DataFrame],
    trigger: dict | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start the job. `score(facts, requests)` is `score_batch` with its models and history bound.

    The facts of a batch's firm-years lie in a folder of `scratch` until its scores are written, so the state is read
    once; both folders are the batch's own, and a repeated batch replaces them.
    """

    def on_batch(touched: DataFrame, batch: int) -> None:
        session, folder = touched.sparkSession, f"{scratch}/batch={batch}"
        touched.write.mode("overwrite").parquet(folder)
        facts = session.read.schema(touched.schema).parquet(folder)
        requests = facts.select("symbol", F.col("requested").alias("fy")).distinct()
        score(facts.drop("requested"), requests).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
        delete_folder(session, folder)

    facts = touched_facts(without_repeats(document_stream(spark, landing, files_per_batch)))
    writer = facts.writeStream.foreachBatch(on_batch).outputMode("append").option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state of this kind needs it; a query keeps the setting it started with
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def latest_scores(spark: SparkSession, sink: str) -> DataFrame:
    """The newest score of every firm-year."""
    return first_per_key(spark.read.parquet(sink), ["symbol", "fy"], [F.col("batch").desc()]).drop("batch")
