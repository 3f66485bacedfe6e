"""A training corpus from raw documents: stages that each apply one operator to all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, exact_dedup, minhash, packing, quality
from ledgerlens.llm.common import DOCUMENT_COLUMNS
from ledgerlens.llm.tokens import public_path
from ledgerlens.session import delete_folder, scratch_path, scratch_scope

_CARRIED = tuple(c for c in DOCUMENT_COLUMNS if c != "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Where the last stage of an application has stored what its result is read from.
_LEFT: dict[str, str] = {}


def in_turn(stage: Stage) -> Stage:
    """A stage's own tables are deleted when the next stage begins: its result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        if application in _LEFT:
            delete_folder(spark, _LEFT.pop(application))
        with scratch_scope(spark) as folder:
            _LEFT[application] = folder
            return stage(spark, docs, sf_dir)

    return run_stage


@in_turn
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on `labels`, scores at 0.5 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, "__score").where("__score >= 0.5").select(*DOCUMENT_COLUMNS)


@in_turn
def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space at most, the one with the smallest doc_id."""
    return exact_dedup.exact_groups(docs, carry=_CARRIED).where("kept").select(*DOCUMENT_COLUMNS)


@in_turn
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, pairs that share 80 % of their shingles of five words, the document with the smallest doc_id."""
    return minhash.near_groups(docs, percent=80, carry=_CARRIED).where("kept").select(*DOCUMENT_COLUMNS)


@in_turn
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no item of `benchmark` has leaked into."""
    marked = decontamination.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(*DOCUMENT_COLUMNS)


@in_turn
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; their ids are those of the word-level public tokenizer."""
    pieces = packing.pack(docs, public_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_each_text),
    ("minhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

# A fitted classifier and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again by the next.

    An empty `documents` table passes through every stage; what each stage does with nulls, ties and repeated rows is
    said in its operator.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
