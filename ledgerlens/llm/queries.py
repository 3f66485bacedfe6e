"""One registered query per operator, over its whole tables; the pipeline is registered in corpus_pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    binary_output,
    config_packing,
    decontamination,
    exact_dedup,
    line_dedup,
    lm_scoring,
    minhash,
    negatives,
    packing,
    quality,
    sharding,
    substring_dedup,
    whitening,
)
from ledgerlens.llm.tokens import public_path
from ledgerlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost",
    )


@query("op10_binary_output")
def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "sequences")
    files = binary_output.write_sequences(table(spark, sf_dir, "documents"), folder, public_path("byte_bpe_50k.json"))
    found = binary_output.read_documents(spark, folder, files)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_SHARDS_SQL = """
    WITH d AS (
        SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
               ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT // 2 AS bits
        FROM documents
    ), levels AS (
        SELECT doc_id, bytes, depth, bits >> (31 - depth) AS prefix
        FROM d, (SELECT unnest(range(32)) AS depth)
    ), sums AS (
        SELECT *, sum(bytes) OVER b AS shard_bytes, count(*) OVER b AS shard_docs
        FROM levels WINDOW b AS (PARTITION BY depth, prefix)
    )
    SELECT doc_id, bytes, depth::INT AS depth,
           CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
           shard_bytes::BIGINT AS shard_bytes, shard_docs
    FROM sums WHERE shard_bytes <= {limit} QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""


@query("op3_extendible_sharding", _SHARDS_SQL.format(limit=16 << 20))
def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("shards_of_256_kib", _SHARDS_SQL.format(limit=256 << 10))
def shards_of_256_kib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 at a limit that splits the small tables too; no document there is larger."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=256 << 10)


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents),
    g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM d JOIN g USING (content)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    marked = decontamination.with_leaks(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.item_words", "leak.matched_words", "leak.coverage", F.size("leak.tiles").alias("n_tiles"),
    )


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents")).drop("line")


@query("op11_config_packing")
def op11_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = config_packing.pack_best_fit(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.fit_whitening(vectors)
    error = F.lit(whitening.identity_error(vectors, fit)).cast("double")
    return whitening.whiten(vectors, fit).select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", error.alias("identity_error"),
    )


@query("op13_hard_negatives", """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND NOT list_contains(list_transform(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c)), true)
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY row_number() OVER best <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved))
