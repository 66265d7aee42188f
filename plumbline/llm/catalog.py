"""Queries opN_<name> over the tables of a folder, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import binary, chat, decontaminate, drake, importance, language, linededup, neardup, packing, quality, shards, suffixdedup, tokens
from plumbline.llm.common import cut, table
from plumbline.llm.oracles import ORACLES

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; only the queries that need one import the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.line_quality(docs, keep=["doc_id"]).drop("clean_text")


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shards.manifest(table(spark, sf_dir, "documents"), "text", "doc_id")
    placed = shards.place(docs, "doc_id", 8, ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, tokenizer(BYTE_BPE), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_chats(cut(chat.format_chats(chats)))


def op6_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, tokenizer(WORD_BPE), with_ids=False)
    placed = packing.pack(pieces, "length", ["doc_id", "start", "ids_crc32"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "text")


def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = binary.block_path(spark)
    binary.write_blocks(docs, path, tokenizer(WORD_BPE))
    found = binary.read_blocks(spark.read.schema(binary.BLOCK).parquet(path), with_ids=False)
    return found.withColumnRenamed("key", "doc_id")


def op10_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_on_fold(docs)
    found = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op11_drake_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = drake.cluster(table(spark, sf_dir, "embeddings"))
    found, total = cut(found.withColumnRenamed("key", "vec_id")), F.sum("cluster_inertia").over(Window.partitionBy())
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # one row for each of the few centroids
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumn("inertia", total).join(F.broadcast(named), "cluster")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.resampled(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixdedup.repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    left = F.sha2(suffixdedup.remaining(F.col("text"), F.col("spans")), 256)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), left.alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_wu_manber, op3_jump_shards, op4_prob_minhash, op5_chat_round_trip,
        op6_bin_slack, op7_token_counts, op8_line_runs, op9_elias_fano, op10_centroids,
        op11_drake_bounds, op12_target_draw, op13_column_bwt,
    )
}
