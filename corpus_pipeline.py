"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between stages
the rows are a Parquet table, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import catalog, decontaminate, language, linededup, neardup, packing
from plumbline.llm.common import free_name, shared_folder


def shielded(docs: DataFrame, fresh: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns that share a name with an operator's new ones put aside, and what restores them."""
    taken = {n.lower() for n in fresh}
    aside = {c: free_name(docs, f"{c}_of_docs") for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(aside), lambda df: df.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject (null or letterless texts, and texts far
    from every learnt language, go); columns as they were."""
    own, restored = shielded(docs, language.OUT.names)
    return restored(language.identify(own, language.fit_on_fold(own)).where(~F.col("rejected")))


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which nothing is left go, and
    n_chars, if there is one, follows the text where it changed."""
    own, restored = shielded(docs, ("n_lines", "n_removed_lines"))
    found = linededup.drop_repeated_lines(own)
    changed = F.col("n_removed_lines") > 0
    left = found.where(~(changed & (F.col("text") == "")))
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(left)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, restored = shielded(docs, decontaminate.OUT.names)
    return restored(decontaminate.benchmark_hits(own, benchmark).where(F.size("hits") == 0))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces with their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, catalog.tokenizer(catalog.WORD_BPE), with_ids=False)
    return packing.pack(pieces, "length", ["doc_id", "start", "ids_crc32"])


STAGES = [
    ("language", keep_known_languages),
    ("line_runs", drop_repeated_runs),
    ("near_duplicates", keep_one_of_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the sketches or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; between stages the rows are written and read again.

    A stage's table is emptied once the next stage's is written; the last one stays for the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(before)
            before = path
    return docs
