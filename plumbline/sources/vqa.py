"""Question/answer samples and captions from files, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import plain_answer
from plumbline.operators import relational, rules
from plumbline.operators.vocab import Vocabulary, encode, padded
from plumbline.sources.json_tables import read_annotations, read_captions, read_questions, split_of


def answered_questions(spark: SparkSession, questions: str, annotations: str) -> DataFrame:
    """(question_id, image_id, question, answers, answer): inner join of the last row of every id."""
    q = relational.keep_last(read_questions(spark, questions), ["question_id"], ["pos"]).drop("pos")
    a = relational.keep_last(read_annotations(spark, annotations), ["question_id"], ["pos"]).drop("pos")
    votes = a.select("question_id", F.posexplode("answers").alias("nth", "said"))
    best = relational.mode(votes, "question_id", plain_answer(F.col("said")), "nth").select("question_id", "answer")
    return q.join(a, "question_id").join(best, "question_id")


def generated_captions(spark: SparkSession, questions: str, annotations: str, most: int | None = None) -> DataFrame:
    """(question_id, image_id, question, answer, caption, rule) of the first ``most`` ids (all by default)."""
    rows = relational.capped(answered_questions(spark, questions, annotations), ["question_id"], most)
    return rules.with_captions(rows).select("question_id", "image_id", "question", "answer", "caption", "rule")


def caption_lists(spark: SparkSession, captions: str) -> DataFrame:
    """(image_id, captions) in file order."""
    return relational.grouped_list(read_captions(spark, captions), "image_id", "pos", "caption", "captions")


def caption_samples(spark: SparkSession, captions: str, image_ids: DataFrame | None = None, most_images: int | None = None) -> DataFrame:
    """(image_id, pos, caption), one row per caption, of the first ``most_images`` ids; an empty id table means all.

    pos is the caption's place in the file. No list is made: captions stay rows, and only ids are capped.
    """
    rows = read_captions(spark, captions)
    if image_ids is not None and not image_ids.isEmpty():
        rows = rows.join(image_ids.select("image_id").distinct(), "image_id", "left_semi")
    if most_images is not None and most_images > 0:
        rows = rows.join(relational.capped(rows.select("image_id").distinct(), ["image_id"], most_images), "image_id", "left_semi")
    return rows.select("image_id", "pos", "caption")


def batched_samples(samples: DataFrame, key: str, text: str, vocab: Vocabulary, most_tokens: int, batch: int, most: int | None = None) -> DataFrame:
    """(key, ids, batch): the first ``most`` samples by key, encoded, cut to ``most_tokens`` ids, in batches of ``batch``,
    padded to the longest of their batch. The order is that of the key: nothing is shuffled at random."""
    rows = relational.capped(samples, [key], most)
    encoded = encode(rows, key, text, vocab, most_tokens)
    return padded(relational.in_batches(encoded, [], key, batch), "batch")


def split_batches(spark: SparkSession, questions: Mapping[str, str], annotations: Mapping[str, str], split: str, vocab: Vocabulary, most_tokens: int, batch: int, most: int | None = None) -> DataFrame:
    """(question_id, ids, batch, answer) of a split's answered questions; ValueError for an unknown split."""
    rows = answered_questions(spark, split_of(questions, split), split_of(annotations, split))
    made = batched_samples(rows, "question_id", "question", vocab, most_tokens, batch, most)
    return made.join(rows.select("question_id", "answer"), "question_id")
