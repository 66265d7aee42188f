"""Question, annotation and caption files: one JSON object each, with an array of records.

Schemas are fixed, never inferred. A file is read by byte ranges, however long its only line is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.json_split import read_records

QUESTIONS = "question_id bigint, image_id bigint, question string"
ANNOTATIONS = "question_id bigint, answers array<struct<answer:string>>"
CAPTIONS = "image_id bigint, caption string"


def _records(spark: SparkSession, path: str, element: str, field: str) -> DataFrame:
    """The records of the array, with pos: their place in the file."""
    return read_records(spark, path, field, element).drop("file").withColumn("pos", F.col("pos").cast("int"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, QUESTIONS, "questions")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question_id, answers array<string>)."""
    return _records(spark, path, ANNOTATIONS, "annotations").withColumn("answers", F.col("answers.answer"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, CAPTIONS, "annotations")


def all_question_ids(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Question ids alone, in file order; the first ``most`` if that is above 0."""
    ids = read_questions(spark, path).select("pos", "question_id").orderBy("pos")
    return (ids.limit(most) if most is not None and most > 0 else ids).select("question_id")


def split_of(splits: Mapping[str, str], name: str) -> str:
    """The path of a split; ValueError for an unknown one."""
    if name not in splits:
        raise ValueError(f"unknown split {name!r}; known: {', '.join(sorted(splits))}")
    return splits[name]


def as_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
