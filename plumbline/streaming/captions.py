"""Captions of questions and answers that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import with_captions


def caption_stream(questions: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """The rules are narrow expressions, so a stream gets them without state."""
    return with_captions(questions, question, answer)


def rule_counts(captions: DataFrame, time: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Captions per rule and window of event time; rows later than ``late`` are left out once their window is closed."""
    return captions.withWatermark(time, late).groupBy(F.window(time, every), "rule").agg(F.count(F.lit(1)).alias("n"))
