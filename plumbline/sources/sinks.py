"""Written results: generated captions with a header, reports, run states."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import picked, sampled
from plumbline.operators.rules import rule_histogram

DESCRIPTION = "Statements made from questions and answers by rules"


def caption_header(captions: DataFrame, questions: str, annotations: str) -> DataFrame:
    """One row: description, source paths, num_samples and rule_counts (map)."""
    counts = rule_histogram(captions)
    return counts.agg(
        F.lit(DESCRIPTION).alias("description"), F.lit(questions).alias("source_questions"), F.lit(annotations).alias("source_annotations"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_samples"), F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("rule_counts"),
    )


def write_captions(captions: DataFrame, path: str, questions: str, annotations: str) -> None:
    """``path``/info (one JSON line) and ``path``/annotations (JSON lines, written by all executors)."""
    caption_header(captions, questions, annotations).write.mode("overwrite").json(f"{path}/info")
    captions.write.mode("overwrite").json(f"{path}/annotations")


def write_array_files(df: DataFrame, path: str, field: str) -> None:
    """One file per task: a JSON object whose array ``field`` holds the task's rows, a record a line. Each is valid JSON by itself."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values: pa.RecordBatch.from_arrays([values], names=["value"])
        yield one(pa.array([f'{{"{field}": [']))
        waiting = None  # the last record has no comma behind it
        for batch in batches:
            if not len(batch):
                continue
            if waiting is not None:
                yield one(pc.binary_join_element_wise(waiting, ",", ""))
            own = batch.column(0)
            if len(own) > 1:
                yield one(pc.binary_join_element_wise(own.slice(0, len(own) - 1), ",", ""))
            waiting = own.slice(len(own) - 1)
        if waiting is not None:
            yield one(waiting)
        yield one(pa.array(["]}"]))

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def report(captions: DataFrame, first: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rules by count with their share, and the first rows by question id."""
    return rule_histogram(captions).orderBy(F.desc("n"), "rule"), captions.orderBy("question_id").limit(first)


def sample_report(predicted: DataFrame, captions: DataFrame, key: str = "image_id", order: str = "pos", value: str = "caption") -> DataFrame:
    """(key, predicted, first_caption, fifth_caption): what was said beside two of the references, null where there are fewer."""
    own = picked(captions.join(predicted.select(key).distinct(), key, "left_semi"), key, order, value, (0, 4))
    joined = predicted.join(own, key, "left")
    return joined.select(key, "predicted", F.get(value, F.lit(0)).alias("first_caption"), F.get(value, F.lit(1)).alias("fifth_caption"))


def sample_run(rows: DataFrame, captions: DataFrame, n: int, seed: int, predict: Callable[[DataFrame], DataFrame], key: str = "image_id", order: str = "pos", value: str = "caption") -> DataFrame:
    """The report of ``n`` rows drawn with ``seed``; ``predict`` adds the column ``predicted``."""
    return sample_report(predict(sampled(rows, key, n, seed)), captions, key, order, value)


def append_state(spark, path: str, **state) -> None:
    """One row (epoch, best, samples_seen, ...) appended to the table of run states."""
    spark.createDataFrame([state]).write.mode("append").parquet(path)


def latest_state(states: DataFrame, runs: Sequence[str] = (), seen: str = "samples_seen") -> DataFrame:
    """Per run (or of all states), the row with the most samples seen."""
    rest = [c for c in states.columns if c not in runs]
    last = states.groupBy(*runs).agg(F.max_by(F.struct(*rest), F.col(seen)).alias("_s")).where("_s is not null")
    return last.select(*runs, *(F.col("_s")[c].alias(c) for c in rest))
