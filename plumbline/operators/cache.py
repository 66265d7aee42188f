"""Read-through tables of computed features."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_hits(wanted: DataFrame, cached: DataFrame, key: str, batch: Column, valid: Column | None = None) -> DataFrame:
    """(batch, n, found, hit): a batch is a hit only if the cache has all of its keys in valid form."""
    good = (cached if valid is None else cached.where(valid)).select(key).distinct().withColumn("_in", F.lit(True))
    joined = wanted.select(key, batch.alias("batch")).join(good, key, "left")
    inside = F.coalesce("_in", F.lit(False))
    return joined.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("found"), F.bool_and(inside).alias("hit"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_through(wanted: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of all wanted keys from the parquet table at ``path``; missing ones are computed and appended.

    One row per wanted key that has features, however often the table holds it: two runs at a time may
    both append a key. Errors are raised, never swallowed.
    """
    spark, keys = wanted.sparkSession, wanted.dropDuplicates([key])
    there = _stored(spark, path)
    missing = keys if there is None else keys.join(there.select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys.select(key), key, "left_semi").dropDuplicates([key])


def matching_entries(state: DataFrame, target: DataFrame, by: tuple[str, ...] = ("name", "shape"), drop_prefix: str | None = None) -> DataFrame:
    """Rows of ``state`` that ``target`` has under the same name and shape, after a prefix is taken off."""
    if drop_prefix is not None:
        state = state.where(F.startswith("name", F.lit(drop_prefix))).withColumn("name", F.substr("name", F.lit(len(drop_prefix) + 1)))
    same = reduce(lambda a, b: a & b, (state[c] == target[c] for c in by))
    return state.join(target, same, "left_semi")
