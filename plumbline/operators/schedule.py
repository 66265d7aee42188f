"""Run bookkeeping as columns over epochs or sample counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import running


def should_evaluate(epoch: Column, every: int, last: int | Column) -> Column:
    return (epoch % every == 0) | (epoch == last)


def sampling_probability(epoch: Column, step: float, interval: int, most: float) -> Column:
    return F.least(F.lit(most), F.floor(epoch / interval) * F.lit(step))


def step_rate(rate: float, gamma: float, step: int, epochs_done: Column) -> Column:
    return F.lit(rate) * F.pow(F.lit(gamma), F.floor(epochs_done / step).cast("double"))


def next_threshold(seen: Column, every: int) -> Column:
    return (F.floor(seen / every) + 1) * every


def crossings(df: DataFrame, group: str, order: str, samples: str, every: int) -> DataFrame:
    """``df`` with seen (running sum) and saves (thresholds that the row crosses, maybe several); ``order`` is a number."""
    summed = running(df, [group], order, {"seen": F.col(samples)}, {})
    return summed.withColumn("saves", (F.floor(F.col("seen") / every) - F.floor((F.col("seen") - F.col(samples)) / every)).cast("long"))


def best_so_far(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``df`` with best (running maximum) and improved (strictly above all before); ``order`` is a number."""
    found = running(df, [group], order, {}, {"_before": F.col(value)})
    before = F.col("_before")
    return found.withColumn("best", F.greatest(before, F.col(value))).withColumn("improved", before.isNull() | (F.col(value) > before)).drop("_before")


def save_kind(name: str, allowed: tuple[str, ...] = ("samples", "epoch")) -> str:
    """The name if it is allowed; ValueError otherwise."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {allowed}")
    return name


def positive(n: int) -> int:
    """A whole number above 0; ValueError otherwise."""
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise ValueError(f"{n!r} is not a whole number above 0")
    return n
