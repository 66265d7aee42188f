"""Keyed rows: last-wins de-duplication, joins of question and answer tables, caps, lookups, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Parts of a group that ``numbered`` and ``running`` order by themselves.
MOST_PARTS = 512


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order`` (a total order makes it definite).

    An aggregate, so copies of a hot key are reduced before the shuffle and no group is sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*(F.col(c) for c in order))
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordered).alias("_row"))
    return last.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def common_keys(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Distinct keys that both tables have."""
    return left.select(key).distinct().join(right.select(F.col(right_key or key).alias(key)).distinct(), key, "left_semi")


def capped(df: DataFrame, order: Sequence[str], most: int | None) -> DataFrame:
    """The first ``most`` rows by ``order``; None, 0 or less means all."""
    return df.orderBy(*order).limit(most) if most is not None and most > 0 else df


def joined_then_capped(left: DataFrame, right: DataFrame, key: str, most: int | None) -> DataFrame:
    """Inner join on ``key``, then the first ``most`` keys."""
    return capped(left.join(right, key), [key], most)


def capped_then_joined(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], most: int | None) -> DataFrame:
    """The first ``most`` rows of ``left`` by ``order``, then the inner join, which may leave fewer."""
    return capped(left, order, most).join(right, key)


def first_distinct(df: DataFrame, key: str, order: str, most: int | None) -> DataFrame:
    """The first ``most`` distinct keys in the order of their first row."""
    return capped(df.groupBy(key).agg(F.min(order).alias("first_at")), ["first_at", key], most)


def with_list(df: DataFrame, lists: DataFrame, key: str, values: str) -> DataFrame:
    """``df`` with the list of its key, empty where there is none."""
    found = df.join(lists, key, "left")
    empty = F.array().cast(lists.schema[values].dataType)
    return found.withColumn(values, F.coalesce(values, empty))


def grouped_list(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Per key, its values in the order of ``order``. For keys of few rows, as an image's captions are; where
    a key may hold much of the table, use ``numbered`` and its places."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def with_part(df: DataFrame, order: str, name: str = "_part") -> DataFrame:
    """``df`` with ``name``: which of MOST_PARTS (or as many as shuffle partitions) ranges of the number ``order`` the row is in.

    Ranges end at quantiles of the whole table; a row's one is found by halving. Null stands in the first.
    """
    if not isinstance(df.schema[order].dataType, T.NumericType):
        raise ValueError(f"{order} must be a number, not {df.schema[order].dataType.simpleString()}")
    parts = min(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    every, x = F.array(*map(F.lit, bounds)).cast("array<double>"), F.col(order)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    up = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(every, at + s - 1) <= x), at + s).otherwise(at)
    return df.withColumn(name, F.aggregate(steps, F.lit(0), up) if bounds else F.lit(0))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows (of a few values each); counted first, no further than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the row's place in its group by the number ``order``, from 0 (equal ones in any order).

    No group is ordered in one task: rows are parted at quantiles of ``order`` over the whole table,
    numbered within (group, part), and each part starts where the group's parts before it end.
    """
    dealt = with_part(df, order)
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(order)) - 1)
    same = [local[c].eqNullSafe(starts[c]) for c in (*group, "_part")]
    return local.join(starts, same).select(*(local[c] for c in df.columns), (local["_nth"] + starts["_start"]).cast("long").alias(name))


def running(df: DataFrame, group: Sequence[str], order: str, sums: dict[str, Column], tops: dict[str, Column]) -> DataFrame:
    """``df`` with running values within each group by the number ``order``: the sums up to and with the row, and the
    greatest values of all rows before it (null for the first).

    A scan in two levels: within ranges of ``order``, and over the ranges' totals (MOST_PARTS rows a group at
    most). No task holds a group that is a large part of the table.
    """
    dealt = with_part(df, order).withColumns({f"_of_{n}": c for n, c in (sums | tops).items()})
    totals = dealt.groupBy(*group, "_part").agg(*(F.sum(f"_of_{n}").alias(n) for n in sums), *(F.max(f"_of_{n}").alias(n) for n in tops))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums), *(F.max(n).over(earlier).alias(n) for n in tops))
    own = Window.partitionBy(*group, "_part").orderBy(order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_in_{n}": F.sum(f"_of_{n}").over(upto) for n in sums} | {f"_in_{n}": F.max(f"_of_{n}").over(before) for n in tops})
    same = [local[c].eqNullSafe(starts[c]) for c in (*group, "_part")]
    whole = [(local[f"_in_{n}"] + starts[n]).alias(n) for n in sums] + [F.greatest(local[f"_in_{n}"], starts[n]).alias(n) for n in tops]
    return local.join(starts, same).select(*(local[c] for c in df.columns), *whole)


def list_digest(df: DataFrame, key: str, place: str, value: str, size: int = 4096) -> DataFrame:
    """(key, n, digest): md5 over a key's values by place, taken in two steps: of each ``size`` values, then of those."""
    ordered = lambda at, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(v).cast("string").alias("v")))), lambda p: p["v"])
    chunk = F.floor(F.col(place) / size).alias("chunk")
    inner = df.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(ordered(place, value), ",")).alias("md5"))
    return inner.groupBy(key).agg(F.sum("n").alias("n"), F.md5(F.array_join(ordered("chunk", "md5"), ",")).alias("digest"))


def picked(df: DataFrame, key: str, order: str, value: str, places: Sequence[int]) -> DataFrame:
    """Per key, an array of its values at ``places`` (from 0); null beyond its rows. Only as many rows of a key as asked for are kept."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    few = df.select(key, F.col(value).alias("_v"), order).withColumn("_nth", nth).where(F.col("_nth") <= max(places))
    return few.groupBy(key).agg(F.array(*(F.max(F.when(F.col("_nth") == p, F.col("_v"))) for p in places)).alias(value))


def look_up(splits: Sequence[tuple[str, DataFrame]], key: str, wanted: DataFrame) -> DataFrame:
    """Per wanted key, its row from the first split that has it, and the split's name."""
    both = None
    for rank, (name, df) in enumerate(splits):
        one = df.withColumns({"split": F.lit(name), "_rank": F.lit(rank)})
        both = one if both is None else both.unionByName(one)
    hits = both.join(wanted.select(key).distinct(), key, "left_semi")
    rest = [c for c in hits.columns if c not in (key, "_rank")]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def look_up_one(splits: Sequence[tuple[str, DataFrame]], key: str, value: object):
    """The row of one key; KeyError if no split has it."""
    spark = splits[0][1].sparkSession
    wanted = spark.createDataFrame([(value,)], f"{key} {splits[0][1].schema[key].dataType.simpleString()}")
    found = look_up(splits, key, wanted).head()
    if found is None:
        raise KeyError(value)
    return found


def mode(df: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """Per key: answer (the most frequent value; of equal ones the first seen) and votes.

    Two aggregates; the second has at most as many rows per key as there are distinct values.
    """
    counted = df.select(F.col(key), value.alias("answer"), F.col(order).alias("_o")).groupBy(key, "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("_o").alias("first"))
    best = F.max_by(F.struct("answer", "votes"), F.struct(F.col("votes"), -F.col("first")))
    return counted.groupBy(key).agg(best.alias("b")).select(key, "b.answer", "b.votes")


def in_batches(df: DataFrame, group: Sequence[str], order: str, size: int) -> DataFrame:
    """``df`` with batch: floor of the row's place in its group by the number ``order``, over ``size``."""
    return numbered(df, group, order, "_place").withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def shuffle_key(key: str, seed: int) -> Column:
    """A number of 60 bits that depends on the seed and the key only, as if drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed and rows, whatever the partitions."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """``df`` with place: all rows in an order that depends on the seed and the key only."""
    return numbered(df.withColumn("_drawn", shuffle_key(key, seed)), [], "_drawn", "place").drop("_drawn")
