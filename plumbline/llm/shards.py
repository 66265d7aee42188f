"""Operator 3: sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone; there is no ring table. With
one shard more, a row either stays or moves into the new shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, free_name, numbered

# Fixed values of the published algorithm (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards 0 to n - 1 of 64-bit keys; all keys take their jumps together."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        span = float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((shard[live] + 1).astype(np.float64) * span).astype(np.int64)
        live = live[ahead[live] < n]
    return shard


def jump_shard(key: Column, n: int) -> Column:
    """Shard (int) of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(jump(s.to_numpy(np.int64), n).astype(np.int32))

    return shard(F.coalesce(key, F.lit(0).cast("long")))


def stable_key(df: DataFrame, key: str) -> Column:
    """Integral keys as they are, others by a 64-bit hash."""
    return F.col(f"`{key}`").cast("long") if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(f"`{key}`")


def assign_shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with ``shard`` (for n shards) and ``grown_shard`` (for n + 1). No shuffle.

    Keys that are null go where key 0 goes. Rows of one key always share a shard. An input column
    with the name of a new one is replaced. n is 1 or more.
    """
    if n < 1:
        raise ValueError("at least one shard is needed")
    at = stable_key(df, key)
    return df.select(
        *(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "grown_shard")),
        jump_shard(at, n).alias("shard"),
        jump_shard(at, n + 1).alias("grown_shard"),
    )


def place(df: DataFrame, key: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """``assign_shards`` plus ``slot``: the row's place in its shard, gapless from 0, by key and ``ties``.

    Carry narrow columns only: the rows are dealt out again by range of key, so that no shard is
    ordered in a single task. Repeated rows take slots of their own; an empty table gives no rows.
    """
    put = cut(assign_shards(df.drop("slot"), key, n))
    return numbered(put, ["shard"], [key, *(ties or [])], "slot")


def manifest(df: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, size (UTF-8 bytes and 1 for the row; a null text has none) and text_crc32 (unsigned)."""
    name = free_name(df, "t")
    return df.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(name)).select(
        F.col(f"`{key}`"), (F.octet_length(name) + 1).cast("long").alias("size"), F.crc32(F.encode(name, "UTF-8")).alias("text_crc32")
    )
