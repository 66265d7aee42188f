"""Operator 6: packing by minimum bin slack.

Lengths of pieces are counted over the whole corpus. For each window, the longest piece that is left
is set, and a subset-sum over bitsets of reachable fill levels picks the multiset of remaining lengths
that comes closest to the capacity; walking the bitsets back gives how many of each length. The same
multiset serves as many windows as its counts allow, so the plan grows with the number of lengths, not
with the number of pieces. Spark then numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, free_name, key_name, lean, numbered
from plumbline.llm.tokens import ended, load, text_steps

CAPACITY = 2048
END_ID = 1


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``room`` as can be, never above."""
    goal, reach, trail = 1 << room, 1, []
    mask = (goal << 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, most, step = reach, min(counts[length], room // length), 1
        while most > 0:  # counts in binary parts
            take = min(step, most)
            reach |= (reach << (take * length)) & mask
            most, step = most - take, step * 2
        trail.append((length, before))
        if reach & goal:
            break
    level, taken = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        while not before >> level & 1:
            level -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(count of each length in a window, number of such windows) until all pieces are placed."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        others = left | {longest: left[longest] - 1}
        chosen = fill(capacity - longest, others)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((chosen, times))
    return out


def places(made: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces per sequence, first offset), by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    base = 0
    for chosen, times in made:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), base, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(df: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``df`` (pieces with a length of 1 to ``capacity``) with sequence_id and offset.

    Every piece gets one place; in a sequence, offsets are gapless from 0 and reach at most
    ``capacity``. ``order`` should tell the pieces apart; equal rows are interchangeable. A row whose
    length is null, below 1 or above ``capacity`` fits no sequence: it stays, with a null sequence_id
    and offset. The counts of lengths (at most ``capacity`` rows) and the plan made from them are all
    that passes through the driver. No rows give no rows; other columns pass, nulls too, and columns
    named like the new ones are replaced.
    """
    # the pieces may come from a tokenizer: they are made once, before anything samples their order
    df = cut(df.drop("sequence_id", "offset"))
    rank, fits = free_name(df, "rank_of_length"), F.coalesce(F.col(f"`{length}`").between(1, capacity), F.lit(False))
    ranked = numbered(df, [length], [*order, length], rank)
    counts = {int(r[0]): int(r[1]) for r in ranked.where(fits).groupBy(length).agg(F.count(F.lit(1))).collect()}
    table = df.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            size, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            seq, off = np.zeros_like(r), np.zeros_like(r)
            for x in np.unique(size):
                own = size == x
                rows = table.value[int(x)]
                start, base, n, first = rows[np.searchsorted(rows[:, 0], r[own], "right") - 1].T
                k = r[own] - start
                seq[own], off[own] = base + k // n, first + k % n * x
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    at = free_name(df, "place")
    placed = ranked.where(fits).withColumn(at, place(F.col(length), F.col(rank)))
    nowhere = F.lit(None).cast("long")
    rest = df.where(~fits).select(*(F.col(f"`{c}`") for c in df.columns), nowhere.alias("sequence_id"), nowhere.alias("offset"))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), f"{at}.sequence_id", f"{at}.offset").unionByName(rest)


def token_pieces(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The texts' ids and an end id, cut every ``capacity`` ids: key, start, length, doc_tokens, ids_crc32, ids.

    A null text is empty and gives its end id alone. ids (array of int) is left out unless
    ``with_ids``; ids_crc32 is over them as little-endian unsigned 32-bit integers. A key named like a
    new column comes back as ``<key>_of_input``.
    """
    name = key_name(key, ("start", "length", "doc_tokens", "ids_crc32", "ids"))
    source = df.select(F.col(f"`{key}`").alias(name), F.col(f"`{text}`").cast("string").alias("_text"))
    fields = [source.schema[0], *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in text_steps(texts):
                ids, ends = ended(*load(tokenizer).encode(texts.slice(a, b - a)), end_id)
                tokens = np.diff(ends, prepend=0)
                n = -(-tokens // capacity)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                first = (ends - tokens)[doc] + start
                length = np.minimum(capacity, tokens[doc] - start)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k in zip(first.tolist(), length.tolist(), strict=True)]
                cols = [keys.take(pa.array(doc + a)), pa.array(start), pa.array(length), pa.array(tokens[doc]), pa.array(crc, pa.int64())]
                if with_ids:  # the pieces cover all ids in order
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return source.mapInArrow(lambda batches: lean(run(batches)), T.StructType(fields))


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Padded sequences (sequence_id, ids) from placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    joined = placed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
    return joined.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))))
