"""Operator 12: importance resampling towards a target distribution, drawn without replacement.

Features are hashed word runs; a bucket's gain is the log ratio of its frequency in the target and in the
corpus. Each text's gains are added up in one array look-up. A Gumbel number per row turns weights into a
draw: the highest scores are taken. Every partition sorts its eligible rows into runs; runs are cut at
common bounds, and each range of scores is merged from its runs by a tournament tree that stops once the
exact number of draws has been given its ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, free_name, join_narrow, map_texts
from plumbline.llm.decontaminate import words_of

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Words whose hash a worker remembers; rows of one sorted run; rows of one merged range, and ranges at most.
MEMO, RUN_ROWS, RANGE_ROWS, MOST_RANGES = 1 << 18, 1 << 18, 1 << 14, 1 << 12
#: Evenly spaced entries of the runs, from which the bounds are taken, per range.
SAMPLES = 16

WEIGHTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
_memo: dict[bytes, int] = {}


def buckets_of(text: bytes | None, longest: int = LONGEST, size: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to ``longest`` consecutive words, repeats counted)."""
    words = words_of(text)
    if len(_memo) > MEMO:
        _memo.clear()
    hashes = []
    for w in words:
        h = _memo.get(w)
        if h is None:
            h = _memo[w] = zlib.crc32(w)
        hashes.append(h)
    found, last = [hashes], hashes
    for n in range(1, longest):  # a run's hash goes on from that of the run without its last word
        last = [zlib.crc32(b" " + w, h) for h, w in zip(last, words[n:], strict=False)]
        found.append(last)
    return len(words), np.fromiter((h for one in found for h in one), np.int64) % size


def bucket_counts(df: DataFrame, text: str, longest: int = LONGEST, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all texts. Counted where the texts lie: a task sends ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for a in range(0, len(batch), 64):
                for t in batch.column(0).slice(a, 64).cast(pa.binary()).to_pylist():
                    total += np.bincount(buckets_of(t, longest, size)[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    own = df.select(F.col(f"`{text}`").cast("string").alias("t"))
    out = np.zeros(size, np.int64)
    for r in own.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed frequency ratio) of every bucket."""
    size, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(df: DataFrame, text: str, gain: np.ndarray, longest: int = LONGEST, keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words, n_features and weight, the floored mean gain (0 without features). No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def compute(texts: list) -> dict[str, list]:
        own = shared.value
        found = [buckets_of(t, longest, len(own)) for t in texts]
        return {"n_words": [n for n, _ in found], "n_features": [len(b) for _, b in found], "weight": [int(own[b].sum()) // len(b) if len(b) else 0 for _, b in found]}

    return map_texts(df, text, compute, WEIGHTS, keep)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256 of ``seed:key`` (a null key reads ``null``)."""

    @F.arrow_udf("bigint")
    def drawn(h: pa.Array) -> pa.Array:
        return pa.array([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.to_pylist()], pa.int64())

    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return drawn(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"))


class Tournament:
    """A loser tree over sorted runs: each inner node keeps the loser of its match, so the next least entry costs one path."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.size = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.size
        self.winner = self._play(1) if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        first = self._before(a, b)
        self.losers[node] = b if first else a
        return a if first else b

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.size) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


# an entry of a run: the score downwards, null keys last, the key, the row
_ENTRY = np.dtype([("down", "<i8"), ("blank", "<i8"), ("key", "<i8"), ("row", "<i8")])


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(len(batch), _ENTRY)
    key = batch.column(1)
    out["down"], out["row"] = -batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    out["blank"], out["key"] = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
    return out


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """(run, n, entries) of (score, key, row): each partition's rows as sorted runs of RUN_ROWS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, nth, part = [], 0, 0, TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            run = np.sort(np.concatenate(held), order=_ENTRY.names)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + nth], pa.int64()), pa.array([len(run)], pa.int64()), pa.array([run.tobytes()], pa.binary())], names=["run", "n", "entries"])

        for batch in batches:
            held.append(_entries(batch))
            n += len(batch)
            if n >= RUN_ROWS:
                yield packed()
                held, n, nth = [], 0, nth + 1
        if n:
            yield packed()

    return rows.mapInArrow(run, "run long, n long, entries binary")


def _cut_at(runs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, run, n, entries): runs cut at the bounds; an entry equal to a bound lies before it."""
    shared = runs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [tuple(x) for x in shared.value.tolist()]
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["entries"], _ENTRY)
                ends, start = [], 0
                for m in marks:  # by halving; whole entries compare as tuples
                    lo, hi = start, len(own)
                    while lo < hi:
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if own[mid].item() <= m else (lo, mid)
                    ends.append(lo)
                    start = lo
                cuts = [0, *ends, len(own)]
                parts = [(p, own[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in parts], pa.int64()), pa.array([row["run"]] * len(parts), pa.int64()), pa.array([len(x) for _, x in parts], pa.int64()), pa.array([x.tobytes() for _, x in parts], pa.binary())],
                    names=["part", "run", "n", "entries"],
                )

    return runs.mapInArrow(run, "part long, run long, n long, entries binary")


def _samples(runs: DataFrame, step: int) -> np.ndarray:
    """Entries at every ``step``-th place of each run, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(blob, _ENTRY)[step - 1 :: step].tobytes()], pa.binary())], names=["some"])

    found = [np.frombuffer(r.some, _ENTRY) for r in runs.select("entries").mapInArrow(run, "some binary").toLocalIterator()]
    return np.sort(np.concatenate([np.zeros(0, _ENTRY), *found]), order=_ENTRY.names)


def ranked(rows: DataFrame, draws: int, total: int) -> DataFrame:
    """(row, rank): ranks 1 to ``draws`` of (score, key, row), highest score first, then the smaller key, then the row.

    ``total`` is the number of rows, all distinct in ``row``; ``rows`` must lie still (a table that ``cut`` returned).
    A range is merged in a task of its own: about RANGE_ROWS entries, and more only beyond RANGE_ROWS *
    MOST_RANGES rows. The driver gets one entry in RANGE_ROWS / SAMPLES and one count per range.
    """
    spark = rows.sparkSession
    runs = cut(_sorted_runs(rows))
    wanted = min(MOST_RANGES, -(-total // RANGE_ROWS))
    size = max(1, -(-total // max(1, wanted)))
    some = _samples(runs, max(1, size // SAMPLES))
    bounds = some[SAMPLES - 1 :: SAMPLES]
    parts = cut(_cut_at(runs, bounds))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("start"))  # a row per range
    taken = parts.join(F.broadcast(starts), "part").where(F.col("start") < draws)

    def merge(table: pa.Table) -> pa.Table:
        start = table["start"][0].as_py()
        most = draws - start
        blocks = [np.frombuffer(x, _ENTRY) for x in table["entries"].to_pylist()]
        entries = Tournament(iter(x.tolist()) for x in blocks)
        drawn = [e[3] for e, _ in zip(entries, range(most), strict=False)]
        return pa.table({"row": pa.array(drawn, pa.int64()), "rank": pa.array(range(start + 1, start + 1 + len(drawn)), pa.int64())})

    if draws <= 0:
        return spark.createDataFrame([], "row long, rank long")
    return taken.groupBy("part").applyInArrow(merge, "row long, rank long")


def resampled(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, size: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns in ``keep``) with n_words, n_features, weight, score and rank.

    Of the N rows of at least ``least_words`` words, floor(percent * N / 100) get a rank from 1 on; rank is null for
    the others. A null or wordless text has no features, weight 0, and is never drawn if ``least_words`` is over 0.
    ``key`` is a whole number; a null one draws as ``null`` and stands last among equal scores; repeated rows
    are told apart by where they lie. An empty target or table gives gains from the smoothing alone, or no rows.
    New columns replace input columns of the same name.
    """
    gain = gains(bucket_counts(df, text, longest, size), bucket_counts(target, target_text, longest, size))
    fresh = {*WEIGHTS.names, "score", "rank"}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    row, own = free_name(df, "row"), free_name(df, "own_key")
    rows = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])), F.col(f"`{key}`").cast("long").alias(own))
    scored = weighed(rows, text, gain, longest, [*kept, own]).withColumn("score", F.col("weight") + gumbel(F.col(own), seed))
    scored = cut(scored.withColumn(row, F.monotonically_increasing_id()))
    eligible = scored.where(F.col("n_words") >= least_words).select("score", F.col(own).alias("key"), F.col(row).alias("row"))
    total = eligible.count()
    ranks = cut(ranked(eligible, percent * total // 100, total).withColumnRenamed("row", row))
    return join_narrow(scored, ranks, [row], "left").select(*(F.col(f"`{c}`") for c in kept), *WEIGHTS.names, "score", "rank")
