"""Operator 11: exact k-means with Drake's adaptive bounds over integer vectors.

Every vector keeps an upper bound on the distance to its centroid, lower bounds on the distances to its next
nearest centroids and one remainder bound for all others. When centroids move, bounds move with them; only
where they cannot certify the order are distances computed again, and just for the centroids in question.
All distances that decide anything are exact integers, so the result is that of the plain algorithm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import emptied, shared_folder

#: Vectors in one packed row; components stand below LARGEST, so that every squared distance fits a long.
BLOCK, SCALE, LARGEST = 4096, 1024, 1 << 27
#: Room for the rounding of bounds (they are doubles).
SLACK = 1e-9
#: Lower bounds that a vector starts with, as a part of k, and the least number of them.
FIRST_SHARE, LEAST_BOUNDS = 2, 1

_BLOB = T.BinaryType()
STATE = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("x", _BLOB), T.StructField("own", _BLOB), T.StructField("upper", _BLOB),
        T.StructField("near", _BLOB), T.StructField("lower", _BLOB), T.StructField("rest", _BLOB),
        T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("asked", T.IntegerType()),
        T.StructField("computed", T.LongType()),
    ]
)
ASSIGNED = T.StructType([T.StructField("key", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c`` (int64)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - one) ** 2).sum(1) for one in c.astype(np.int64)], axis=1)


@dataclass
class Bounds:
    """Of n vectors: own centroid, upper bound on its distance, ``near`` centroids with lower bounds, remainder bound."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    @staticmethod
    def scanned(d: np.ndarray, b: int) -> Bounds:
        """Tight bounds from all distances; ties go to the smaller centroid number."""
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        rest = root[:, b + 1] if d.shape[1] > b + 1 else np.full(len(d), np.inf)
        return Bounds(order[:, 0].astype(np.int32), root[:, 0], order[:, 1 : b + 1].astype(np.int32), root[:, 1 : b + 1], rest)

    def moved(self, drift: np.ndarray, b: int) -> None:
        """Bounds after the centroids moved by ``drift``; lower bounds beyond the first ``b`` fall into the remainder."""
        self.upper = self.upper + drift[self.own]
        self.lower = self.lower - drift[self.near]
        self.rest = self.rest - drift.max(initial=0)
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]

    def doubt(self) -> np.ndarray:
        """How many of the near centroids may be as close as the own one; near's width + 1 if even the others may."""
        beyond = np.concatenate([self.lower, self.rest[:, None]], axis=1)
        beyond = np.minimum.accumulate(beyond[:, ::-1], axis=1)[:, ::-1]
        open_ = ~(self.upper[:, None] * (1 + SLACK) + SLACK < beyond * (1 - SLACK))
        return open_.sum(axis=1)  # bounds do not fall towards the end, so these are the first ones

    def put(self, at: np.ndarray, other: Bounds) -> None:
        self.own[at], self.upper[at], self.near[at], self.lower[at], self.rest[at] = other.own, other.upper, other.near, other.lower, other.rest


def reassigned(x: np.ndarray, c: np.ndarray, bounds: Bounds | None, drift: np.ndarray | None, b: int) -> tuple[Bounds, int, int]:
    """(bounds, most near centroids asked for, distances computed) after an assignment to the centroids ``c``."""
    n, k = len(x), len(c)
    if bounds is None:
        return Bounds.scanned(distances(x, c), b), 0, n * k
    bounds.moved(drift, b)
    computed, asked = 0, 0
    unsure = np.flatnonzero(bounds.doubt())
    if len(unsure):  # a tight upper bound settles many
        diff = x[unsure].astype(np.int64) - c[bounds.own[unsure]]
        bounds.upper[unsure] = np.sqrt((diff * diff).sum(1).astype(np.float64))
        computed += len(unsure)
    need = bounds.doubt()
    for p in np.unique(need[need > 0]).tolist():
        at = np.flatnonzero(need == p)
        if p > bounds.near.shape[1]:
            bounds.put(at, Bounds.scanned(distances(x[at], c), b))
            computed += len(at) * k
            continue
        asked = max(asked, p)
        few = np.sort(np.concatenate([bounds.own[at][:, None], bounds.near[at][:, :p]], axis=1), axis=1)
        d = np.stack([((x[at].astype(np.int64) - c[few[:, j]]) ** 2).sum(1) for j in range(p + 1)], axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        few, root = np.take_along_axis(few, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        bounds.own[at], bounds.upper[at] = few[:, 0], root[:, 0]
        near, lower = bounds.near[at], bounds.lower[at]
        near[:, :p], lower[:, :p] = few[:, 1:], root[:, 1:]
        bounds.near[at], bounds.lower[at] = near, lower
        computed += d.size
    return bounds, asked, computed


def kept_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, x): floor(SCALE * component) of the vectors of exactly ``dims`` finite components below LARGEST / SCALE."""
    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    kept = own.where(F.col("v").isNotNull() & (F.size("v") == dims)).where(F.coalesce(fine, F.lit(False)))
    return kept.select("key", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int")).alias("x"))


def _packed(kept: DataFrame, dims: int) -> DataFrame:
    """Vectors in rows of up to BLOCK, as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return kept.mapInArrow(run, "ids array<long>, x binary")


def _read(row: dict, dims: int) -> tuple[np.ndarray, Bounds | None]:
    x = np.frombuffer(row["x"], np.int32).reshape(-1, dims)
    if row.get("own") is None:
        return x, None
    n, of = len(x), lambda name, kind: np.frombuffer(row[name], kind).copy()
    return x, Bounds(of("own", np.int32), of("upper", np.float64), of("near", np.int32).reshape(n, -1), of("lower", np.float64).reshape(n, -1), of("rest", np.float64))


def _assigned(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, b: int) -> DataFrame:
    """The state after an assignment, with the sums and counts of each cluster per block."""
    shared, dims = state.sparkSession.sparkContext.broadcast((c, drift)), c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        c, drift = shared.value
        schema = to_arrow_schema(STATE)
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                x, bounds = _read(row, dims)
                bounds, asked, computed = reassigned(x, c, bounds, drift, b)
                sums = np.zeros((len(c), dims), np.int64)
                for j in range(len(c)):
                    sums[j] = x[bounds.own == j].sum(axis=0, dtype=np.int64)
                out = {
                    "ids": row["ids"], "x": row["x"], "own": bounds.own.tobytes(), "upper": bounds.upper.tobytes(), "near": bounds.near.tobytes(), "lower": bounds.lower.tobytes(),
                    "rest": bounds.rest.tobytes(), "sums": sums.ravel(), "counts": np.bincount(bounds.own, minlength=len(c)), "asked": asked, "computed": computed,
                }
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return state.mapInArrow(run, STATE)


def _final(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, b: int) -> DataFrame:
    """(key, cluster, distance) of every vector after the last assignment."""
    shared, dims = state.sparkSession.sparkContext.broadcast((c, drift)), c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, drift = shared.value
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                x, bounds = _read(row, dims)
                bounds, _, _ = reassigned(x, c, bounds, drift, b)
                diff = x.astype(np.int64) - c[bounds.own]
                cols = [pa.array(row["ids"], pa.int64()), pa.array(bounds.own, pa.int32()), pa.array((diff * diff).sum(1), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=ASSIGNED.names)

    return state.mapInArrow(run, ASSIGNED)


def _totals(state: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int], int]:
    """Exact sums and counts per cluster (k * dims numbers reach the driver) and the most bounds any vector asked for."""
    wide = lambda name: state.select(F.posexplode(name).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums, counts = [0] * (k * dims), [0] * k
    for r in wide("sums"):
        sums[r.at] = int(r.v)
    for r in wide("counts"):
        counts[r.at] = int(r.v)
    asked = state.agg(F.max("asked")).first()[0] or 0
    return [sums[j * dims : (j + 1) * dims] for j in range(k)], counts, asked


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the least sha256 of ``seed:key`` (a null key reads ``null``), equal ones by their components."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    rows = kept.select(drawn.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every kept vector, the final centroids).

    Vectors that are null, of another length, or hold a null, non-finite or huge (LARGEST / SCALE and more)
    component are left out; repeated rows count each; a null key is kept; fewer than k vectors start fewer
    centroids; an empty table gives no rows and no centroids. Each round is one pass over packed rows in
    the shared folder: vectors with their bounds are read and written, and only sums of k * dims numbers
    reach the driver. A round's table is emptied once the next one is written.
    """
    spark = df.sparkSession
    kept = kept_vectors(df, key, vector, dims)
    c = first_centroids(kept, k, seed)
    if not len(c):
        return spark.createDataFrame([], ASSIGNED), c
    folder, state, before, drift = f"{shared_folder(spark)}/drake-{uuid.uuid4().hex}", _packed(kept, dims), None, None
    b = min(len(c) - 1, max(LEAST_BOUNDS, len(c) // FIRST_SHARE))
    for r in range(rounds):
        path = f"{folder}/{r}"
        _assigned(state, c, drift, b).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if before is not None:
            emptied(spark, before, STATE)
        before = path
        sums, counts, asked = _totals(state, len(c), dims)
        new = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, c, strict=True)], np.int64)
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64))
        c = new
        if r:  # the first round asks for nothing
            b = min(b, max(LEAST_BOUNDS, asked))
    return _final(state, c, drift, b), c
