"""Relations within vector groups: messages over all pairs by an edge function, then a node function.

The edge function's first layer reads two vectors side by side, W [xi; xj] = A xi + B xj. So both products are
made once per vector, and a pair costs one addition per hidden number: no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as v
from plumbline.operators.tensor import top_k


@dataclass(frozen=True)
class Layer:
    """weight @ x + bias; ``weight`` is (out, in)."""

    weight: np.ndarray
    bias: np.ndarray


def updated(x: np.ndarray, ends: np.ndarray, edge: tuple[Layer, Layer], node: tuple[Layer, Layer], residual: bool) -> np.ndarray:
    """The update of the vectors (rows of ``x``) of groups that end at ``ends``: x + node([x, mean_j edge([xi, xj])]), j = i too."""
    dim = x.shape[1]
    a, b = edge[0].weight[:, :dim], edge[0].weight[:, dim:]
    own, other = x @ a.T + edge[0].bias, x @ b.T
    mean = np.empty_like(own)
    start = 0
    for end in ends.tolist():
        mean[start:end] = np.maximum(own[start:end, None] + other[None, start:end], 0).mean(axis=1)
        start = end
    message = mean @ edge[1].weight.T + edge[1].bias  # the second layer is linear, so it follows the mean
    hidden = np.maximum(np.concatenate([x, message], axis=1) @ node[0].weight.T + node[0].bias, 0)
    out = hidden @ node[1].weight.T + node[1].bias
    return x + out if residual else out


def relation_update(df: DataFrame, group: str, order: str, vector: str, k: int, edge: tuple[Layer, Layer], node: tuple[Layer, Layer], residual: bool = True) -> DataFrame:
    """(group, slot, vector) of the first ``k`` rows of each group by ``order``.

    Edge and node functions are two layers with a ReLU between. A group's vectors stand in one row (k at most); many
    groups share an Arrow batch and its products. Layers are closed over: a few matrices of the vector's width.
    A group of one row has only the message of itself to itself. Rows with a null vector are left out.
    """
    kept = top_k(df.where(F.col(vector).isNotNull()), group, order, k).select(group, F.col("slot").cast("int").alias("slot"), v.doubles(F.col(vector)).alias("x"))
    rows = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("r")).select(group, F.col("r.slot").alias("slots"), F.col("r.x").alias("xs"))
    schema = T.StructType([rows.schema[group], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("xs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(2)
            sizes = pa.compute.list_value_length(lists).to_numpy()
            x = lists.flatten().flatten().to_numpy(zero_copy_only=False)
            made = updated(x.reshape(int(sizes.sum()), -1), np.cumsum(sizes), edge, node, residual)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
            outer = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), outer], names=schema.names)

    found = rows.mapInArrow(run, schema)
    return found.select(group, F.explode(F.arrays_zip("slots", "xs")).alias("p")).select(group, F.col("p.slots").alias("slot"), F.col("p.xs").alias(vector))
