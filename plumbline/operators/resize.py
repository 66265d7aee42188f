"""Bilinear resampling of images that stand as arrays, one product per axis for a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def axis_weights(size: int, to: int, align_corners: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, share): output place i reads ``first[i]`` and ``second[i]``, the second with weight ``share[i]``.

    Without ``align_corners`` pixels are areas: place i looks at (i + 1/2) * size / to - 1/2, held inside the
    image. With it, the first and last pixels' centres stay where they are (one output pixel reads the first).
    """
    if size < 1 or to < 1:
        raise ValueError("an image has at least one pixel along each axis")
    if align_corners:
        at = np.arange(to) * ((size - 1) / (to - 1) if to > 1 else 0.0)
    else:
        at = np.clip((np.arange(to) + 0.5) * (size / to) - 0.5, 0, size - 1)
    first = np.minimum(np.floor(at).astype(np.int64), size - 1)
    return first, np.minimum(first + 1, size - 1), at - first


def resized(x: np.ndarray, height: int, width: int, align_corners: bool = False) -> np.ndarray:
    """Images (n, channels, h, w) at the new height and width."""
    for axis, to in ((2, height), (3, width)):
        first, second, share = axis_weights(x.shape[axis], to, align_corners)
        shape = [1, 1, 1, 1]
        shape[axis] = to
        share = share.reshape(shape)
        x = x.take(first, axis=axis) * (1 - share) + x.take(second, axis=axis) * share
    return x


def resize_images(df: DataFrame, key: str, pixels: str, shape: tuple[int, int, int], height: int, width: int, align_corners: bool = False) -> DataFrame:
    """(key, pixels): images of ``shape`` (channels, height, width), stored row by row, at the new size; in double.

    No shuffle. A null image stays null; one of another length is an error that names both lengths.
    """
    long = int(np.prod(shape))
    source = df.select(key, F.col(pixels).cast("array<double>").alias(pixels))
    schema = T.StructType([source.schema[key], T.StructField(pixels, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(lists.drop_null()).to_numpy(zero_copy_only=False)
            if (sizes != long).any():
                raise ValueError(f"an image has {sizes[sizes != long][0]} numbers, not {long}")
            made = resized(lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape), height, width, align_corners)
            ends = np.cumsum(there * (shape[0] * height * width))
            offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(~there, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], names=schema.names)

    return source.mapInArrow(run, schema)
