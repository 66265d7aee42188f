"""Operator 9: token ids in binary blocks with Elias-Fano encoded document boundaries.

A block is one row of a written table: the ids of some documents, one after the other, and two
Elias-Fano sequences, the end of each document in the block and the document keys. An Elias-Fano
sequence of n values up to u takes about n * (2 + log2(u / n)) bits; its select structure gives any
value without decoding the others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import shared_folder
from plumbline.llm.tokens import ended, load, text_steps

END_ID = 1
#: Ids in a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
#: Every so many ones, the select structure remembers a position.
SAMPLE = 64

# Ones in a byte, and where the k-th one of a byte stands.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ONES = _BITS.sum(axis=1)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")

BLOCK = T.StructType(
    [
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_keyless", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("keys", T.BinaryType()),
    ]
)


#: Values whose low bits are spread out at a time; a multiple of 8.
SLICE = 1 << 13


class EliasFano:
    """A sequence of integers that never falls, in near-minimal space."""

    def __init__(self, data: bytes):
        self.n, self.base, self.low_bits, n_low, n_high = struct.unpack_from("<qqqqq", data)
        at = 40
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", -1, at + n_low + n_high)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """``values``: int64, ascending; ties are allowed. The first is the base of the others."""
        values = np.asarray(values, np.int64)
        n, base = len(values), int(values[0]) if len(values) else 0
        rest = (values - base).view(np.uint64)
        top = int(rest[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        # in slices of whole bytes: a slice's bits take low_bits numbers a value
        parts = [np.packbits(((rest[a : a + SLICE, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, SLICE)]
        low = np.concatenate([np.zeros(0, np.uint8), *parts])
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        return struct.pack("<qqqqq", n, base, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), SLICE):
            bit = i[a : a + SLICE, None] * self.low_bits + np.arange(self.low_bits)
            found = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            out[a : a + SLICE] = (found.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``, each from the nearest remembered position on; other values are not decoded."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("no such value")
        at = self.samples[i // SAMPLE].astype(np.int64)
        # ones still to pass, counted from the start of the byte that holds the remembered one
        byte = at >> 3
        left = i % SAMPLE + _ONES[self.high[byte] & ((1 << (at & 7)) - 1)] if len(i) else i
        live = np.flatnonzero(left >= _ONES[self.high[byte]])
        while len(live):
            left[live] -= _ONES[self.high[byte[live]]]
            byte[live] += 1
            live = live[left[live] >= _ONES[self.high[byte[live]]]]
        one = (byte << 3) + _PLACE[self.high[byte], left]
        return self.base + ((one - i) << self.low_bits | self._low(i))

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return self.base + ((ones - i) << self.low_bits | self._low(i))


def write_blocks(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes whole texts and writes their ids as blocks at ``path``, in ascending order of the long ``key``.

    Ids are 16-bit where the vocabulary allows, else 32-bit, little-endian (the width follows from
    n_ids and the bytes). Each document ends with ``end_id``; a null text is empty. Rows of one key
    stay neighbours; rows with a null key stand before all others. Texts are dealt by range of key, so
    that parts in order hold keys in order. No rows give an empty table. Other columns are not read.
    """
    source = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("tie", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), load(tokenizer)
        kind = "<u2" if encode.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        block = total = 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            ends, own = np.cumsum(np.concatenate(sizes)), pa.concat_arrays(keys)
            known = own.drop_null().to_numpy(zero_copy_only=False)
            ids = np.concatenate(held).astype(kind).tobytes()
            row = [part, block, len(own), own.null_count, int(ends[-1]), ids, EliasFano.encode(ends), EliasFano.encode(known)]
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=BLOCK.names)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b in text_steps(texts):
                ids, ends = ended(*encode.encode(texts.slice(a, b - a)), end_id)
                first = 0
                while first < len(ends):
                    before = int(ends[first - 1]) if first else 0
                    last = int(np.searchsorted(ends, before + block_ids - total, "right"))
                    if last == first and total:  # the next document does not fit any more
                        yield flush()
                        held, sizes, keys, total, block = [], [], [], 0, block + 1
                        continue
                    last = max(last, first + 1)
                    after = int(ends[last - 1])
                    held.append(ids[before:after])
                    sizes.append(np.diff(ends[first:last], prepend=before))
                    keys.append(names.slice(a + first, last - first))
                    total, first = total + after - before, last
        if total:
            yield flush()

    dealt.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def read_blocks(df: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of written blocks: key, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    Where a document starts and ends comes from the select structure of its block's boundaries.
    """
    sizes = df.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("part", before.alias("part_start"))  # one narrow row per written part
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inner_start")).join(parts, "part")
    first = heads.select("part", "block", (F.col("part_start") + F.col("inner_start")).alias("first"))
    fields = [T.StructField(n, T.LongType()) for n in ("key", "start", "n_tokens", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, n_ids, n_keyless, ids, ends, keys = (batch.column(i)[row].as_py() for i in range(7))
                ends, keys = EliasFano(ends), EliasFano(keys)
                end = ends.select(np.arange(ends.n))
                begin = np.concatenate([[0], end[:-1]])
                whole = np.frombuffer(ids, f"<u{len(ids) // n_ids}").astype("<u4")
                data = memoryview(whole.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                named = pa.concat_arrays([pa.nulls(n_keyless, pa.int64()), pa.array(keys.select(np.arange(keys.n)), pa.int64())])
                cols = [named, pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1]).astype(np.int32)), pa.array(whole.astype(np.int32))))
                place = [pa.array(np.full(len(end), x, np.int32)) for x in (part, block)]
                yield pa.RecordBatch.from_arrays([*place, *cols], names=["part", "block", *(f.name for f in fields)])

    wide = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), *fields])
    docs = df.select("part", "block", "n_ids", "n_keyless", "ids", "ends", "keys").mapInArrow(run, wide)
    joined = docs.join(first, ["part", "block"])
    return joined.select("key", (F.col("first") + F.col("start")).alias("start"), *(f.name for f in fields[2:]))


def block_path(spark: SparkSession) -> str:
    """A new folder for blocks under the session's shared checkpoint folder."""
    return f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
