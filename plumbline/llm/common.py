"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one Python step works on at a time.
STEP_BYTES = 8 << 20
#: Bytes of a narrow table that is broadcast, and bytes that one of its rows takes beside its strings.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset on a master of one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the session's shared checkpoint folder, with the lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Hands memory that this Python worker has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last one, what the task has freed goes back to the machine."""
    try:
        yield from made
    finally:
        give_back()


def emptied(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Puts an empty table in the place of one in the shared folder that nothing reads any more."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where one of them may hold much of ``left``.

    A side that was grouped by the keys is already dealt by them, and then Spark cannot split a hot
    partition of the join. A hash of the keys as one more key makes it deal both sides anew.
    """
    deal = free_name(left, "deal")
    a, b = left.withColumn(deal, F.xxhash64(*keys)), right.withColumn(deal, F.xxhash64(*keys))
    return a.join(b, [deal, *keys], how).drop(deal)


def join_narrow(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with ``right``, a table that ``cut`` returned and that has a few numbers a row.

    It is measured first and broadcast up to BROADCAST_BYTES; a larger one is joined by ``join_hot``.
    """
    long = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, t in right.dtypes if t in ("string", "binary")]
    measured = right.agg(F.sum(reduce(lambda a, b: a + b, long, F.lit(ROW_BYTES))).alias("n")).first()["n"] or 0
    return left.join(F.broadcast(right), keys, how) if measured <= BROADCAST_BYTES else join_hot(left, right, keys, how)


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes over all columns. Hashes cannot read maps and variants, however deep they lie; those
    columns count as their JSON text."""
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    return [F.xxhash64(*parts), F.hash(*parts)]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_name(key: str, fresh: Iterable[str]) -> str:
    """The name of a key in a result: its own, or ``<key>_of_input`` where a new column has that name (in any case)."""
    return f"{key}_of_input" if key.lower() in {n.lower() for n in fresh} else key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(sizes: Iterable[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows of these sizes into ranges of about ``limit`` bytes; a larger row is alone in its range."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if end > start:
        yield start, end


def map_texts(
    df: DataFrame,
    text: str,
    compute: Callable[[list], dict[str, list]],
    out: T.StructType,
    keep: list[str] | None = None,
    step_bytes: int = STEP_BYTES,
    as_bytes: bool = True,
) -> DataFrame:
    """``df``'s columns (or those in ``keep``) with the columns that ``compute`` gets from the texts.

    ``compute`` gets whole texts (UTF-8 ``bytes`` or ``str``; None for null), about ``step_bytes`` at
    a time, and returns one list per field of ``out``. A column of ``df`` that has the name of a new
    one (in any case) is replaced by it. No shuffle: every row stays in its partition.
    """
    fresh = {f.name.lower() for f in out.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    sent = kept + [text] * (text not in kept)
    source = df.select(*(F.col(f"`{c}`") for c in sent))
    schema = T.StructType([*(source.schema[c] for c in kept), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in out.fields]
        names = [*kept, *(f.name for f in out.fields)]
        yield from lean(made(batches, kinds, names))

    def made(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()] if len(column) else []
            for a, b in steps([s + 64 for s in sizes], step_bytes):
                part = column.slice(a, b - a)
                got = compute((part.cast(pa.binary()) if as_bytes else part).to_pylist())
                cols = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(got[f.name], kind) for f, kind in zip(out.fields, kinds, strict=True)], names=names
                )

    return source.mapInArrow(run, schema)


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each value of ``keys``, in the order of ``order``.

    No key is gathered in one task: rows are dealt by range of ``order`` into chunks, rows are
    numbered within (key, chunk), and each chunk starts where the chunks before it end. Equal rows are
    told apart by where they lie, so that no value of ``order`` is gathered either. ``df`` must be a
    table that ``cut`` returned, or columns of one. Carry only narrow columns here.
    """
    spark = df.sparkSession
    chunk, pos, before, tie = (free_name(df, c) for c in ("chunk", "pos", "before", "tie"))
    by = [*order, tie]
    told = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = told.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).drop(tie)
    dealt = cut(dealt.withColumn(chunk, F.spark_partition_id()).withColumn(pos, F.monotonically_increasing_id()))
    counts = dealt.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias(before))
    running = F.sum(before).over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn(before, F.coalesce(running, F.lit(0)))
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(pos)).cast("long"))
    same = [local[k].eqNullSafe(starts[k]) for k in keys] + [local[chunk] == starts[chunk]]
    joined = local.join(starts, same, "inner")
    return joined.select(
        *(local[c] for c in df.columns if c != name), (local[name] - 1 + starts[before]).alias(name)
    )
