"""Operator 2: benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words: a pattern is a window of benchmark words, a block is its last BLOCK words. A
shift table over blocks skips positions where no pattern can end, a suffix hash leads to the few
patterns that end in the block found, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, free_name, map_texts

WINDOW = 10
BLOCK = 2
#: Different windows, and bytes of them, that one pass over the documents holds; a larger benchmark takes more passes.
#: A window takes about one kilobyte in the tables of each worker, beside its bytes.
PASS_WINDOWS, PASS_BYTES = 1 << 18, 64 << 20

_UPPER = bytes(range(0x41, 0x5B))
_OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_UPPER + _OTHER, _UPPER.lower() + b" " * len(_OTHER))

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, all other ASCII but a-z and digits parts words."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Tables for patterns of one length: shifts and suffix buckets by block."""

    def __init__(self, length: int, patterns: dict[tuple, list[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list[tuple[tuple, list[str]]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), length - end)
            # within a bucket, the first word is the prefix that selects the patterns to compare
            self.bucket.setdefault(p[-self.block :], {}).setdefault(p[0], []).append((p, items))

    def find(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """(start, items) of every occurrence, by start."""
        n, m, size, default = len(words), self.length, self.block, self.default
        shift, end = self.shift.get, self.length
        while end <= n:
            block = tuple(words[end - size : end])
            step = shift(block, default)
            if step:
                end += step
                continue
            start = end - m
            for p, items in self.bucket[block].get(words[start], ()):
                if tuple(words[start:end]) == p:
                    yield start, items
            end += 1


def windows_of(text: bytes | None) -> list[bytes]:
    """The windows of WINDOW words of an item, each joined by spaces; a shorter item is one window."""
    words = words_of(text)
    m = min(WINDOW, len(words))
    return [b" ".join(words[i : i + m]) for i in range(len(words) - m + 1 if m else 0)]


def build(windows: Iterable[tuple[bytes, list[str]]]) -> list[WuManber]:
    """Search tables for (window, ids of the items that have it), one for each length."""
    by_length: dict[int, dict[tuple, list[str]]] = {}
    for window, items in windows:
        words = tuple(window.split())
        by_length.setdefault(len(words), {})[words] = items
    return [WuManber(m, found) for m, found in sorted(by_length.items())]


def patterns(items: DataFrame) -> DataFrame:
    """(window, items): the different windows of (item, body), with the sorted ids of the items that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                found = list(dict.fromkeys(windows_of(body.as_py())))
                for a in range(0, len(found), 1 << 14):  # an item of any length
                    part = found[a : a + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item.as_py()] * len(part), pa.string())], names=["window", "item"])

    made = items.select("item", "body").mapInArrow(run, "window binary, item string")
    return made.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def spans(covered: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The ranges as a sorted union."""
    out: list[list[int]] = []
    for a, b in sorted(covered):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def scan(df: DataFrame, windows: Iterable[tuple[bytes, list[str]]], text: str, keep: list[str] | None) -> DataFrame:
    tables = df.sparkSession.sparkContext.broadcast(build(windows))

    def compute(texts: list) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "hits": [], "items": []}
        for t in texts:
            words, covered, found = words_of(t), [], set()
            for one in tables.value:
                for start, names in one.find(words):
                    covered.append((start, start + one.length))
                    found.update(names)
            out["n_words"].append(len(words))
            out["hits"].append(spans(covered))
            out["items"].append(sorted(found))
        return out

    return map_texts(df, text, compute, OUT, keep)


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, pass_windows: int = PASS_WINDOWS, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``df`` with n_words, hits (word ranges [start, end) inside benchmark windows) and items (sorted ids).

    The benchmark's different windows are counted first. Up to ``pass_windows`` of them (and ``pass_bytes``
    bytes) are broadcast and every document is searched in place, without a shuffle. More windows are dealt
    into as many passes as they ask for, an item's own ones too, however long it is; then the passes' narrow
    results are joined by row. So a worker's tables are bounded whatever the benchmark's size. One row for each
    input row. A null text, or one without words, has n_words 0 and no hits; null and wordless items match
    nothing; a null item id counts as the id "null"; rows of one item id are one item; an empty
    benchmark or an empty table gives no hits or no rows. New columns replace input columns of the
    same name.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("body")
    ).where(F.col("body").isNotNull())
    found = cut(patterns(items))
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window")).alias("bytes")).first()
    passes = max(1, -(-size["n"] // pass_windows), -(-(size["bytes"] or 0) // pass_bytes))
    if passes == 1:
        return scan(df, [(bytes(r.window), r["items"]) for r in found.collect()], text, keep)
    row = free_name(df, "row_no")
    fixed = cut(df.withColumn(row, F.monotonically_increasing_id()))
    parts = None
    for k in range(passes):
        some = found.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        one = scan(fixed, ((bytes(r.window), r["items"]) for r in some.toLocalIterator()), text, [row])
        parts = one if parts is None else parts.unionByName(one)
    # each pass gives one row per document, so a group holds as many rows as there are passes
    merged = parts.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    union = F.reduce(
        "hits",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    fresh = {n.lower() for n in OUT.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    return fixed.select(row, *kept).join(merged.withColumn("hits", union), row).drop(row)


def digest(df: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the operator's hits and items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": n_hit > 0,
        }
    )
