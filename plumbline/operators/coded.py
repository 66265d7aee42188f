"""Token lists as blocks: a block's different words once, and a number for each token.

A row a token, or a row a pair of neighbours, would be sorted and shuffled many times. Here a row is a block of about
BLOCK_TOKENS tokens; what leaves it are its different pairs as arrays, or its different words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.grams import P1, mixed, planes, starts, unplaned
from plumbline.stored import stored

#: Tokens of a block (a longer list is a block of its own), and pairs of one range of hashes.
BLOCK_TOKENS, RANGE_PAIRS = 1 << 20, 1 << 20
#: A first word of at least this part of all tokens is dealt to all ranges.
HOT = 1024
#: Bytes of lower-cased text that are cut into tokens at a time.
STEP_BYTES = 4 << 20
#: Counts that differ by no more than this share may have one score in whole millionths.
NEAR = 2e-6

_SENT = "to int, words array<string>, a binary, b binary, n binary"
_SENT_KINDS = {"to": pa.int32(), "words": pa.list_(pa.string()), "a": pa.binary(), "b": pa.binary(), "n": pa.binary()}


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(planes(a), "lz4", asbytes=True) if len(a) else b""


def unpacked(b: bytes, n: int) -> np.ndarray:
    return unplaned(pa.decompress(b, 4 * n, "lz4", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[list(b"0123456789abcdefghijklmnopqrstuvwxyz'")] = True  # the characters of text.TOKEN


def tokenized(texts: pa.StringArray) -> pa.ListArray:
    """The tokens of lower-cased texts, as ``text.tokens`` has them; null gives null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = ends[1:] > ends[:-1]  # a token ends where its text ends
    for flags, at in ((first, ends[:-1][some]), (last, ends[1:][some] - 1)):
        flags[at] = inside[at]
    at = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - at)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words, mask=texts.is_null() if texts.null_count else None)


def _with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches, ``toks`` as lists of tokens; texts are cut a few MB at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("toks")
        said = batch.column(at)
        if not pa.types.is_string(said.type):
            yield batch
            continue
        ends = np.cumsum(pc.binary_length(said).fill_null(0).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, (int(ends[i - 1]) if i else 0) + STEP_BYTES, "right")))
            part = batch.slice(i, j - i)
            yield part.set_column(at, "toks", tokenized(part.column(at)))
            i = j


def _runs(names: list[str | None], sizes: np.ndarray, share: float, seed: int) -> np.ndarray:
    """For each token, how many drawn places lie between it and the last place before that is not; 0 where it is not drawn."""
    bound = round(share * (1 << 32))
    places = [b"%d" % i for i in range(max(sizes, default=0))]
    drawn = np.zeros(int(np.maximum(sizes, 0).sum()), bool)
    at = 0
    for name, size in zip(names, sizes.tolist(), strict=True):
        if size > 1:
            head = f"{seed}:".encode() if name is None else f"{seed}:{name}:".encode()
            digests = b"".join([hashlib.md5(head + p, usedforsecurity=False).digest() for p in places[1:size]])
            drawn[at + 1 : at + size] = np.frombuffer(digests, ">u4")[::4] < bound
        at += max(size, 0)
    own = np.arange(len(drawn))
    return (own - np.maximum.accumulate(np.where(drawn, 0, own))).astype(np.int32) if len(own) else np.zeros(0, np.int32)


def blocks(df: DataFrame, toks: Column, key: str | None = None, share: float = 0.0, seed: int = 0) -> DataFrame:
    """(block, n_tokens, keys, sizes, words, codes, runs), stored: all token lists of ``df``, each in one block. ``toks``
    holds token lists, or texts, which are cut into ``text.tokens`` where the blocks are made.

    ``sizes`` is -1 for a null list. With a key, ``keys`` holds those of the rows and ``runs`` the places that are drawn
    with probability ``share`` by seed, key and place (never the first): how far each lies from the last one that is not.
    """
    kind = T.LongType() if key is None else df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.ArrayType(T.StringType())), T.StructField("codes", T.BinaryType()), T.StructField("runs", T.BinaryType()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows["toks"].chunk(0)
            sizes = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            runs = b"" if key is None else _packed(_runs(rows["name"].to_pylist(), sizes, share, seed))
            keys = [] if key is None else rows["key"].to_pylist()
            words = pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary)  # no Python strings
            row = [len(flat), keys, sizes, None, _packed(flat.indices.to_numpy()), runs]
            return pa.RecordBatch.from_arrays([words if v is None else pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=schema.names)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in _with_tokens(batches):
            ends = np.cumsum(pc.list_value_length(batch.column("toks")).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + BLOCK_TOKENS - size, "right"))
                if to <= at and held:
                    yield made(held)
                    held, size = [], 0
                    continue
                to = max(to, at + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
        if held:
            yield made(held)

    said = df.select(toks.alias("toks"))
    toks = F.lower(toks).alias("toks") if said.schema["toks"].dataType == T.StringType() else toks.alias("toks")
    columns = [toks] if key is None else [toks, F.col(key).alias("key"), F.col(key).cast("string").alias("name")]
    return stored(df.select(*columns).mapInArrow(build, schema).withColumn("block", F.monotonically_increasing_id()))


def _dealt(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
    """The pairs of each value of ``to``, with the words that they have."""
    order = np.argsort(to, kind="stable")
    a, b, n, to = a[order], b[order], n[order], to[order]
    cuts = [*starts(to).tolist(), len(to)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        used, codes = np.unique(np.concatenate([a[i:j], b[i:j]]), return_inverse=True)
        none = int(len(used) > 0 and used[0] < 0)  # -1 stays: no word
        codes = (codes - none).astype(np.int32)
        yield int(to[i]), words.take(pa.array(used[none:])), planes(codes[: j - i]), planes(codes[j - i :]), planes(n[i:j])


def _batch(rows: list[tuple]) -> pa.Table:
    columns = dict(zip(_SENT_KINDS, zip(*rows, strict=True) if rows else [()] * len(_SENT_KINDS), strict=True))
    made = {name: pa.array(columns[name], k) for name, k in _SENT_KINDS.items() if name != "words"}
    offsets = pa.array(np.append(0, np.cumsum([len(w) for w in columns["words"]])).astype(np.int32))
    made["words"] = pa.ListArray.from_arrays(offsets, pa.concat_arrays(columns["words"] or [pa.array([], pa.string())]))
    return pa.table({name: made[name] for name in _SENT_KINDS})


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([crc32(w.encode()) for w in words.to_pylist()], np.uint64)


def _range(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(x), np.int32)


def _summed(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, a, b, n): the different pairs of the rows of one range, and how often they are."""
    lists = table["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().dictionary_encode()
    place = np.append(flat.indices.to_numpy(), -1)  # -1 is the last place
    firsts = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    def gathered(name: str) -> np.ndarray:
        return np.concatenate([place[np.where(c < 0, -1, c + first)] for c, first in zip((unplaned(x, np.int32) for x in table[name].to_pylist()), firsts.tolist(), strict=False)])

    a, b, n = gathered("a").astype(np.int64), gathered("b"), np.concatenate([unplaned(x, np.int64) for x in table["n"].to_pylist()])
    pair = a * (len(flat.dictionary) + 1) + b + 1
    order = np.argsort(pair, kind="stable")
    at = starts(pair[order])
    return flat.dictionary, a[order][at].astype(np.int32), b[order][at], np.add.reduceat(n[order], at)


def _pruned(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n), by a: the pairs that can be among the ``most`` best of their first word, best first; the others as one, b = -1.

    Equally frequent ones go by name, so no more than ``most`` of those are needed; counts so near that their scores may
    be equal stay too.
    """
    rank = np.empty(len(words) + 1, np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    rank[-1] = len(words)
    order = np.lexsort((rank[b], -n, b < 0, a))
    a, b, n = a[order], b[order], n[order]
    first, own = starts(a), starts(a, n)
    at = np.arange(len(a))
    sizes = np.diff(np.append(first, len(a)))
    in_count = at - np.repeat(own, np.diff(np.append(own, len(a))))
    least = np.repeat(n[np.minimum(first + most, np.append(first[1:], len(a))) - 1], sizes)  # the count at place ``most``
    full = np.repeat(sizes, sizes) > most
    keep = (b >= 0) & ~(full & ((in_count >= most) | (n < least * (1 - NEAR))))
    rest = np.add.reduceat(np.where(keep, 0, n), first)
    some = rest > 0
    a, b, n = np.append(a[keep], a[first][some]), np.append(b[keep], np.full(some.sum(), -1, b.dtype)), np.append(n[keep], rest[some])
    order = np.argsort(a, kind="stable")
    return a[order], b[order], n[order]


def _frequent(made: DataFrame, total: int) -> set[str]:
    """At most HOT words: those that are about a part of 1 / HOT of all tokens or more, counted in the blocks where they are half as frequent or more."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n_tokens")[i].as_py()
                counts = np.bincount(unpacked(batch.column("codes")[i].as_py(), n))
                at = np.flatnonzero(counts * HOT * 2 >= n)
                yield pa.RecordBatch.from_arrays([batch.column("words")[i].values.take(pa.array(at)), pa.array(counts[at].astype(np.int64))], names=["word", "n"])

    found = made.select("n_tokens", "words", "codes").where("n_tokens > 0").mapInArrow(counted, "word string, n long")
    return {r.word for r in found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * HOT >= total).collect()}


def frequent_pairs(made: DataFrame, most: int, end: str) -> DataFrame:
    """(token, total, nexts, counts): how often each token of ``blocks`` is followed at all, and by those that can be among
    the ``most`` best. The last token of a list is followed by ``end``.

    Pairs are dealt by the hash of their first word, those of a very frequent word by the hash of both, and counted. A
    range keeps what can be among the best of a first word, and the count of the others, so a frequent word brings no
    more than ``most`` or so from each range.
    """
    total = made.agg(F.sum("n_tokens")).first()[0] or 0
    bits = int(total // RANGE_PAIRS).bit_length()
    hot = _frequent(made, total) if bits else set()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n_tokens")[i].as_py()
                codes, sizes = unpacked(batch.column("codes")[i].as_py(), n), batch.column("sizes")[i].values.to_numpy()
                words = pa.concat_arrays([batch.column("words")[i].values, pa.array([end])])
                nexts = np.append(codes[1:], 0)
                nexts[np.cumsum(sizes[sizes > 0]) - 1] = len(words) - 1
                pairs, counts = np.unique(codes.astype(np.int64) * len(words) + nexts, return_counts=True)
                a, b = pairs // len(words), pairs % len(words)
                h = _hashes(words)
                spread = pc.is_in(words, value_set=pa.array(sorted(hot), pa.string())).to_numpy(zero_copy_only=False)
                sent = _batch(list(_dealt(words, a, b, counts, _range(mixed(h[a] * P1 + np.where(spread[a], h[b], 0).astype(np.uint64)), bits))))
                yield from sent.to_batches(max_chunksize=1)

    def choose(table: pa.Table) -> pa.Table:
        words, a, b, n = _summed(table)
        a, b, n = _pruned(words, a, b, n, most)
        first = starts(a)
        named = b >= 0
        offsets = pa.array(np.append(0, np.cumsum(np.add.reduceat(named.astype(np.int32), first))).astype(np.int32))
        nexts = pa.ListArray.from_arrays(offsets, words.take(pa.array(b[named])))
        return pa.table({"token": words.take(pa.array(a[first])), "total": np.add.reduceat(n, first), "nexts": nexts, "counts": pa.ListArray.from_arrays(offsets, pa.array(n[named]))})

    sent = made.select("n_tokens", "sizes", "words", "codes").where("n_tokens > 0").mapInArrow(send, _SENT)
    found = sent.groupBy("to").applyInArrow(choose, "token string, total long, nexts array<string>, counts array<long>")
    both = F.flatten(F.collect_list(F.arrays_zip("nexts", "counts"))).alias("p")  # one row of a word, or one from each range
    return found.groupBy("token").agg(F.sum("total").alias("total"), both).select("token", "total", F.col("p.nexts").alias("nexts"), F.col("p.counts").alias("counts"))


def run_origins(made: DataFrame) -> DataFrame:
    """(block, origin, longest): the tokens of each block that runs of drawn places follow, and the longest run."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n_tokens")[i].as_py()
                codes, runs = (unpacked(batch.column(c)[i].as_py(), n) for c in ("codes", "runs"))
                ends = np.flatnonzero((runs > 0) & (np.append(runs[1:], 0) == 0))
                if not len(ends):
                    continue
                origin, longest = codes[ends - runs[ends]], runs[ends]
                order = np.lexsort((longest, origin))
                last = np.append(starts(origin[order])[1:], len(order)) - 1
                words = batch.column("words")[i].values.take(pa.array(origin[order][last]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(last), batch.column("block")[i].as_py())), words, pa.array(longest[order][last])], names=["block", "origin", "longest"])

    return made.select("block", "n_tokens", "words", "codes", "runs").mapInArrow(found, "block long, origin string, longest int")


def with_chains(made: DataFrame, chains: DataFrame, key: str, kind: T.DataType, name: str) -> DataFrame:
    """(key, name): the lists of ``blocks``, drawn places filled from the chain (block, origin, chain) of the token before their run."""
    schema = T.StructType([T.StructField(key, kind), T.StructField(name, T.ArrayType(T.StringType()))])

    def filled(own: pa.Table, found: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        row = {c: own[c][0] for c in own.column_names}
        n, words, sizes = row["n_tokens"].as_py(), row["words"].values, row["sizes"].values.to_numpy()
        codes, runs = unpacked(row["codes"].as_py(), n), unpacked(row["runs"].as_py(), n)
        parts = [words]
        if len(found):
            lists = found["chain"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            parts.append(lists.flatten())
            first = np.zeros(len(words), np.int64)
            at = pc.index_in(found["origin"], value_set=words).to_numpy()
            first[at] = len(words) + np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
            origin = codes[np.arange(n) - runs]
            codes = np.where(runs > 0, first[origin] + runs - 1, codes)
        said = pa.concat_arrays(parts).take(pa.array(codes))
        offsets = np.append(0, np.cumsum(np.maximum(sizes, 0))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), said, mask=pa.array(sizes < 0))
        return pa.table([row["keys"].values.cast(to_arrow_type(kind)), lists], names=[key, name])

    left = made.select("block", "n_tokens", "keys", "sizes", "words", "codes", "runs")
    return left.groupBy("block").cogroup(chains.groupBy("block")).applyInArrow(filled, schema)
