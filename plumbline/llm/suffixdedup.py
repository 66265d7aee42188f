"""Operator 13: repeated byte strings by a collection's Burrows-Wheeler transform, built column by column.

A byte string of LENGTH bytes that also starts in a document of a smaller key is removed wherever it stands.
Equal strings meet because they choose the same anchor: of the ANCHOR-byte hashes inside a string, the least.
Stretches of a text whose strings share an anchor are the documents of a collection; collections hold the
stretches of anchors that more than one text has. A collection's transform and common prefixes are built by
inserting one symbol of every document per round, from the last to the first; runs of common prefixes of
LENGTH bytes or more are the strings that repeat.

Between the steps everything is a file in the shared folder, or one that Spark shuffles, written and read in
sequence: blocks of texts, blocks of anchors, blocks of stretches. Only a collection's own arrays, a few
megabytes, are held in a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BROADCAST_BYTES, cut, free_name, give_back, join_hot, shared_folder

LENGTH, ANCHOR = 50, 16
#: Bytes of text in a block at least and at most, and in one step of the hashing of a block.
BLOCK_BYTES, MOST_BYTES, STEP = 1 << 20, 1 << 24, 1 << 19
#: Blocks of a large table: a block sends a row to nearly every collection, so their number is what rows grow by.
MOST_BLOCKS = 1024
#: Anchors in one group that is looked through, and bytes of the whole texts for each collection.
GROUP_ANCHORS, COLLECTION_BYTES = 1 << 21, 2 << 20
#: Different stretches of one anchor (of each block) beyond which it is no longer a collection's key: each of its strings chooses for itself.
HEAVY = 1 << 15
#: The order of rows without a key: after all others, and equal to each other.
LAST = (1 << 63) - 1

# Odd multipliers of the hashes. 0xFF never stands in UTF-8, so it marks the front of a document.
P, Q, FRONT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0xFF

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _schema(longs: str = "", ints: str = "", blobs: str = "", long_lists: str = "", int_lists: str = "", blob_lists: str = "") -> T.StructType:
    kinds = (T.LongType(), T.IntegerType(), T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.BinaryType()))
    return T.StructType([T.StructField(n, k) for names, k in zip((longs, ints, blobs, long_lists, int_lists, blob_lists), kinds, strict=True) for n in names.split()])


BLOCKS = _schema(longs="block", blobs="body", long_lists="ords ends", blob_lists="digests")
ASKED = _schema(longs="block", ints="bucket", blobs="keys many")
TOLD = _schema(longs="block", ints="bucket", blobs="shared heavy")
PIECES = _schema(longs="block", ints="bucket", blobs="body", long_lists="ord", int_lists="lens piece doc start")
#: What one collection removes in one block of texts: ranges, sorted by text and apart.
GONE = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("doc", T.ArrayType(T.IntegerType())), T.StructField("start", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType()))]
)


# --- the collection ---------------------------------------------------------------------------------------


class _RangeMin:
    """Least value of ranges of an array: by doubling up to WIDE places, and beyond that over blocks of as many."""

    LEVELS = 6
    WIDE = 1 << LEVELS

    def __init__(self, values: np.ndarray):
        self.near = self._levels(values, self.LEVELS + 1)
        whole = len(values) // self.WIDE
        ends = self.near[-1][: whole * self.WIDE : self.WIDE]
        self.far = self._levels(ends, max(1, len(ends).bit_length()))

    @staticmethod
    def _levels(values: np.ndarray, n: int) -> np.ndarray:
        levels = np.empty((n, len(values)), np.uint8)
        levels[0] = values
        for k in range(1, n):
            half, last, own = 1 << (k - 1), levels[k - 1], levels[k]
            np.minimum(last[:-half], last[half:], out=own[:-half])
            own[-half:] = last[-half:]
        return levels

    @staticmethod
    def _least(levels: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(levels[k, first], levels[k, last + 1 - (1 << k.astype(np.int64))])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], range by range."""
        wide = last - first >= self.WIDE
        if not wide.any():
            return self._least(self.near, first, last)
        out = np.empty(len(first), np.uint8)
        out[~wide] = self._least(self.near, first[~wide], last[~wide])
        a, b = first[wide], last[wide]
        least = np.minimum(self.near[-1][a], self.near[-1][b + 1 - self.WIDE])
        x, y = -(-a // self.WIDE), (b + 1) // self.WIDE - 1  # blocks that lie inside
        inner = x <= y
        if inner.any():
            least[inner] = np.minimum(least[inner], self._least(self.far, x[inner], y[inner]))
        out[wide] = least
        return out


def collection_bwt(body: np.ndarray, lens: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes up to ``cap``, origins) of the documents that lie one after another in ``body``.

    All suffixes of all documents, the empty ones first, in order; a document's end is less than any symbol
    and ends are told apart by the documents' places. ``transform`` has the symbol before each suffix, FRONT
    where it is a whole document; ``origins`` has, for each suffix but the empty ones, the place of the suffix
    without its first symbol. Round j inserts the suffixes of j symbols. Those that begin with one symbol stand
    in the order of their origins, so a new one's place among them is found by halving; only new suffixes and
    those behind them get new common prefixes, one more than the least between their origins.
    """
    m, ends = len(lens), np.cumsum(lens)
    both, origin, begin = body[ends - 1].astype(np.uint16), np.zeros(0, np.int32), np.zeros(257, np.int64)  # a prefix above its symbol
    who, at, symbol = np.arange(m), np.arange(m), body[ends - 1]  # documents still growing, in order, and what comes next
    for j in range(1, int(lens.max(initial=0)) + 1):
        by_symbol = np.argsort(symbol, kind="stable")
        who, at, symbol = who[by_symbol], at[by_symbol], symbol[by_symbol]
        fresh = np.bincount(symbol, minlength=256)
        stops = np.cumsum(fresh)
        rank, narrow = np.arange(len(at)), at.astype(np.int32)
        for c in np.flatnonzero(fresh).tolist():
            a, b = stops[c] - fresh[c], stops[c]
            rank[a:b] += begin[c] + np.searchsorted(origin[begin[c] : begin[c + 1]], narrow[a:b])
        begin[1:] += stops
        size = len(both) + len(at)
        old = np.ones(size, bool)
        old[m + rank] = False
        origins = np.empty(size - m, np.int32)
        origins[old[m:]], origins[rank] = origin, narrow
        # the new suffixes, each after the one before it, and what now stands behind a new one
        least = _RangeMin((both >> np.uint16(8)).astype(np.uint8))
        prefix = np.zeros(len(at), np.uint16)
        same = np.flatnonzero(rank > begin[symbol])
        prefix[same] = np.minimum(least(origins[rank[same] - 1] + 1, at[same]) + np.uint16(1), cap)
        behind = np.append(rank[1:] != rank[:-1] + 1, True)[: len(rank)] & (rank + 1 < begin[symbol.astype(np.int64) + 1])
        moved = rank[behind] + 1
        prefix_behind = np.minimum(least(at[behind] + 1, origins[moved]) + np.uint16(1), cap).astype(np.uint16)
        grows = lens[who] > j
        symbol = np.full(len(who), FRONT, np.uint8)
        symbol[grows] = body[ends[who[grows]] - j - 1]
        merged = np.empty(size, np.uint16)
        merged[old] = both
        merged[m + rank] = prefix << np.uint16(8) | symbol
        merged[m + moved] = (merged[m + moved] & np.uint16(255)) | prefix_behind << np.uint16(8)
        # an old place moves by the new suffixes before it; a narrow table of that stays near the processor
        behind_new = np.diff(np.concatenate([[0], m + rank - np.arange(len(rank)), [len(both)]]))
        shift = np.repeat(np.arange(len(rank) + 1, dtype=np.uint16 if len(rank) < 65535 else np.int32), behind_new)
        origin = origins + shift.take(origins.astype(np.intp), mode="clip")
        both, who, at, symbol = merged, who[grows], m + rank[grows], symbol[grows]
    return (both & np.uint16(255)).astype(np.uint8), (both >> np.uint16(8)).astype(np.uint8), origin


def least_holders(body: np.ndarray, lens: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    """For every string of ``length`` bytes of every document, in order, the least ``lo`` of a document that has it."""
    bwt, lcp, origin = collection_bwt(body, lens, length)
    m = len(lens)
    after = np.zeros(len(bwt), np.int64)
    after[origin] = m + np.arange(len(origin))  # the suffix that is one symbol longer
    interval = np.cumsum(lcp < length)
    first = np.concatenate([[0], np.cumsum(lens - length + 1)])
    named = np.empty(first[-1], np.int64)
    place, who = np.arange(m), np.arange(m)
    for j in range(1, int(lens.max(initial=0)) + 1):
        place = after[place]
        if j >= length:
            named[first[who] + lens[who] - j] = interval[place]
        on = lens[who] > j
        place, who = place[on], who[on]
    best = np.full(int(interval[-1]) + 1 if len(interval) else 1, LAST, np.int64)
    np.minimum.at(best, named, np.repeat(lo, lens - length + 1))
    return best[named]


# --- anchors ----------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * P
    x ^= x >> np.uint64(29)
    return x


def _eights(x: np.ndarray) -> np.ndarray:
    """At every place, the eight bytes from there on as a number."""
    raw, out = x.tobytes(), np.empty(max(0, len(x) - 7), np.uint64)
    for k in range(min(8, len(out))):
        lane = out[k::8]
        lane[:] = np.frombuffer(raw, "<u8", len(lane), k)
    return out


def _hashes(eight: np.ndarray, n: int, length: int) -> np.ndarray:
    """Hashes of the n strings of ``length`` bytes (8 or more) from each place on."""
    h, at = _mixed(eight[:n]), 8
    while at < length:
        step = min(at, length - 8)
        h = _mixed(h + eight[step : step + n] * Q)
        at += 8
    return h


def _hashes_at(eight: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The same hashes, of the strings at some places only."""
    h, done = _mixed(eight[at]), 8
    while done < length:
        h = _mixed(h + eight[at + min(done, length - 8)] * Q)
        done += 8
    return h


def stretches(body: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, key): stretches of consecutive strings of ``length`` bytes, within one text each, that
    choose the same anchor. A stretch has at most length - ANCHOR + 1 strings."""
    width, found = length - ANCHOR + 1, []
    for a in range(0, len(body), STEP):
        part = body[a : a + STEP + length - 1]
        n = len(part) - length + 1
        if n < 1:
            break
        h = _hashes(_eights(part), len(part) - ANCHOR + 1, ANCHOR)
        span = 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[: span - width], h[width - span :])
        # strings that cross the end of a text are none
        inside = np.ones(n + 1, bool)
        near = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + n + length, "left")] - a
        for e in near.tolist():
            inside[max(0, e - length + 1) : max(0, min(e, n))] = False
        inside[n] = False
        starts = inside[:n].copy()
        starts[1:] &= ~inside[: n - 1] | (h[1:] != h[:-1])
        first = np.flatnonzero(starts)
        stops = np.flatnonzero(~inside)
        stop = np.minimum(np.append(first[1:], n)[: len(first)], stops[np.searchsorted(stops, first)])
        count = stop - first
        more = -(-count // width)
        if len(more) and more.max() > 1:  # one anchor over and over again
            nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            first, count = np.repeat(first, more) + nth * width, np.minimum(np.repeat(count, more) - nth * width, width)
        found.append((first + a, count, _mixed(h[first] ^ h[first] >> np.uint64(32))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _share(key: np.ndarray, buckets: int, low: bool = False) -> np.ndarray:
    """A bucket by the upper (or lower) half of a key; by the upper half, buckets are ranges of keys."""
    half = key & np.uint64(0xFFFFFFFF) if low else key >> np.uint64(32)
    return (half * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _texts_of(ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, start, "right")


def _batch(schema: T.StructType, rows: list[dict]) -> pa.RecordBatch:
    """Rows whose values are numpy arrays, lists, bytes or numbers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], names=fields.names)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    return np.frombuffer(zstandard.decompress(row["body"]), np.uint8), np.array(row["ends"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]
            give_back()


# --- steps ------------------------------------------------------------------------------------------------


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """Texts (ord, digest, body) in blocks of about ``block_bytes``, compressed; a text only once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        block, seen, held, size, press = TaskContext.get().partitionId() << 32, set(), [], 0, zstandard.ZstdCompressor(level=3)

        def packed() -> pa.RecordBatch:
            ords, digests, bodies = zip(*held, strict=True)
            return _batch(BLOCKS, [{"block": block, "ords": ords, "digests": digests, "ends": np.cumsum([len(b) for b in bodies]), "body": press.compress(b"".join(bodies))}])

        for batch in batches:
            for i in range(len(batch)):
                ord_, digest, body = (c[i].as_py() for c in batch.columns)
                if digest in seen:
                    continue
                seen.add(digest)
                held.append((ord_, digest, body))
                size += len(body)
                if size >= block_bytes:
                    yield packed()
                    held, size, block = [], 0, block + 1
                    give_back()
        if held:
            yield packed()

    return texts.select("ord", "digest", "body").mapInArrow(run, BLOCKS)


def _different(raw: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different byte ranges each run of ranges has; runs begin at ``first``."""
    runs = np.diff(np.append(first, len(start)))
    several = np.flatnonzero(runs > 1)
    at = np.repeat(first[several] - (np.cumsum(runs[several]) - runs[several]), runs[several]) + np.arange(runs[several].sum())
    seen: dict[bytes, int] = {}  # equal stretches have equal anchors
    new = np.fromiter((seen.setdefault(raw[x:y], i) == i for i, (x, y) in enumerate(zip(start[at].tolist(), end[at].tolist(), strict=True))), bool, len(at))
    runs[several] = np.bincount(np.repeat(np.arange(len(several)), runs[several]), new, len(several)).astype(np.int64)
    return runs


def _ask(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """A block's anchors by bucket: 48 bits of each, how many different stretches have it and whether several texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            body, ends = _unpacked(row)
            start, count, key = stretches(body, ends, length)
            order = np.argsort(key, kind="stable")
            start, count, key, text = start[order], count[order], key[order], _texts_of(ends, start)[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            if not len(first):
                continue
            runs = _different(body.tobytes(), start, start + count + length - 1, first)
            several = np.maximum.reduceat(text, first) > np.minimum.reduceat(text, first)
            many, own = (np.minimum(runs, 32767) << 1 | several).astype(np.uint16), key[first]
            bucket = _share(own, buckets)
            cuts, made = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                short = own[a:b] >> np.uint64(16)
                keys = (short >> np.uint64(16)).astype(np.uint32).tobytes() + short.astype(np.uint16).tobytes()
                made.append({"block": row["block"], "bucket": int(bucket[a]), "keys": keys, "many": many[a:b].tobytes()})
            yield _batch(ASKED, made)

    return blocks.select("block", "ends", "body").mapInArrow(run, ASKED)


def _answer(table: pa.Table) -> pa.Table:
    """Of the anchors of one bucket, by block: which are shared by several texts, and which are heavy."""
    out, keys, many = {"block": [], "bucket": [], "shared": [], "heavy": []}, [], []
    for k, m in zip(table["keys"].to_pylist(), table["many"].to_pylist(), strict=True):
        n = len(m) // 2
        keys.append(np.frombuffer(k, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(k, np.uint16, n, 4 * n))
        many.append(np.frombuffer(m, np.uint16).astype(np.int64))
    sizes, many = [len(k) for k in keys], np.concatenate(many)
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    runs, blocks, several = np.bincount(at, many >> 1), np.bincount(at), np.bincount(at, many & 1)
    shared = ((blocks > 1) | (several > 0))[at]
    heavy = shared & (runs > HEAVY)[at]
    start = 0
    for block, bucket, n in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), sizes, strict=True):
        own = slice(start, start + n)
        start += n
        if shared[own].any():
            for name, v in (("block", block), ("bucket", bucket), ("shared", np.packbits(shared[own]).tobytes()), ("heavy", np.packbits(heavy[own]).tobytes())):
                out[name].append(v)
    return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["shared"], pa.binary()), pa.array(out["heavy"], pa.binary())], names=list(out))


def _gathered(body: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    before = np.cumsum(lens) - lens
    return body[np.repeat(start - before, lens) + np.arange(int(lens.sum()))]


def _pieces(told: DataFrame, buckets: int, collections: int, length: int) -> DataFrame:
    """The stretches of shared anchors of each block, by collection: the different ones, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            body, ends = _unpacked(row)
            start, count, key = stretches(body, ends, length)
            own, at = np.unique(key, return_inverse=True)
            bucket = _share(own, buckets)
            shared, heavy = np.zeros(len(own), bool), np.zeros(len(own), bool)
            for t in row["told"]:
                a, b = np.searchsorted(bucket, t["bucket"], "left"), np.searchsorted(bucket, t["bucket"], "right")
                shared[a:b] = np.unpackbits(np.frombuffer(t["shared"], np.uint8), count=b - a)
                heavy[a:b] = np.unpackbits(np.frombuffer(t["heavy"], np.uint8), count=b - a)
            alone = heavy[at]
            if alone.any():  # every string of a heavy anchor's stretches goes by its own hash
                n = count[alone]
                before = np.repeat(np.cumsum(n) - n, n)
                nth, wide = np.arange(n.sum()), length - 1
                gathered = _gathered(body, start[alone], n + wide)
                hashed = _hashes_at(_eights(gathered), nth + wide * np.repeat(np.arange(len(n)), n), length)
                one, rest = np.repeat(start[alone], n) + nth - before, shared[at] & ~alone
                start, count, key = np.append(start[rest], one), np.append(count[rest], np.ones(len(one), np.int64)), np.append(key[rest], hashed)
            else:
                rest = shared[at]
                start, count, key = start[rest], count[rest], key[rest]
            to = _share(key, collections, low=True)
            order = np.argsort(to, kind="stable")
            start, end, to = start[order], (start + count + length - 1)[order], to[order]
            text, ords = _texts_of(ends, start), np.array(row["ords"], np.int64)
            # the different stretches in order; equal ones have equal keys, so those of a collection lie together
            raw, seen = body.tobytes(), {}
            piece = np.fromiter((seen.setdefault(raw[x:y], len(seen)) for x, y in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(to))
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
            lens = np.fromiter(map(len, seen), np.int64, len(seen))
            own = np.append(piece[cuts], len(lens))
            offsets, pieces = pa.array(np.append(cuts, len(to)), pa.int32()), pa.array(own, pa.int32())
            lists = {"ord": ords[text], "piece": piece - np.repeat(own[:-1], np.diff(np.append(cuts, len(to)))), "doc": text, "start": start - np.append(0, ends)[text]}
            made = {c: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64() if c == "ord" else pa.int32())) for c, v in lists.items()}
            made["lens"] = pa.ListArray.from_arrays(pieces, pa.array(lens, pa.int32()))
            stops = pa.py_buffer(np.append(0, np.cumsum(lens))[own].astype(np.int32))
            made["body"] = pa.Array.from_buffers(pa.binary(), len(cuts), [None, stops, pa.py_buffer(b"".join(seen))])
            made["block"], made["bucket"] = pa.array(np.full(len(cuts), row["block"], np.int64)), pa.array(to[cuts], pa.int32())
            yield pa.RecordBatch.from_arrays([made[c] for c in PIECES.names], names=PIECES.names)

    return told.select("block", "ords", "ends", "body", "told").mapInArrow(run, PIECES)


def _near_others(body: np.ndarray, lens: np.ndarray, length: int) -> np.ndarray:
    """Which of the different stretches may have a string of ``length`` bytes that another has.

    Such a string holds the anchor, at the same place in both, and at least half of its other bytes on one side of it. So
    a stretch is one of these if another has the same anchor with the same bytes on that side. Where an anchor stands
    twice in a stretch, all stretches that have it count.
    """
    n, end = len(lens), np.cumsum(lens)
    first, rest = end - lens, length - ANCHOR
    half, eight = (rest + 1) // 2, _eights(body)
    h = _hashes(eight, len(body) - ANCHOR + 1, ANCHOR)
    least, at = np.empty(n, np.uint64), np.empty(n, np.int64)
    for a in range(0, n, 1 << 14):
        of = first[a : a + (1 << 14), None] + np.arange(rest + 1)
        place = h[of].argmin(1)
        at[a : a + len(of)] = first[a : a + len(of)] + place
        least[a : a + len(of)] = h[at[a : a + len(of)]]
    fits = np.ones(len(body), bool)  # anchors that cross the end of a stretch are none
    for k in range(1, ANCHOR):
        fits[end - k] = False
    hit = np.append(h, np.zeros(ANCHOR - 1, np.uint64)) == np.repeat(least, lens)
    twice = np.add.reduceat((hit & fits).astype(np.int64), first) > 1
    near = np.isin(least, least[twice])
    for there, side in ((at - first >= half, at - half), (end - at - ANCHOR >= half, at)):
        _, own, times = np.unique(_hashes_at(eight, side[there], ANCHOR + half), return_inverse=True, return_counts=True)
        near[there] |= (times > 1)[own]
    return near


def _repeats(length: int):
    def run(table: pa.Table) -> pa.Table:
        """GONE of one collection: byte ranges covered by strings that a text of a smaller key has."""
        lists = {c: table[c].combine_chunks() for c in ("lens", "piece", "start", "ord", "doc")}
        flat = {c: v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c, v in lists.items()}
        sizes = {c: pa.compute.list_value_length(lists[c]).to_numpy(zero_copy_only=False) for c in ("lens", "piece")}
        seen: dict[bytes, int] = {}
        stops = np.cumsum(flat["lens"]).tolist()
        raw = b"".join(table["body"].to_pylist())
        ids = np.fromiter((seen.setdefault(raw[x:y], len(seen)) for x, y in zip([0, *stops], stops, strict=False)), np.int64, len(stops))
        # where the stretches stand, and the least text that has each
        shift = np.cumsum(sizes["lens"]) - sizes["lens"]
        own = ids[flat["piece"] + np.repeat(shift, sizes["piece"])]
        lo = np.full(len(seen), LAST, np.int64)
        np.minimum.at(lo, own, flat["ord"])
        lens = np.fromiter(map(len, seen), np.int64, len(seen))
        body, least = np.frombuffer(b"".join(seen), np.uint8), np.repeat(lo, lens - length + 1)
        near = _near_others(body, lens, length)
        if near.any():  # the others' strings are their own only
            least[np.repeat(near, lens - length + 1)] = least_holders(body[np.repeat(near, lens)], lens[near], lo[near], length)
        # the strings of a stretch in runs of one least holder
        ends = np.cumsum(lens - length + 1)
        fresh = np.append(True, least[1:] != least[:-1])[: len(least)]
        fresh[ends[:-1]] = True
        first = np.flatnonzero(fresh)
        size, value = np.diff(np.append(first, len(least))), least[first]
        stop = np.searchsorted(first, ends, "left")
        begin = np.append(0, stop[:-1])
        into = first - np.append(0, ends)[np.repeat(np.arange(len(lens)), stop - begin)]
        block = np.repeat(table["block"].to_numpy(), sizes["piece"])
        n = (stop - begin)[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(own)), n)
        gone = value[at] < flat["ord"][of]
        at, of = at[gone], of[gone]
        start = flat["start"][of] + into[at]
        return _by_block(block[of], flat["doc"][of], start, start + size[at] + length - 1)

    return run


def _union(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted union of each owner's ranges; owners are 0, 1, ..."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # every owner on a stretch of its own, so that one running maximum serves all
    far = (int(end.max(initial=0)) + 1) * owner
    reach = np.maximum.accumulate(end + far)
    at = np.flatnonzero(np.append(True, (start + far)[1:] > reach[:-1])[: len(owner)])
    last = np.append(at[1:], len(owner))[: len(at)] - 1
    return owner[at], start[at], (reach - far)[last]


def _by_block(block: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """GONE: a row a block, with the union of each of its texts' ranges; so a common string gives no row of its own for each text."""
    names, at = np.unique(block, return_inverse=True)
    wide = int(doc.max(initial=0)) + 1
    texts, owner = np.unique(at * wide + doc, return_inverse=True)
    owner, start, end = _union(owner, start, end)
    of = texts[owner]
    offsets = pa.array(np.searchsorted(of // wide, np.arange(len(names) + 1)), pa.int32())
    lists = {"doc": pa.array((of % wide).astype(np.int32)), "start": pa.array(start), "end": pa.array(end)}
    return pa.table({"block": pa.array(names, pa.int64()), **{c: pa.ListArray.from_arrays(offsets, v) for c, v in lists.items()}})


def _of_block(table: pa.Table) -> pa.Table:
    """(block, doc, spans) of one block: the union of what its collections have found."""
    doc, start, end = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "start", "end"))
    texts, owner = np.unique(doc, return_inverse=True)
    owner, start, end = _union(owner, start, end)
    offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
    return pa.table({"block": pa.array(np.full(len(texts), table["block"][0].as_py()), pa.int64()), "doc": pa.array(texts.astype(np.int32)), "spans": spans})


def _narrow(df: DataFrame, size: Column) -> DataFrame:
    """A table that ``cut`` returned, marked for broadcast if it is measured to be small."""
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES else df


def _spans(texts: DataFrame, total: int, length: int) -> DataFrame:
    """(digest, spans) of the texts (ord, digest, body) of which something goes; ``total`` is the sum of their bytes."""
    spark, folder = texts.sparkSession, f"{shared_folder(texts.sparkSession)}/suffixes-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total // (8 * GROUP_ANCHORS) + 1)  # an anchor for about twenty bytes
    collections = max(parts, total // COLLECTION_BYTES + 1)
    _blocks(texts, max(BLOCK_BYTES, min(MOST_BYTES, total // MOST_BLOCKS))).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    told = cut(_ask(blocks, buckets, length).groupBy("bucket").applyInArrow(_answer, TOLD))
    size = told.agg(F.sum(F.octet_length("shared") * 2 + 64)).first()[0] or 0
    by_block = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "heavy")).alias("told"))  # two bits for each anchor of the block
    asked = blocks.join(F.broadcast(by_block) if size <= BROADCAST_BYTES else by_block, "block")
    gone = _pieces(asked, buckets, collections, length).groupBy("bucket").applyInArrow(_repeats(length), GONE)
    named = blocks.select("block", F.posexplode("digests").alias("doc", "digest"))
    spans = gone.groupBy("block").applyInArrow(_of_block, T.StructType([GONE["block"], T.StructField("doc", T.IntegerType()), T.StructField("spans", SPANS)]))
    # a row a text at most; rows that are equal in key and text lose the same
    return named.join(spans, ["block", "doc"]).groupBy("digest").agg(F.first("spans").alias("spans"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns in ``keep``) with n_bytes and spans: the byte ranges to remove, sorted and apart.

    A byte is in a span if a string of ``length`` bytes (24 or more) of its text covers it that also starts in
    the text of a row with a smaller key. Keys are whole numbers; null keys come after all others, and rows of
    equal keys do not take from each other. Null texts count as empty; texts shorter than ``length`` lose
    nothing; a text equal to one of a smaller key loses everything. One row for each input row; new columns
    replace input columns of the same name. An empty table gives no rows.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"strings of fewer than {ANCHOR + 8} bytes are not anchored")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_bytes", "spans")]
    ord_, digest, body = (free_name(df, c) for c in ("own_ord", "own_digest", "own_body"))
    rows = df.select(
        *(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias(ord_),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias(body),
    ).withColumn(digest, F.unhex(F.md5(body)))
    long = rows.where(F.octet_length(body) >= length)
    same = [F.col(digest).alias("digest"), F.octet_length(body).cast("long").alias("size")]
    firsts = cut(long.groupBy(*same).agg(F.min(ord_).alias("first"), F.max(ord_).alias("last")))
    total = firsts.agg(F.sum("size")).first()[0] or 0
    texts = long.select(F.col(ord_).alias("ord"), F.col(digest).alias("digest"), F.col(body).alias("body"))
    near = _narrow(firsts, F.lit(32))
    spans = cut(_spans(texts.join(near, "digest").where("ord = first"), total, length))
    marked = firsts.join(spans, "digest", "left") if total else firsts.withColumn("spans", F.lit(None).cast(SPANS))
    classes = cut(marked.where("spans is not null or first < last"))  # from all other texts nothing goes
    size = classes.agg(F.sum(F.coalesce(F.size("spans"), F.lit(0)) * 24 + 96)).first()[0] or 0
    to = classes.select(F.col("digest").alias(digest), "first", F.col("spans").alias("own"))
    found = rows.join(F.broadcast(to), digest, "left") if size <= BROADCAST_BYTES else join_hot(rows, to, [digest], "left")
    n = F.octet_length(body).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    own = F.when(F.col("first").isNull(), None).when(F.col(ord_) > F.col("first"), whole).otherwise(F.col("own"))
    return found.select(*(F.col(f"`{c}`") for c in kept), n.alias("n_bytes"), F.coalesce(own, F.array().cast(SPANS)).alias("spans"))


def remaining(text: Column, spans: Column) -> Column:
    """The bytes of the text outside its spans; they need not be UTF-8 any more. A null text is empty."""

    @F.arrow_udf("binary")
    def outside(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        made = []
        for a in range(0, len(bodies), 256):
            out = []
            for body, gone in zip(bodies.slice(a, 256), spans.slice(a, 256).to_pylist(), strict=True):
                b = body.as_py()
                if b is not None:
                    cuts = [0, *(x for r in gone for x in (r["start"], r["end"])), len(b)]
                    b = b"".join(b[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                out.append(b)
            made.append(pa.array(out, pa.binary()))
        give_back()
        return pa.concat_arrays(made) if made else pa.array([], pa.binary())

    body = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    changed = F.size(spans) > 0  # only changed texts go to Python
    return F.when(changed, outside(F.when(changed, body), spans)).otherwise(body)
