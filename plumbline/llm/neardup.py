"""Operator 4: near-duplicate classes by ProbMinHash over weighted word shingles.

Each shingle of five words arrives at the registers of a signature as a Poisson process whose rate is
its weight (1 + ln of its count in the text); a register keeps the shingle that arrives first, and a
shingle stops as soon as its next arrival is later than all registers. Two registers agree with the
probability Jaccard similarity of the texts. Bands of registers give candidates, the exact probability
Jaccard similarity of the whole texts confirms them, and linked texts form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BROADCAST_BYTES, ROW_BYTES, cut, free_name, join_hot, join_narrow, key_name, map_texts, row_key
from plumbline.llm.components import components
from plumbline.llm.decontaminate import words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Registers in a band, and bands: at a similarity of 0.8 one pair in 17,000 shares no band.
ROWS, BANDS = 6, 32
#: Members of a bucket that one task compares with as many others; larger buckets take more tasks.
BLOCK = 1024
#: Bytes of text of such members.
BLOCK_BYTES = 16 << 20
#: Rounding that a similarity of just the threshold may lose.
EPSILON = 1e-9

# Odd 64-bit constants of the splitmix64 generator and of multiplicative hashing.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing function of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(MIX1)
    x = (x ^ (x >> _U(27))) * _U(MIX2)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and weights of the distinct shingles; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total = mix(total * _U(GOLDEN) + h[k : k + n])
    found, counts = np.unique(total, return_counts=True)
    return found, 1 + np.log(counts)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (hashes sorted, weights above 0)."""
    (hx, wx), (hy, wy) = x, y
    same, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(same):
        return 0.0
    a, b = wx[ix], wy[iy]
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    first = np.searchsorted(ratio, ratio, "left")  # elements of a smaller ratio stand before it
    below = np.concatenate([[0.0], np.cumsum(b)])[first]
    above = a.sum() - np.concatenate([[0.0], np.cumsum(a)])[first]
    return float(np.sum(1.0 / ((above + only_x) / a + (below + only_y) / b)))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """One row of m registers (hash of the first arrival) per set that is not empty."""
    live_h = np.concatenate([h for h, _ in sets])
    live_w = np.concatenate([w for _, w in sets])
    live_d = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    at = np.zeros(len(live_h))
    best, who = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    k = 0
    while len(live_h):
        k += 1
        r = mix(live_h + _U(k * GOLDEN & (2**64 - 1)))
        register = live_d * m + ((r >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        uniform = ((mix(r ^ _U(MIX2)) >> _U(11)).astype(np.float64) + 1) * 2.0**-53
        at = at - np.log(uniform) / live_w
        np.minimum.at(best, register, at)
        won = best[register] == at
        who[register[won]] = live_h[won]
        stay = at < best.reshape(-1, m).max(axis=1)[live_d]
        live_h, live_w, live_d, at = live_h[stay], live_w[stay], live_d[stay], at[stay]
    return who.reshape(-1, m)


def sketches(texts: list[bytes | None], rows: int = ROWS, bands: int = BANDS) -> dict[str, list]:
    """Of each text, one 64-bit key per band; None for a text without words."""
    sets = [shingles(t) for t in texts]
    full = [i for i, (h, _) in enumerate(sets) if len(h)]
    out: dict[str, list] = {"bands": [None] * len(texts)}
    if full:
        parts = signatures([sets[i] for i in full], rows * bands).reshape(len(full), bands, rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(full), bands))
        for j in range(rows):
            key = mix(key * _U(GOLDEN) + parts[:, :, j])
        for i, one in zip(full, key.view(np.int64).tolist(), strict=True):
            out["bands"][i] = one
    return out


def _verified(pairs: DataFrame, at_least: float) -> DataFrame:
    """Of (a, b, text_a, text_b), the pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            left, right = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            ok = []
            for x, y in zip(left, right, strict=True):
                x, y = x.as_py(), y.as_py()
                if known[0] != y:
                    known = y, shingles(y)
                ok.append(probability_jaccard(shingles(x), known[1]) >= at_least - EPSILON)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar. ``texts``: node, text."""
    for side in ("a", "b"):
        pairs = join_hot(pairs, texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), [side])
    return _verified(pairs, at_least)


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text), one row for each wanted node; copies are reduced before they are shuffled. ``wanted``: digest, node."""
    same = F.any_value("text").alias("text")
    if wanted.count() * ROW_BYTES <= BROADCAST_BYTES:
        return base.join(F.broadcast(wanted), "digest").groupBy("node").agg(same)
    return base.where("digest is not null").groupBy("digest").agg(same).join(wanted, "digest").select("node", "text")


def _close(own: int, rest: np.ndarray, ids: np.ndarray, weights: np.ndarray, ends: np.ndarray, lane: np.ndarray, sets: list, at_least: float) -> np.ndarray:
    """Of the members ``rest``, those similar to member ``own``; ids and weights hold all sets one after the other, ``lane`` is all 0."""
    size = ends[rest + 1] - ends[rest]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(size.sum()) + np.repeat(ends[rest] - starts, size)
    mine = slice(ends[own], ends[own + 1])
    lane[ids[mine]] = weights[mine]
    x, y = lane[ids[at]], weights[at]
    lane[ids[mine]] = 0
    whole = lambda k: weights[ends[k] : ends[k + 1]].sum()
    if len(sets[own][0]) == whole(own) and (y == 1).all():  # weights of 1 alone: the share of common elements
        common = np.add.reduceat((x > 0).astype(np.int64), starts)
        return rest[common / (len(sets[own][0]) + size - common) >= at_least - EPSILON]
    total = np.add.reduceat(y, starts)
    most = np.add.reduceat(np.minimum(x / whole(own), y / np.repeat(total, size)), starts)  # never below the similarity
    return np.array([j for j in rest[most >= at_least - EPSILON] if probability_jaccard(sets[own], sets[j]) >= at_least - EPSILON], np.int64)


def _compared(open_: DataFrame, at_least: float) -> DataFrame:
    """Links (a, b) between different components of one bucket, by the exact similarity of whole texts, found in blocks.

    ``open_``: bucket, band, node, comp, bands, text. In each bucket the members of its largest component
    are held against all others, and the others against each other, block by block. A pair meets in the
    first band that it shares. A task merges components as it finds links and gives back only the links
    that merged some, fewer than its members; so a hot group is never listed as pairs.
    """
    bytes_ = F.octet_length("text")
    sizes = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_).alias("size"))
    shape = sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"),
        F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"),
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    shape = shape.select("bucket", "main", blocks(F.col("top.n"), F.col("top.size")).alias("x"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("y"))
    known = join_hot(open_, shape, ["bucket"]).withColumn("is_main", F.col("comp") == F.col("main"))
    named = known.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("x")).otherwise(F.col("y"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    o = F.col("own")
    tasks = F.when(F.col("is_main"), F.transform(every("y"), lambda j: task(0, o, j))).otherwise(
        F.concat(F.transform(every("x"), lambda i: task(0, i, o)), F.transform(every("y"), lambda k: task(1, F.least(o, k), F.greatest(o, k))))
    )
    dealt = named.select("bucket", "band", "node", "comp", "is_main", "own", "bands", "text", F.explode(tasks).alias("t")).select("*", "t.*").drop("t")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, main, own, band = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "is_main", "own", "band"))
        kind, i_own, j_own = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [shingles(t) for t in table.column("text").cast(pa.binary()).to_pylist()]
        _, ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        weights = np.concatenate([w for _, w in sets])
        ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in sets])])
        lane, root = np.zeros(ids.max() + 1), comp.copy()
        left = np.flatnonzero(~main) if kind == 0 else np.flatnonzero(own == i_own)
        right = np.flatnonzero(main) if kind == 0 else np.flatnonzero(own == j_own)
        a, b = [], []
        for i in left:
            others = right[right > i] if kind == 1 and i_own == j_own else right
            rest = others[root[others] != root[i]]
            rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == band[i]] if len(rest) else rest
            for j in _close(i, rest, ids, weights, ends, lane, sets, at_least) if len(rest) else ():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(max(node[i], node[j]))
                    b.append(min(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _base(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, text); the digest tells texts apart."""
    own = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.select("id", F.unhex(F.md5("text")).alias("digest"), "text")


def _classed(base: DataFrame, at_least: float, rows: int, bands: int) -> DataFrame:
    """(digest, first_id, copies, class_id, class_size, is_head) of every different text, as a table.

    Copies are collapsed by digest before any banding. In a bucket each text is held against the
    bucket's hub first: the member with the most company over all its buckets, which is where the
    source of many copies stands. Buckets that then still hold more than one component are compared
    exactly, on whole texts, in blocks of bounded size (see ``_compared``). So no bucket is listed as
    pairs, and every pair that shares a bucket is either in one component already or compared. Texts
    travel only for the members of shared buckets, once each, and then with their pairs or blocks.
    """
    out = T.StructType([T.StructField("bands", T.ArrayType(T.LongType()))])
    sketched = map_texts(base.where("digest is not null"), "text", lambda texts: sketches(texts, rows, bands), out, ["id", "digest"])
    grouped = sketched.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = cut(join_narrow(banded, shared, ["bucket"]))
    company = cut(met.groupBy("node").agg(F.sum("n").alias("company")))
    hubs = cut(join_narrow(met, company, ["node"]).groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub")))
    members = cut(join_narrow(met.drop("n"), hubs, ["bucket"]))
    texts = cut(_texts(base, cut(join_narrow(nodes.select("digest", "node"), company.select("node"), ["node"]))))

    pairs = members.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    comps = cut(components(_links(pairs, texts, at_least)))
    placed = cut(join_narrow(members, comps, ["node"], "left").select("bucket", "band", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = cut(placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket"))
    open_ = cut(join_narrow(placed, mixed, ["bucket"]))
    if not open_.isEmpty():
        own = join_narrow(nodes.select("node", "bands"), cut(open_.select("node").distinct()), ["node"])
        more = cut(_compared(open_.join(texts.join(own, "node"), "node"), at_least))
        if not more.isEmpty():
            comps = cut(components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))))

    linked = cut(join_narrow(nodes.select("node", "first_id", "copies"), comps, ["node"]))
    # a null key sorts last
    head = F.min_by("node", F.struct(F.col("first_id").isNull(), "first_id", "node"))
    classes = cut(linked.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), head.alias("head")))
    found = cut(join_narrow(linked.select("node", "comp"), classes, ["comp"]).select("node", "class_id", "class_size", (F.col("node") == F.col("head")).alias("is_head")))
    known = join_narrow(nodes.drop("bands"), found, ["node"], "left")
    alone = F.col("is_head").isNull()
    return cut(
        known.select(
            "digest", "first_id", "copies", F.when(alone, F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", "copies").alias("class_size"), (alone | F.col("is_head")).alias("is_head"),
        )
    )


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """One row per row of ``df``: key, digest (of the text), class_id, class_size and kept.

    Texts of ``at_least`` probability Jaccard similarity over their weighted five-word shingles, and
    equal texts, are linked; a class is a connected component. class_id is its least key, class_size
    its number of rows; kept is true for the class's first row (rows that repeat both key and text
    are all marked alike). A key named like a new column comes back as ``<key>_of_input``. Words are as in operator 2. A text without words is linked to equal texts
    only. A null text has a null digest and is a class of its own. A null key sorts last. Other columns
    are not read. An empty table gives no rows.
    """
    base = _base(df, key, text)
    known = _classed(base, at_least, rows, bands)
    kept, name = F.col("is_head") & F.col("id").eqNullSafe(F.col("first_id")), key_name(key, ("digest", "class_id", "class_size", "kept"))
    found = join_hot(base.where("digest is not null").select("id", "digest"), known, ["digest"]).select(
        F.col("id").alias(name), "digest", "class_id", "class_size", kept.alias("kept")
    )
    alone = base.where("digest is null").select(
        F.col("id").alias(name), "digest", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return found.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", at_least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The rows of ``df``, one for each near-duplicate class; all columns as they were.

    The row that ``near_duplicates`` marks as kept stays; of rows that repeat both key and text, the
    one with the least hash over all its columns. Rows with a null text all stay. Only texts that are
    not alone in their class are looked up: their table is broadcast while it is small, and then no
    whole row is shuffled but the one that stays of rows with equal texts.
    """
    known = _classed(_base(df, key, text), at_least, rows, bands).where("class_size > 1").select("digest", "first_id", "copies", "is_head")
    fresh = {c: free_name(df, f"{c}_of_class") for c in known.columns}
    digest, first, copies, head = (F.col(fresh[c]) for c in ("digest", "first_id", "copies", "is_head"))
    own = df.withColumn(fresh["digest"], F.unhex(F.md5(F.col(f"`{text}`").cast("string"))))
    joined = join_narrow(own, cut(known.withColumnsRenamed(fresh)), [fresh["digest"]], "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    once = joined.where(head.isNull() | (head & (copies == 1))).select(*columns)
    several = joined.where(head & (copies > 1) & F.col(f"`{key}`").eqNullSafe(first))
    row = F.min_by(F.struct(*columns), F.struct(*row_key(df)))
    return once.unionByName(several.groupBy(digest).agg(row.alias("row")).select("row.*"))
