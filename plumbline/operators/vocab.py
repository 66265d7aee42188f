"""Vocabularies as (word, id) tables: counting, encoding, padding, decoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.stored import stored

# Reserved ids.
PAD, BOS, EOS, UNK = 0, 1, 2, 3
RESERVED = ("<pad>", "<bos>", "<eos>", "<unk>")
#: Words up to which a vocabulary is broadcast (about 64 MB); a larger one is joined by shuffle.
BROADCAST_WORDS = 1_000_000


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build(df: DataFrame, text: str, min_freq: int = 1) -> DataFrame:
    """(word, id, n): words of ``min_freq`` or more occurrences, ids from 4 on in code point order.

    Ids are places in one sorted list, found by range: each partition of the sorted words is numbered
    by itself and starts after the words of the partitions before it.
    """
    words = word_counts(df, text).where(F.col("n") >= min_freq)
    placed = words.withColumn("bucket", F.substring("word", 1, 3))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    # buckets are triples of token characters: at most 37 * 38 * 38 rows
    before = F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bucket", before.alias("start"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("word"))
    return placed.join(F.broadcast(starts), "bucket").select("word", (F.col("start") + nth + UNK).cast("long").alias("id"), "n")


def itos(vocab: DataFrame) -> DataFrame:
    """(id, word) with the reserved words."""
    spark = vocab.sparkSession
    head = spark.createDataFrame(list(enumerate(RESERVED)), "id long, word string")
    return head.unionByName(vocab.select("id", "word"))


class Vocabulary:
    """A (word, id) table that is measured once: up to BROADCAST_WORDS words it is broadcast and looked up in place."""

    def __init__(self, table: DataFrame):
        self.table = table

    @cached_property
    def broadcast(self) -> Broadcast | None:
        """Words and ids as arrays; None if there are too many. The one action: it reads one word more than the bound."""
        found = self.table.select("word", "id").limit(BROADCAST_WORDS + 1).toArrow()
        if len(found) > BROADCAST_WORDS:
            return None
        return self.table.sparkSession.sparkContext.broadcast((found["word"].combine_chunks(), found["id"].combine_chunks()))


#: What this worker looks up, by kind: the broadcast value that it was made of, and the tables, made once for all batches.
_ready: dict[str, tuple] = {}


def _made(kind: str, vocab: Broadcast, make: Callable[[pa.Array, pa.Array], tuple]) -> tuple:
    value = vocab.value
    if kind not in _ready or _ready[kind][0] is not value:
        _ready[kind] = value, make(*value)
    return _ready[kind][1]


def _by_word(known: pa.Array, own: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, their ids): words stay in Arrow, as a million of them would be 100 MB of Python objects in every worker."""
    return known, own.to_numpy()


def _by_id(known: pa.Array, own: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(ids in order, their words), the unknown word's too."""
    ids = np.append(own.to_numpy(), UNK)
    order = np.argsort(ids, kind="stable")
    return ids[order], pa.concat_arrays([known.cast(pa.string()), pa.array([RESERVED[UNK]])]).take(pa.array(order))


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _looked_up(lists: pa.Array, known: pa.Array, own: np.ndarray) -> pa.Array:
    """Ids of lists of words; only a batch's different words are looked for."""
    said = lists.flatten().dictionary_encode()
    at = pc.index_in(said.dictionary, value_set=known.cast(said.dictionary.type)).fill_null(-1).to_numpy(zero_copy_only=False)
    found = np.append(own, UNK)[at]  # -1 is the last place
    return pa.ListArray.from_arrays(_offsets(lists), pa.array(found[said.indices.to_numpy()], pa.int64()))


def _in_place(vocab: Broadcast, words: Column) -> Column:
    """Ids of an array of words, a batch at a time; 3 for unknown words."""

    @F.arrow_udf("array<bigint>")
    def ids(lists: pa.Array) -> pa.Array:
        return _looked_up(lists, *_made("words", vocab, _by_word))

    return ids(words)


def _numbered(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name, _row): rows told apart by a number that is stored with them, so keys may repeat or be null."""
    return stored(df.select(key, value.alias(name)).withColumn("_row", F.monotonically_increasing_id()))


def encode(df: DataFrame, key: str, text: str, vocab: Vocabulary, most: int | None = None) -> DataFrame:
    """(key, ids), one row for each row of ``df``: begin id, ids, end id; at most ``most`` in all if given. A text
    without tokens, or a null one, has just the two. Keys may repeat and be null.

    No shuffle while the vocabulary can be broadcast; beyond, tokens are joined and gathered by row.
    """
    toks = tokens(F.col(text))
    toks = F.coalesce(toks if most is None else F.slice(toks, 1, max(0, most - 2)), F.array().cast("array<string>"))
    begin, end = (F.array(F.lit(x).cast("long")) for x in (BOS, EOS))
    if vocab.broadcast is not None:
        return df.select(key, _in_place(vocab.broadcast, toks).alias("ids")).select(key, F.concat(begin, "ids", end).alias("ids"))
    # a row without tokens stays as one row of a null word, so nothing has to be joined back
    long = _numbered(df, key, toks, "toks").select(key, "_row", F.posexplode_outer("toks").alias("pos", "word")).join(vocab.table.select("word", "id"), "word", "left")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).cast("long").alias("id")))
    own = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["id"])  # collect_list leaves nulls out
    return long.groupBy("_row").agg(F.first(key).alias(key), own.alias("own")).select(key, F.concat(begin, "own", end).alias("ids"))


def padded(encoded: DataFrame, batch: str, ids: str = "ids") -> DataFrame:
    """``ids`` filled on the right with 0 up to the longest of its batch."""
    widest = encoded.groupBy(batch).agg(F.max(F.size(ids)).alias("_w"))
    joined = encoded.join(widest, batch)
    fill = F.array_repeat(F.lit(PAD).cast("long"), F.col("_w") - F.size(ids))
    return joined.withColumn(ids, F.concat(ids, fill)).drop("_w").select(*encoded.columns)


def decode(encoded: DataFrame, key: str, ids: str, vocab: Vocabulary) -> DataFrame:
    """(key, text), one row for each row of ``encoded``: words of the ids but 0, begin and end, and ids outside the
    vocabulary; 3 stays ``<unk>``. A null list reads as an empty one. Keys may repeat and be null."""
    if vocab.broadcast is not None:
        shared = vocab.broadcast

        @F.arrow_udf("array<string>")
        def words(lists: pa.Array) -> pa.Array:
            known, names = _made("ids", shared, _by_id)
            flat = lists.flatten()
            own = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            return pa.ListArray.from_arrays(_offsets(lists), names.take(pa.array(at, mask=known[at] != own)))

        return encoded.select(key, words(F.col(ids)).alias("w")).select(key, F.array_join("w", " ").alias("text"))
    long = _numbered(encoded, key, F.col(ids), "ids").select(key, "_row", F.posexplode_outer("ids").alias("pos", "id"))
    named = long.join(itos(vocab.table).where(F.col("id") >= UNK), "id", "left")
    pair = F.when(F.col("word").isNotNull(), F.struct("pos", "word"))
    ordered = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["word"])
    return named.groupBy("_row").agg(F.first(key).alias(key), F.array_join(ordered, " ").alias("text")).select(key, "text")
