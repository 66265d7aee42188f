"""Vector groups: top-K with padding, attention, relations, pooling, masks, beam steps, n-gram blocking.

Groups are rows with a group key, an order and a vector. Everything that looks at pairs works on the K
rows that ``top_k`` leaves in each group, so its size is bounded by K squared per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as v


def top_k(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group, with slot 0 to k - 1."""
    slot = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("slot", slot - 1).where(F.col("slot") < k)


def padded_top_k(df: DataFrame, group: str, order: str, vector: str, k: int, width: int) -> DataFrame:
    """(group, slot, order, vector, is_pad): k slots per group; missing ones are zero vectors."""
    kept = top_k(df, group, order, k).select(group, "slot", order, v.doubles(F.col(vector)).alias(vector))
    slots = df.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    zero = F.array_repeat(F.lit(0.0), width)
    return slots.join(kept, [group, "slot"], "left").select(
        group, "slot", order, F.coalesce(vector, zero).alias(vector), F.col(vector).isNull().alias("is_pad")
    )


def self_pairs(df: DataFrame, group: str, order: str, vector: str, k: int) -> DataFrame:
    """(group, i, j, vi, vj): all ordered pairs, self pairs too, of the first k rows of each group."""
    kept = top_k(df, group, order, k).select(group, "slot", v.doubles(F.col(vector)).alias("x"))
    left = kept.select(group, F.col("slot").alias("i"), F.col("x").alias("vi"))
    right = kept.select(group, F.col("slot").alias("j"), F.col("x").alias("vj"))
    return left.join(right, group)


def mean_vector(df: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Per key, the mean of its vectors by dimension."""
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"])
    return means.groupBy(*keys).agg(ordered.alias(name))


def weighted_pool(df: DataFrame, group: str, vector: str, score: Column) -> DataFrame:
    """(group, dim, value): vectors summed by softmax of their scores within the group."""
    own = df.select(group, F.col(vector).alias("x"), score.alias("s"))
    top = own.groupBy(group).agg(F.max("s").alias("top"))
    scaled = own.join(top, group).withColumn("e", F.exp(F.col("s") - F.col("top")))
    long = scaled.select(group, "e", F.posexplode("x").alias("dim", "value"))
    return long.groupBy(group, "dim").agg((F.sum(F.col("e") * F.col("value")) / F.sum("e")).alias("value"))


def dot_attention(df: DataFrame, group: str, vector: str, query: str) -> DataFrame:
    return weighted_pool(df, group, vector, v.dot(F.col(vector), F.col(query)))


def tanh_attention(df: DataFrame, group: str, vector: str, query: str) -> DataFrame:
    return weighted_pool(df, group, vector, v.total(F.zip_with(vector, query, lambda x, q: F.tanh(x + q))))


def relation_mean(df: DataFrame, group: str, order: str, vector: str, k: int) -> DataFrame:
    """(group, slot, vector): each row plus the mean over all j, itself too, of the products with row j."""
    pairs = self_pairs(df, group, order, vector, k)
    edges = pairs.withColumn("edge", v.fused(F.col("vi"), F.col("vj"), "mul"))
    means = mean_vector(edges, [group, "i"], "edge", "m")
    kept = top_k(df, group, order, k).select(group, F.col("slot").alias("i"), v.doubles(F.col(vector)).alias("x"))
    return kept.join(means, [group, "i"]).select(group, F.col("i").alias("slot"), v.fused(F.col("x"), F.col("m"), "add").alias(vector))


def question_context(df: DataFrame, key: str, ids: str, table: DataFrame | None, id_: str, vector: str, width: int) -> DataFrame:
    """(key, vector): mean of the vectors looked up for all ids of a row, padding ids too; zeros where a row has no ids.

    ValueError if there are ids but no table to look them up in.
    """
    if table is None:
        raise ValueError("ids need a table of vectors")
    counts = df.select(key, F.explode(ids).alias(id_)).groupBy(key, id_).agg(F.count(F.lit(1)).alias("times"))
    return counted_context(df.select(key), counts, key, "times", table, id_, vector, width)


def counted_context(keys: DataFrame, counts: DataFrame, key: str, times: str, table: DataFrame, id_: str, vector: str, width: int) -> DataFrame:
    """(key, vector): mean of the vectors of each key's ids, each as often as ``times`` says; zeros where a key has none.

    ``counts``: key, id, times, one row a pair; so a key of many ids is a number of rows, never a list. Ids are
    joined with whole vectors, and partial sums of ``width`` numbers are made before the shuffle by key.
    """
    weighed = counts.join(table.select(id_, v.doubles(F.col(vector)).alias("_x")), id_)
    sums = [F.sum(F.col(times) * F.get("_x", F.lit(d))).alias(f"s{d}") for d in range(width)]
    pooled = weighed.groupBy(key).agg(F.sum(times).alias("_n"), *sums).select(key, F.array(*(F.col(f"s{d}") / F.col("_n") for d in range(width))).alias(vector))
    return keys.select(key).join(pooled, key, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), width)))


def up_to_first(df: DataFrame, group: str, order: str, ends: Column) -> DataFrame:
    """Rows up to and with the first of their group where ``ends`` is true; all rows if there is none."""
    first = df.where(ends).groupBy(group).agg(F.min(order).alias("_end"))
    joined = df.join(first, group, "left")
    return joined.where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def blocked_words(toks: Column, n: int) -> Column:
    """Words that would complete an n-gram which a token array already has, given its last n - 1 tokens."""
    def found(own: Column) -> Column:
        size = F.size(own)
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        tail = F.slice(own, F.greatest(size - (n - 2), F.lit(1)), n - 1)
        grams = F.transform(starts, lambda i: F.struct(*(F.get(own, i + (k - 1)).alias(f"w{k}") for k in range(n))))
        same = v.let(tail, lambda last: F.filter(grams, lambda g: reduce(lambda a, b: a & b, (g[f"w{k}"] == F.get(last, F.lit(k)) for k in range(n - 1)))))
        return F.array_sort(F.array_distinct(F.transform(same, lambda g: g[f"w{n - 1}"])))

    return v.let(toks, found)


def beam_step(beams: DataFrame, item: str, beam: str, score: str, log_probs: str, width: int, finished: Column | None = None, pad: int = 0) -> DataFrame:
    """(item, nth, parent, token, score): the best ``width`` continuations over all beams of an item.

    Finished beams can only be followed by ``pad``, at no cost. Ties go to the lower beam, then token.
    """
    logs = v.doubles(F.col(log_probs))
    if finished is not None:
        frozen = F.transform(logs, lambda x, i: F.when(i == pad, 0.0).otherwise(float("-inf")))
        logs = F.when(finished, frozen).otherwise(logs)
    long = beams.select(item, F.col(beam).alias("parent"), F.col(score).alias("s"), F.posexplode(logs).alias("token", "lp"))
    summed = long.select(item, "parent", "token", (F.col("s") + F.col("lp")).alias("score"))
    nth = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "parent", "token"))
    return summed.withColumn("nth", nth - 1).where(F.col("nth") < width)


def length_normalized_best(df: DataFrame, group: list[str], score: Column, length: Column, tie: str, alpha: float = 0.7) -> DataFrame:
    """Per group, the row of the best score over length to the power ``alpha``; ties go to the lowest ``tie``."""
    normed = score / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(alpha))
    return df.withColumn("norm", normed).groupBy(*group).agg(F.max_by(F.struct(tie, "norm"), F.struct("norm", -F.col(tie))).alias("b")).select(*group, f"b.{tie}", "b.norm")


def beam_search(start: DataFrame, step: DataFrame, item: str, bos: int, eos: int, width: int, max_len: int, alpha: float = 0.7, pad: int = 0) -> DataFrame:
    """(item, ids): beam decoding with a table of next-token log probabilities, step(token, log_probs).

    ``start`` has the items. A fixed number of steps, each a join and a ``beam_step``; beams that end
    are frozen. The best beam by length-normalised score is returned.
    """
    beams = start.select(item, F.lit(0).alias("beam"), F.lit(0.0).alias("score"), F.array(F.lit(bos)).alias("ids"), F.lit(False).alias("done"))
    for _ in range(max_len - 1):
        ready = beams.withColumn("token", F.element_at("ids", -1)).join(step, "token", "left").withColumn(
            "log_probs", F.coalesce("log_probs", F.array(F.lit(0.0)))
        )
        best = beam_step(ready, item, "beam", "score", "log_probs", width, F.col("done"), pad).withColumnRenamed("score", "new_score")
        old = beams.select(item, F.col("beam").alias("parent"), "ids", "done")
        beams = best.join(old, [item, "parent"]).select(
            item, F.col("nth").alias("beam"), F.col("new_score").alias("score"), F.concat("ids", F.array("token")).alias("ids"), (F.col("done") | (F.col("token") == eos)).alias("done")
        )
    length = F.size(F.filter("ids", lambda i: i != pad))
    normed = beams.withColumn("norm", F.col("score") / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(alpha)))
    return normed.groupBy(item).agg(F.max_by("ids", F.struct("norm", -F.col("beam"))).alias("ids"))
