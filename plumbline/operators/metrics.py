"""Caption and answer metrics over long tables: accuracies, BLEU, CIDEr-D, cross-entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import plain_answer
from plumbline.functions.vectors import log_sum_exp
from plumbline.operators import grams

ORDERS = (1, 2, 3, 4)
#: Width of the length penalty of CIDEr-D.
SIGMA = 6.0


def soft_accuracy(predicted: Column, answers: Column) -> Column:
    """A third per annotator who gave the predicted answer, at most 1; ``answers`` is an array."""
    said = plain_answer(predicted)
    return F.least(F.size(F.filter(answers, lambda a: plain_answer(a) == said)) / F.lit(3.0), F.lit(1.0))


def predicted_text(ids: Column, words: Column) -> Column:
    """Text of predicted ids above 2 and inside ``words`` (an array by id); it does not stop at the end id."""
    inside = F.filter(ids, lambda i: (i > 2) & (i < F.size(words)))
    return plain_answer(F.array_join(F.transform(inside, lambda i: F.get(words, i)), " "))


def token_accuracy(target: Column, predicted: Column, pad: Column | int = 0) -> Column:
    """Share of targets other than ``pad`` that are predicted; 0 without any. An aggregate."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    counts = target != pad
    right = F.sum(F.when(counts & (target == predicted), 1).otherwise(0))
    return F.coalesce(F.try_divide(right.cast("double"), F.sum(F.when(counts, 1).otherwise(0)).cast("double")), F.lit(0.0))


def mean_of_batch_means(df: DataFrame, batch: Sequence[str], value: Column) -> DataFrame:
    """batch_mean (each batch counts alike) and mean (each row counts alike)."""
    per = df.groupBy(*batch).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.agg(F.avg("m").alias("batch_mean"), (F.sum("s") / F.sum("c")).alias("mean"))


def bleu(hyps: DataFrame, refs: DataFrame, group: str, toks: str, orders: Sequence[int] = ORDERS, blocks: DataFrame | None = None) -> DataFrame:
    """(n, clipped, total, bleu): corpus BLEU-n with clipped counts and the closest reference length.

    ``hyps``: one row per group; ``refs``: any number of rows. Counts are clipped in the blocks of
    ``grams.blocks`` (made here unless given), so that only the hypotheses' n-grams are shuffled. Clipped counts
    and lengths are one row each; everything after is arithmetic on that row.
    """
    met = grams.clipped(grams.blocks(refs, group, toks, hyps) if blocks is None else blocks, orders)
    clipped = met.agg(*(F.coalesce(F.sum(F.when(F.col("n") == n, F.col("clipped"))), F.lit(0)).alias(f"clipped_{n}") for n in orders))
    sizes = hyps.select(group, F.size(toks).alias("hyp_len"))
    lens = refs.select(group, F.size(toks).alias("ref_len")).distinct().join(sizes, group)
    apart = F.abs(F.col("ref_len") - F.col("hyp_len"))
    close = lens.groupBy(group).agg(F.min_by("ref_len", F.struct(apart, "ref_len")).alias("ref_len"))
    totals = [F.coalesce(F.sum(F.greatest(F.col("hyp_len") - (n - 1), F.lit(0))), F.lit(0)).alias(f"total_{n}") for n in orders]
    sums = sizes.join(close, group, "left").agg(F.coalesce(F.sum("hyp_len"), F.lit(0)).alias("hyp_len"), F.coalesce(F.sum("ref_len"), F.lit(0)).alias("ref_len"), *totals)
    one = sums.crossJoin(F.broadcast(clipped))  # one row each
    share = {n: F.coalesce(F.try_divide(F.col(f"clipped_{n}").cast("double"), F.col(f"total_{n}").cast("double")), F.lit(0.0)) for n in orders}
    shortness = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") > F.col("ref_len"), 1.0).otherwise(
        F.exp(1.0 - F.col("ref_len") / F.greatest(F.col("hyp_len"), F.lit(1)))
    )
    rows, log = [], F.lit(0.0)
    for n in orders:
        log = log + F.when(share[n] > 0, F.ln(share[n])).otherwise(-1e9)
        score = F.when(share[n] > 0, shortness * F.exp(log / n)).otherwise(0.0)
        rows.append(F.struct(F.lit(n).alias("n"), F.col(f"clipped_{n}").alias("clipped"), F.col(f"total_{n}").alias("total"), score.alias("bleu")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cider_d(hyps: DataFrame, refs: DataFrame, group: str, toks: str, orders: Sequence[int] = ORDERS, blocks: DataFrame | None = None) -> DataFrame:
    """(group, cider): ten times the mean over orders and references of the clipped TF-IDF cosine.

    References' n-grams meet only the n-grams of their own group's hypothesis, in the blocks of ``grams.blocks``
    (made here unless given); a pair without any in common counts as 0. Between blocks only document
    frequencies are exchanged. Null lists make no pair.
    """
    n_groups = refs.agg(F.count_distinct(group).alias("groups"))
    made = grams.blocks(refs, group, toks, hyps) if blocks is None else blocks
    sums = grams.cosines(made.crossJoin(F.broadcast(n_groups)), orders, SIGMA).groupBy("grp").agg((10.0 * F.sum("s") / F.sum("pairs")).alias("cider"))
    return sums.select(F.col("grp").alias(group), "cider")


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Loss of one row: -log softmax at ``target`` (0-based), mixed with the mean over classes."""
    log_sum = log_sum_exp(logits)
    hit = log_sum - F.get(logits, target.cast("int"))
    if not smoothing:
        return hit
    mean = log_sum - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / F.size(logits)
    return hit * (1.0 - smoothing) + mean * smoothing
