"""Decoding loops over a table of next-token scores: one join a round for all items at once, until all have ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import coded
from plumbline.operators.tensor import blocked_words
from plumbline.stored import stored

#: Log probabilities are whole millionths, so that sums are exact and ties are ties everywhere.
UNIT = 1_000_000
END = "</s>"


def successors(df: DataFrame, toks: Column, most: int, end: str = END, made: DataFrame | None = None) -> DataFrame:
    """(token, successors): the first ``most`` that follow each token in all token arrays, each closed by ``end``.

    ``toks`` may be texts, too. A score is the log probability over all that follow the token. ``made``: the arrays as blocks, if they are there.
    """
    found = coded.frequent_pairs(coded.blocks(df, toks) if made is None else made, most, end)
    score = lambda n: F.round(F.lit(float(UNIT)) * F.ln(n / F.col("total"))).cast("long")
    scored = F.array_sort(F.zip_with("nexts", "counts", lambda w, n: F.struct((-score(n)).alias("cost"), w.alias("next"))))
    return found.select("token", F.transform(F.slice(scored, 1, most), lambda s: F.struct(s["next"].alias("next"), (-s["cost"]).alias("score"))).alias("successors"))


def best_successors(step: DataFrame, most: int) -> DataFrame:
    """(token, successors): the first ``most`` of each token, best first, equal ones by name. A table that has them stays."""
    if "successors" in step.columns:
        return step
    nth = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "next"))
    kept = step.withColumn("nth", nth).where(F.col("nth") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "next", "score")))
    return kept.groupBy("token").agg(F.transform(ordered, lambda s: F.struct(s["next"].alias("next"), s["score"].alias("score"))).alias("successors"))


def decode(
    start: DataFrame, step: DataFrame, item: str, width: int, most: int, end: str | None = END, alpha: float = 0.7, no_repeat: int = 3, cut_every: int = 4
) -> DataFrame:
    """(item, tokens, score, rounds): the best sequence of at most ``most`` tokens for every item.

    ``start``: item and its first token; ``step``: token, next, score (additive, higher is better), or token and its first
    ``width`` + ``most`` ``successors`` in order. Each round joins the last tokens of all open beams with their successors, leaves out what would complete an n-gram of
    ``no_repeat`` tokens that the beam has (0: nothing), and keeps the best ``width`` by score, then beam, then token. A
    beam that reaches ``end``, or has no successor, stays as it is. ``width`` 1 is the greedy loop. The winner has the
    best score over its length to the power ``alpha``; ties go to the first beam.

    Only ``width`` + ``most`` successors of a token can matter, as fewer than ``most`` are blocked, so hot tokens
    join few rows. Every ``cut_every`` rounds beams are stored, items whose beams have all ended are set aside, and the
    loop stops if none is left. An empty table of items gives no rows.
    """
    successors = stored(best_successors(step, width + most))
    beams = start.select(item, F.lit(0).alias("beam"), F.lit(0).cast("long").alias("score"), F.array("token").alias("tokens"), F.lit(False).alias("done"), F.lit(1).alias("rounds"))
    ended = []
    for r in range(2, most + 1):
        open_ = beams.withColumn("token", F.when(~F.col("done"), F.element_at("tokens", -1))).join(successors, "token", "left")
        free = F.col("successors")
        if no_repeat > 1:
            open_ = open_.withColumn("blocked", blocked_words(F.col("tokens"), no_repeat))
            free = F.filter(free, lambda s: ~F.array_contains("blocked", s["next"]))
        few = F.slice(free, 1, width)
        none = F.array(F.struct(F.lit(None).cast("string").alias("next"), F.lit(0).cast("long").alias("score")))
        go = F.when(F.coalesce(F.size(few), F.lit(0)) > 0, few).otherwise(none)
        long = open_.select(item, "beam", "tokens", "score", "rounds", F.explode(go).alias("s"))
        long = long.select(item, "beam", (F.col("score") + F.col("s.score")).alias("score"), "tokens", F.col("s.next").alias("next"), "rounds")
        nth = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "beam", "next"))
        best = long.withColumn("nth", nth).where(F.col("nth") <= width)
        over = F.col("next").isNull() if end is None else F.col("next").isNull() | (F.col("next") == end)
        beams = best.select(
            item, (F.col("nth") - 1).alias("beam"), "score", F.when(F.col("next").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("next"))).alias("tokens"), over.alias("done"),
            F.when(F.col("next").isNull(), F.col("rounds")).otherwise(F.lit(r)).alias("rounds"),
        )
        if (r - 1) % cut_every == 0 or r == most:
            marked = stored(beams.withColumn("all_done", F.min("done").over(Window.partitionBy(item))))
            ended.append(marked.where("all_done").drop("all_done"))
            beams = marked.where("not all_done").drop("all_done")
            if beams.isEmpty():
                break
    every = reduce(DataFrame.unionByName, ended, beams)
    norm = F.col("score") / F.pow(F.size("tokens").cast("double"), F.lit(alpha))
    return every.groupBy(item).agg(F.max_by(F.struct("tokens", "score", "rounds"), F.struct(norm, -F.col("beam"))).alias("b")).select(item, "b.tokens", "b.score", "b.rounds")


def _chains(origins: DataFrame, best: DataFrame) -> DataFrame:
    """(block, origin, chain): what follows each origin, ``longest`` tokens of it. Chains are followed once per different
    origin by joins, as many rounds as the longest run; no token table is held in one place."""
    longest = origins.groupBy("origin").agg(F.max("longest").alias("longest"))
    now = stored(longest.select("origin", F.col("origin").alias("token"), "longest", F.array().cast("array<string>").alias("chain")))
    ended = []
    while not now.isEmpty():
        on = now.join(best, "token", "left").withColumn("token", F.coalesce("next", "token"))
        on = stored(on.select("origin", "token", "longest", F.concat("chain", F.array("token")).alias("chain")))
        ended.append(on.where(F.size("chain") >= F.col("longest")))
        now = on.where(F.size("chain") < F.col("longest"))
    if not ended:
        return origins.select("block", "origin", F.array().cast("array<string>").alias("chain"))
    found = reduce(DataFrame.unionByName, ended).select("origin", "chain")
    return origins.join(found, "origin").select("block", "origin", F.slice("chain", F.lit(1), F.col("longest")).alias("chain"))


def scheduled_inputs(df: DataFrame, key: str, toks: str, step: DataFrame | None, share: float, seed: int) -> DataFrame:
    """(key, inputs): the tokens that a decoder is fed, for token lists or texts. The first is the target's; then each is, with probability ``share``,
    what the table says best after the input before it, and else the target's own.

    ``step``: as in ``decode``; None: what follows most often in the rows themselves. Draws depend on the seed, the key and
    the place alone, not on how rows lie. A run of r drawn places after a target token is the r-th best successor of it in
    a chain. Rows stay in blocks; only a block's different origins of runs are joined with their chains, and come back to
    it. A token without a successor is followed by itself. ``share`` 0 gives the targets. Keys are distinct; a null array
    stays null.
    """
    made = coded.blocks(df, F.col(toks), key, share, seed)
    if step is None:
        step = successors(df, F.col(toks), 1, made=made)
    best = stored(best_successors(step, 1).select("token", F.get("successors", F.lit(0))["next"].alias("next")))
    chains = _chains(stored(coded.run_origins(made)), best)
    return coded.with_chains(made, chains, key, df.schema[key].dataType, "inputs")
