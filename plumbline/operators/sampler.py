"""The order of an epoch without a sort: a keyed bijection of places, dealt to ranks of equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import numbered

ROUNDS = 4
#: Steps after which a walk that has not come back below n is an error. Each leaves with a chance of at least one half.
WALK = 128


def permuted(place: Column, n: int, key: str) -> Column:
    """A place from 0 to n - 1 sent to another one, each to a different one.

    A Feistel network of ROUNDS rounds on just enough bits; results of n or more are sent on until they are
    below n, which keeps it a bijection.
    """
    bits = max(2, (n - 1).bit_length())
    left, right = bits // 2, bits - bits // 2
    rounds = F.array(*(F.struct(F.lit(r).alias("r"), F.lit((1 << (left, right)[r % 2]) - 1).cast("long").alias("mask")) for r in range(ROUNDS)))
    word = lambda r, x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(key), r.cast("string"), x.cast("string"))), 1, 8), 16, 10).cast("long")

    def sent(x: Column) -> Column:
        halves = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit((1 << right) - 1).cast("long")).alias("r"))
        out = F.aggregate(rounds, halves, lambda s, k: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(word(k["r"], s["r"]).bitwiseAND(k["mask"])).alias("r")))
        return F.transform(F.array(out), lambda s: F.shiftleft(s["l"], right) + s["r"])[0]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), place.cast("long"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(sent(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")))


def dealt(df: DataFrame, order: str, world: int, seed: int, epochs: list[int], shuffle: bool = True) -> DataFrame:
    """``df`` with epoch, rank and slot: every row once per epoch, and then the first ones again until all of the ``world`` ranks
    have as many rows.

    Rows are numbered once by ``order`` (a number; equal ones in any order); an epoch's order is computed from a row's
    number alone, so it needs neither a sort nor a shuffle. Rank r takes the places r, r + world, ...
    """
    if world < 1:
        raise ValueError("there must be at least one rank")
    n = df.count()
    rows = numbered(df, [], order, "_nth")
    total = -(-n // world) * world
    parts = []
    for e in epochs:
        place = permuted(F.col("_nth"), n, str(seed + e)) if shuffle and n else F.col("_nth")
        parts.append(F.struct(F.lit(e).alias("epoch"), place.alias("place")))
    per_epoch = rows.select("*", F.explode(F.array(*parts)).alias("_e")).select(*df.columns, "_e.epoch", F.col("_e.place").alias("_place"))
    every = per_epoch.select(*df.columns, "epoch", F.explode(F.sequence("_place", F.lit(max(0, total - 1)).cast("long"), F.lit(max(1, n)).cast("long"))).alias("_at"))
    return every.select(*df.columns, "epoch", (F.col("_at") % world).cast("int").alias("rank"), F.floor(F.col("_at") / world).cast("long").alias("slot"))
