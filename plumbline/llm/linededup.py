"""Operator 8: removal of repeated line runs, by a suffix array over line ids.

Suffixes are the positions of non-blank lines. Prefix doubling ranks them by their first 1, 2, 4, ...
lines: a rank at depth 2h comes from the pair (rank at depth h of the position, rank at depth h of the
position h lines on), numbered in sorted order, so equal ranks are neighbours in the suffix array and
share 2h lines. Positions whose prefix occurs once are settled and leave the rounds. Two ranks name any
block of lines of a length in between, so the longest-common-prefix intervals at the depth of a block
(a run of lines that has just enough words) are the groups of equal rank pairs. Blocks that occur
earlier mark the lines that they cover; together they cover every maximal repeated run of enough words.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, free_name, join_hot, row_key

#: A repeated run is removed if it has at least so many words.
MIN_WORDS = 50
#: White space inside a line (the line feed parts lines).
WHITE = " \t\x0b\f\r"


def _filled(text: str) -> Column:
    """The non-blank lines of a text."""
    return F.filter(F.split(F.col(f"`{text}`").cast("string"), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def _n_words(line: str) -> Column:
    """Words of a line without white space at its ends; where only single spaces part them, one more than the spaces."""
    odd = reduce(lambda a, b: a | b, (F.contains(line, F.lit(w)) for w in ("  ", *WHITE.strip(" "))))
    spaces = F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(line, f"[{WHITE}]+"))).otherwise(spaces + 1).cast("long")


def _lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """(id, hx, hy, pos, x, y, n): each non-blank line's document, place among them, line id (two hashes
    of the line without white space at its ends) and number of words. Rows equal in every column are one
    document: they share hx and hy."""
    hx, hy = row_key(df)
    cut_up = df.select(F.col(f"`{key}`").alias("id"), hx.alias("hx"), hy.alias("hy"), F.posexplode(_filled(text)).alias("pos", "line"))
    own = cut_up.withColumn("line", F.btrim("line", F.lit(WHITE)))
    return own.select("id", "hx", "hy", "pos", F.xxhash64("line").alias("x"), F.hash("line", F.lit(7)).alias("y"), _n_words("line").alias("n"))


def _repeated(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct values of ``by`` that occur twice or more, with a number that follows their sorted order."""
    groups = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*by)
    return cut(groups.orderBy(*by).withColumn(name, F.monotonically_increasing_id()))


def suffix_ranks(first: DataFrame, depth: int) -> DataFrame:
    """(h, hx, hy, pos, rank) for h = 1, 2, 4, ... up to ``depth``: positions whose next h lines occur elsewhere too.

    ``first`` has the ranks at depth 1. Rounds end early when no prefix is repeated any more. Every
    round's ranks are a table in the checkpoint folder.
    """
    now, h = first.select("hx", "hy", "pos", "rank"), 1
    out = now.withColumn("h", F.lit(h))
    while 2 * h <= depth:
        ahead = now.select("hx", "hy", (F.col("pos") - h).alias("pos"), F.col("rank").alias("then"))
        pairs = cut(now.join(ahead, ["hx", "hy", "pos"]))
        deeper = _repeated(pairs, ["rank", "then"], "deeper")
        if deeper.isEmpty():
            break
        h *= 2
        now = cut(pairs.join(deeper, ["rank", "then"]).select("hx", "hy", "pos", F.col("deeper").alias("rank")))
        out = out.unionByName(now.withColumn("h", F.lit(h)))
    return out


def _blocks(first: DataFrame, least: int) -> DataFrame:
    """(id, hx, hy, pos, m): for each line of a stretch of repeated lines, the shortest block of ``least``
    words or more that starts with it, and the shortest that ends with it, where the stretch has one."""
    doc = Window.partitionBy("hx", "hy").orderBy("pos")
    stretched = first.withColumn("stretch", F.col("pos") - F.row_number().over(doc))
    own = Window.partitionBy("hx", "hy", "stretch")
    ends = F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    summed = stretched.withColumn("ends", ends).withColumn("before", F.col("ends") - F.col("n"))
    ahead, behind = own.orderBy("before").rangeBetween(0, least - 1), own.orderBy("ends").rangeBetween(1 - least, 0)
    near = summed.withColumns(
        {
            "last": F.max("pos").over(ahead), "last_ends": F.max("ends").over(ahead),
            "start": F.min("pos").over(behind), "start_before": F.min("before").over(behind),
        }
    )
    forth = F.when(F.col("last_ends") - F.col("before") >= least, F.struct(F.col("pos").alias("p"), (F.col("last") - F.col("pos") + 1).alias("m")))
    back = F.when(F.col("ends") - F.col("start_before") >= least, F.struct(F.col("start").alias("p"), (F.col("pos") - F.col("start") + 1).alias("m")))
    found = near.select("id", "hx", "hy", F.explode(F.array_compact(F.array_distinct(F.array(forth, back)))).alias("b"))
    return found.select("id", "hx", "hy", F.col("b.p").alias("pos"), F.col("b.m").alias("m"))


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(hx, hy, runs): per document with later copies, the line ranges [start, stop) that they cover, merged."""
    lines = _lines(df, text, key)
    # a row that stands several times is one document: each of its lines is kept once
    first = cut(lines.join(_repeated(lines, ["x", "y"], "rank"), ["x", "y"]).select("id", "hx", "hy", "pos", "n", "rank").distinct())
    blocks = cut(_blocks(first, min_words))
    depth = blocks.agg(F.max("m")).first()[0] or 0
    ranks = suffix_ranks(first, depth)
    h = F.lit(1)
    for k in range(1, depth.bit_length()):
        h = F.when(F.col("m") >= 1 << k, F.lit(1 << k)).otherwise(h)
    # the greatest power of two first: later tests of the chain are the outer ones
    left = ranks.select("hx", "hy", "h", "pos", F.col("rank").alias("ra"))
    right = ranks.select("hx", "hy", "h", F.col("pos").alias("tail"), F.col("rank").alias("rb"))
    sized = blocks.withColumn("h", h).withColumn("tail", F.col("pos") + F.col("m") - F.col("h"))
    named = cut(sized.join(left, ["hx", "hy", "h", "pos"]).join(right, ["hx", "hy", "h", "tail"]).select("id", "hx", "hy", "pos", "m", "ra", "rb"))
    place = F.struct("id", "hx", "hy", "pos")
    earliest = named.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    later = join_hot(named, earliest, ["m", "ra", "rb"]).where(place != F.col("first"))
    spans = later.groupBy("hx", "hy", "pos").agg(F.max(F.col("pos") + F.col("m")).alias("stop"))
    doc = Window.partitionBy("hx", "hy").orderBy("pos")
    reached = F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", (F.coalesce(reached, F.lit(-1)) < F.col("pos")).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("hx", "hy", "island").agg(F.min("pos").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("hx", "hy").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with later copies of repeated line runs taken out of ``text``, and n_lines and n_removed_lines.

    A run of consecutive non-blank lines of at least ``min_words`` words in all is a later copy if the
    same lines stand earlier: in a document of lower ``key`` (null first; ties by a hash of the row), or
    further up in the same one, overlapping copies included. The first copy stays. Lines are compared
    without white space at their ends. A document that loses lines also loses its blank lines; any
    other keeps its text as it is. A null text stays null with 0 lines; a text whose lines are all
    copies becomes empty. Rows equal in every column are one document and get one result. Other
    columns pass, those with the names of the counts are replaced. An empty table gives no rows.
    """
    fresh = ("n_lines", "n_removed_lines")
    df = df.drop(*fresh)
    runs = repeated_runs(df, key, text, min_words)
    hx, hy, own = free_name(df, "hx"), free_name(df, "hy"), free_name(df, "runs")
    a, b = row_key(df)
    keyed = df.withColumns({hx: a, hy: b})
    runs = runs.select(F.col("hx").alias(hx), F.col("hy").alias(hy), F.col("runs").alias(own))
    joined = keyed.join(runs, [hx, hy], "left")
    gone = F.flatten(F.transform(own, lambda r: F.sequence(r["start"], r["stop"] - 1)))
    lines = _filled(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *(F.when(F.col(own).isNull(), F.col(f"`{c}`").cast("string")).otherwise(rebuilt).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns),
        F.coalesce(F.when(F.col(f"`{text}`").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col(own).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_removed_lines"),
    )
