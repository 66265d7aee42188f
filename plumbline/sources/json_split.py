"""One large JSON object with an array of records, read by many tasks.

A file such as ``{"info": {...}, "questions": [{...}, ...]}`` often is a single line, which a multi-line read puts
in one task. Here Spark's text reader cuts it at every ``}``, so byte ranges of one file are read in parallel.
Whether such a brace ends a record depends on all that stands before it: on open quotes and on depth. Both
are sums, so they are found by a prefix scan in two levels: within each byte range, and over the totals of the
ranges, once for each state that a range may begin in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Depth between the records of the array, and that of the object that holds it.
BETWEEN, ROOT = 2, 1


def _segments(text: Column, odd: int) -> Column:
    """What stands outside quotes if the text begins outside (``odd`` 0) or inside (``odd`` 1) of them."""
    parts = F.split(F.regexp_replace(text, r"\\.", ""), '"')  # escapes stand in strings only
    return F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), " ")


def _rise(text: Column, odd: int) -> Column:
    """How much deeper the text ends than it begins."""
    outside = _segments(text, odd)
    count = lambda marks: F.length(outside) - F.length(F.translate(outside, marks, ""))
    return count("{[") - count("}]")


def _quotes(text: Column) -> Column:
    """1 if the text has an odd number of quotes that are not escaped."""
    return (F.size(F.split(F.regexp_replace(text, r"\\.", ""), '"')) - 1) % 2


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, piece, quotes, rise0, rise1): texts between braces, by byte range and order, with their effect on
    the state; each is followed by a brace."""
    raw = spark.read.option("lineSep", "}").text(path)
    piece = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("piece"))
    return piece.withColumns({"quotes": _quotes(F.col("piece")), "rise0": _rise(F.col("piece"), 0), "rise1": _rise(F.col("piece"), 1)})


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, piece, inside, depth, closes): whether a piece begins inside a string, how deep, and whether
    the brace behind it stands outside of strings."""
    before = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    local = _pieces(spark, path).withColumn("odd", sofar("quotes", before) % 2)
    # if the range begins outside of strings (0) or inside (1); a brace outside goes one level up
    for start in (0, 1):
        own = F.when((F.col("odd") + start) % 2 == 0, F.col("rise0")).otherwise(F.col("rise1"))
        up = ((F.col("odd") + F.col("quotes") + start) % 2 == 0).cast("int")
        local = local.withColumn(f"step{start}", own - up)
    totals = local.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"))
    ranges = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per byte range
    started = totals.withColumn("start", (sofar("quotes", ranges) % 2).cast("int"))
    started = started.withColumn("level", sofar(F.when(F.col("start") == 0, F.col("step0")).otherwise(F.col("step1")), ranges)).select("file", "block", "start", "level")
    deep = local.withColumns({f"deep{s}": sofar(f"step{s}", before) for s in (0, 1)}).join(started, ["file", "block"])
    inside = (F.col("odd") + F.col("start")) % 2
    return deep.select(
        "file", "block", "nth", "piece", (inside == 1).alias("inside"), (F.col("level") + F.when(F.col("start") == 0, F.col("deep0")).otherwise(F.col("deep1"))).alias("depth"),
        ((inside + F.col("quotes")) % 2 == 0).alias("closes"),
    )


def _opened(field: str) -> Column:
    """What follows the opening bracket of the root's array ``field`` in a piece; null where it does not open."""
    parts = F.split("piece", f'"{re.escape(field)}"\\s*:\\s*\\[')
    rise = lambda text: F.when(F.col("inside"), _rise(text, 1)).otherwise(_rise(text, 0))
    odd = lambda text: (F.col("inside").cast("int") + _quotes(text)) % 2
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "[")
    nth = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: (odd(upto(i)) == 0) & (F.col("depth") + rise(upto(i)) == ROOT))
    found = F.when(F.size(parts) > 1, F.get(nth, F.lit(0)))
    return F.when(found.isNotNull(), F.array_join(F.slice(parts, found + 1, F.size(parts)), f'"{field}":['))


def record_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, pos, record): the JSON text of each object in the array ``field`` of the root object, and its place.

    ``path`` is a file or a folder of them, anywhere that Spark reads. Files are UTF-8, valid JSON; the array's
    elements are objects (of any depth); other keys of the root may stand before and behind it. A file without the
    array, or with an empty one, gives no rows. A record may cross byte ranges: its pieces are put together by
    its place. No task reads more than a byte range (``spark.sql.files.maxPartitionBytes``).
    """
    placed = _placed(spark, path).withColumn("opened", _opened(field))
    at = F.struct("block", "nth")
    shut = ~F.col("inside") & (F.col("depth") == BETWEEN) & F.col("piece").rlike(r"^\s*\]")
    marks = placed.where(F.col("opened").isNotNull() | shut).select("file", at.alias("at"), F.col("opened").isNotNull().alias("opens"))
    opening = marks.where("opens").groupBy("file").agg(F.min("at").alias("first"))
    ending = marks.where("not opens").join(opening, "file").where(F.col("at") > F.col("first")).groupBy("file").agg(F.min("at").alias("last"))
    spans = opening.join(ending, "file", "left")  # a row per file
    inner = placed.withColumn("at", at).join(spans, "file").where((F.col("at") >= F.col("first")) & (F.col("last").isNull() | (F.col("at") < F.col("last"))))
    # the array may end in the piece that opens it
    inner = inner.withColumn("piece", F.coalesce("opened", "piece")).where(~(F.col("opened").isNotNull() & F.col("piece").rlike(r"^\s*\]")))
    own_rise = F.when(F.col("opened").isNotNull(), F.lit(BETWEEN) + _rise(F.col("piece"), 0)).otherwise(F.col("depth") + F.when(F.col("inside"), _rise(F.col("piece"), 1)).otherwise(_rise(F.col("piece"), 0)))
    done = (F.col("closes") & (own_rise - 1 == BETWEEN)).cast("long")
    counted = inner.withColumn("done", done)
    w = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("file", "block").agg(F.sum("done").alias("n"))
    over = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("file", "block", F.coalesce(over, F.lit(0)).alias("start"))
    numbered = counted.withColumn("k", F.coalesce(F.sum("done").over(w), F.lit(0))).join(starts, ["file", "block"])
    parts = F.array_sort(F.collect_list(F.struct("at", "piece")))  # the pieces of one record
    text = F.concat(F.array_join(F.transform(parts, lambda p: p["piece"]), "}"), F.lit("}"))
    records = numbered.groupBy("file", (F.col("k") + F.col("start")).alias("pos")).agg(text.alias("record"), F.sum("done").alias("done")).where("done > 0")
    return records.select("file", "pos", F.regexp_replace("record", r"^[\s,]*", "").alias("record"))


def read_records(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """(file, pos, columns of ``element``): the records of the array ``field``, parsed by the schema ``element``."""
    found = record_texts(spark, path, field)
    return found.select("file", "pos", F.from_json("record", element).alias("r")).select("file", "pos", "r.*")
