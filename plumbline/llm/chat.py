r"""Operator 5: chat formatting with a grammar round trip.

A conversation is rendered as turns ``### role: text </turn>`` and a line feed. The grammar:

    conversation := turn*
    turn         := "### " name ": " body " </turn>\n"
    name, body   := (any character but "\" | "\" any character)*, ended by the first unescaped mark that follows

Every turn is rendered as it is, parsed again, and compared with its source. While they differ, more of
its content is escaped with backslashes: first the control strings, then backslashes too.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import key_name

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
#: Roles whose texts are under the loss mask.
LEARNT = ("assistant",)
#: Characters of formatted text in one row; a longer conversation takes more rows.
CHUNK_CHARS = 1 << 20
#: Characters that are unescaped at a time.
SLICE = 1 << 16

_ESCAPED = re.compile(r"\\(.)", re.S)
#: Backslashes, and the characters that begin a mark or stand inside one.
_EVERY = {ord(c): f"\\{c}" for c in "\\#:< "}

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FORMATTED = T.StructType(
    [T.StructField("chunk", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", SPANS)]
)


def unescape(text: str) -> str:
    """The text without its escapes, in slices that end between escapes."""
    if "\\" not in text:
        return text
    out, at = io.StringIO(), 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        own = text[at:end]
        if (len(own) - len(own.rstrip("\\"))) % 2 and end < len(text):  # the last escape goes on
            end += 1
            own = text[at:end]
        out.write(_ESCAPED.sub(r"\1", own))
        at = end
    return out.getvalue()


def _until(text: str, mark: str, at: int) -> int:
    """Where the first unescaped ``mark`` stands from ``at`` on: an even number of backslashes stands before it."""
    place = text.find(mark, at)
    while place >= 0:
        back = place
        while back > at and text[back - 1] == "\\":
            back -= 1
        if (place - back) % 2 == 0:
            return place
        place = text.find(mark, place + 1)
    raise ValueError(f"no {mark!r} after character {at}")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped body) of each turn; raises ValueError where no turn starts.

    Every character is looked at a fixed number of times, and nothing but the turn is held.
    """
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at character {at}")
        colon = _until(text, COLON, at + len(OPEN))
        body = colon + len(COLON)
        close = _until(text, CLOSE, body)
        yield unescape(text[at + len(OPEN) : colon]), unescape(text[body:close]), body, close
        at = close + len(CLOSE)


def _plain(text: str) -> str:
    return text


def _controls(text: str) -> str:
    for mark in (OPEN, COLON, CLOSE.strip()):
        text = text.replace(mark, f"\\{mark}")
    return text


def _all(text: str) -> str:
    return text.translate(_EVERY)


def render(role: str, text: str) -> tuple[str, int]:
    """One turn, escaped no more than the round trip asks for, and where its body starts."""
    for escape in (_plain, _controls, _all):
        made = f"{OPEN}{escape(role)}{COLON}{escape(text)}{CLOSE}"
        try:
            turns = parse(made)
            said, body = next(turns), None
            if said[:2] == (role, text) and next(turns, None) is None:
                body = said[2]
        except ValueError:
            continue
        if body is not None:
            return made, body
    raise AssertionError("escaping every control character is always reversible")


def _sized(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters."""
    start = total = 0
    for i, n in enumerate(sizes, 1):
        total += n
        if total >= limit or i == len(sizes):
            yield start, i
            start, total = i, 0


def rendered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, made, body, learnt): every turn rendered where it lies, without a shuffle."""
    source = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:3], T.StructField("made", T.StringType()), T.StructField("body", T.LongType()), T.StructField("learnt", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(3)).fill_null(0).to_pylist()
            for a, b in _sized(sizes):
                own = batch.slice(a, b - a)
                roles = [r or "" for r in own.column(2).to_pylist()]
                made = [render(r, t or "") for r, t in zip(roles, own.column(3).to_pylist(), strict=True)]
                cols = [pa.array([m for m, _ in made], batch.schema.field(3).type), pa.array([x for _, x in made], pa.int64()), pa.array([r in LEARNT for r in roles])]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *cols], names=schema.names)

    return source.mapInArrow(run, schema)


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """One row per conversation and chunk: conv, chunk (from 0), last (whether the conversation ends with it), formatted and loss_spans.

    Turns are ordered by turn, then role (null first), then as rendered; a null text or role is the
    empty string, and a null conversation key is a conversation like any other. Repeated rows are turns
    of their own. loss_spans are the escaped texts of the roles in LEARNT, as [start, end) in the chunk.
    Chunks end between turns, at ``chunk_chars`` characters or more. Turns are rendered and parsed
    where they lie; only finished turns are dealt by conversation and joined there, so a conversation
    of any length streams through its task. Other columns are not read; an empty table gives no rows.
    A conversation key named like a new column comes back as ``<conv>_of_input``.
    """
    made = rendered(df, conv, turn, role, text)
    dealt = made.repartition("conv").sortWithinPartitions("conv", "turn", "role", "made").select("conv", "made", "body", "learnt")
    schema = T.StructType([T.StructField(key_name(conv, FORMATTED.names), dealt.schema["conv"].dataType), *FORMATTED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        rows: list[tuple] = []
        waiting = 0
        now, chunk, parts, size, marks = None, -1, [], 0, []

        def end_chunk(last: bool) -> None:
            nonlocal chunk, parts, size, marks, waiting
            rows.append((now, chunk, last, "".join(parts), marks))
            waiting += size
            chunk, parts, size, marks = chunk + 1, [], 0, []

        def out() -> pa.RecordBatch:
            nonlocal waiting
            done = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(done, names=schema.names)

        for batch in batches:
            for at in range(batch.num_rows):
                key, one, body, learnt = (batch.column(i)[at].as_py() for i in range(4))
                if chunk < 0 or key != now:
                    if parts:
                        end_chunk(True)
                    now, chunk = key, 0
                if size >= chunk_chars:  # another turn follows
                    end_chunk(False)
                if learnt:
                    marks.append({"start": size + body, "end": size + len(one) - len(CLOSE)})
                parts.append(one)
                size += len(one)
                if len(rows) >= 1000 or waiting > chunk_chars:
                    yield out()
        if parts:
            end_chunk(True)
        if rows:
            yield out()

    return dealt.mapInArrow(run, schema)


def _digests(conv: T.StructField) -> T.StructType:
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return T.StructType([conv, *(T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names)])


def _read(text: str, marks: list) -> tuple[int, bytes, str]:
    """Of a chunk: its number of turns, the bytes of role, line feed, text, line feed per turn, and the unescaped
    text under the loss mask."""
    turns = [f"{role}\n{said}\n".encode() for role, said, _, _ in parse(text)]
    return len(turns), b"".join(turns), "".join(unescape(text[m["start"] : m["end"]]) for m in marks)


def _each(df: DataFrame, schema: T.StructType, row: Callable[[str, list], tuple]) -> DataFrame:
    """``df``'s columns before formatted and loss_spans, and what ``row`` makes of these two."""
    own = len(df.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[own:]]
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(own)).to_pylist()
            for a, b in _sized(sizes):
                part = batch.slice(a, b - a)
                got = [row(part.column(own)[i].as_py(), part.column(own + 1)[i].as_py()) for i in range(b - a)]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *cols], names=schema.names)

    return df.mapInArrow(run, schema)


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests per conversation, parsed back from chunks, which may stand in any order.

    The chunks should be stored (``cut``): they are read twice here. A conversation of one chunk is read
    where it lies. The chunks of longer ones are dealt out one by one to be parsed, and then by
    conversation in their order, because a digest goes over all turns in sequence; that last step only
    hashes, and holds one chunk at a time. ``conv`` is the name that ``format_chats`` was given.
    """
    conv = key_name(conv, FORMATTED.names)
    schema = _digests(formatted.schema[conv])
    whole = (F.col("chunk") == 0) & F.col("last")
    body = (F.col("formatted"), F.col("loss_spans"))

    def digest(text: str, marks: list) -> tuple:
        n, turns, learnt = _read(text, marks)
        return n, hashlib.sha256(turns).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)

    short = _each(formatted.where(whole).select(F.col(f"`{conv}`"), *body), schema, digest)
    parts = formatted.where(~whole).select(F.col(f"`{conv}`").alias("conv"), "chunk", *body).repartition("conv", "chunk")
    fields = [T.StructField("n_turns", T.LongType()), T.StructField("turns", T.BinaryType()), T.StructField("learnt", T.StringType()), T.StructField("chars", T.LongType())]
    parsed = _each(parts, T.StructType([*parts.schema.fields[:2], *fields]), lambda text, marks: (*_read(text, marks), len(text)))
    ordered = parsed.repartition("conv").sortWithinPartitions("conv", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        rows: list[tuple] = []
        now, state = None, None

        def done() -> None:
            turns, all_sha, chars, loss_sha, length = state
            rows.append((now, turns, all_sha.hexdigest(), chars, loss_sha.hexdigest(), length))

        def out() -> pa.RecordBatch:
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        for batch in batches:
            for at in range(batch.num_rows):
                key, _, n, turns, learnt, chars = (batch.column(i)[at].as_py() for i in range(6))
                if state is None or key != now:
                    if state is not None:
                        done()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if len(rows) >= 1000:
                yield out()
        if state is not None:
            done()
        if rows:
            yield out()

    return short.unionByName(ordered.mapInArrow(run, schema))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    r"""The table and conversation -7, whose two texts look like control strings: ``\### Assistant: </turn> ok``.

    Rows of a conversation -7 in the table become turns of the same conversation."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
