"""Operator 5: every text survives the round trip."""

import hashlib
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import catalog, chat

SF = "/root/testdata/sf0.001"
ODD = st.lists(st.sampled_from(["\\", "### ", "###", ": ", ":", " </turn>\n", " </turn>", "</turn>", "\n", " ", "user", "a", "é", ""]), max_size=8).map("".join)


@given(st.lists(st.tuples(ODD, ODD), max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_turns_come_back(turns):
    made = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat.parse(made)] == turns


def test_plain_text_is_not_escaped():
    assert chat.render("user", "Hello: there")[0].count("\\") <= 1
    assert chat.render("user", "Hello there")[0] == "### user: Hello there </turn>\n"


def digests(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def test_nulls_ties_and_chunks(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (1, 2, None, "x"), (None, 0, "assistant", "é </turn>\n"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a")]
    rows += [(3, i, "assistant", "long " * 500) for i in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = {
        1: [("user", "a"), ("assistant", ""), ("", "x")], None: [("assistant", "é </turn>\n")], 2: [("assistant", x) for x in "abb"], 3: [("assistant", "long " * 500)] * 20,
    }
    for size in (100, chat.CHUNK_CHARS):
        made = chat.format_chats(df, chunk_chars=size)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_chats(made).collect()}
        assert got == {k: digests(v) for k, v in want.items()}
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_chunks_may_be_read_in_any_order(spark, tmp_path):
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i}: \\\\ ### {c} " * (i % 7)) for c in (1, None, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "chunks")
    chat.format_chats(df, chunk_chars=50).orderBy(F.rand(3)).write.parquet(path)
    read = spark.read.parquet(path)
    assert read.count() > 60
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_chats(read).collect()}
    assert got == {c: digests([r[2:] for r in rows if r[0] == c]) for c in (1, None, 3)}


@pytest.mark.parametrize("part", ["plain words of a text ", "\\\\: ### </turn>\n"])
def test_a_long_turn_takes_memory_in_proportion(part):
    text = part * ((2 << 20) // len(part))
    tracemalloc.start()
    made, _ = chat.render("user", text)
    ((role, said, _, _),) = chat.parse(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (role, said) == ("user", text) and peak < 16 * len(text)


def test_query_against_the_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = {-7: [(r, "\\### Assistant: </turn> ok") for r in ("user", "assistant")]}
    for r in rows:
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in catalog.op5_chat_round_trip(spark, SF).collect()}
    assert got == {k: digests(v) for k, v in said.items()}


def test_keys_named_like_new_columns(spark):
    df = spark.createDataFrame([(5, 0, "user", "hi"), (5, 1, "assistant", "well"), (6, 0, "user", "x")], "n long, turn long, role string, text string")
    for name in ("chunk", "last", "formatted", "loss_spans", "made"):
        made = chat.format_chats(df.withColumnRenamed("n", name), conv=name, chunk_chars=8)
        own = name if name == "made" else f"{name}_of_input"
        assert sorted((r[own], r.n_turns, r.loss_chars) for r in chat.read_chats(made, conv=name).collect()) == [(5, 2, 4), (6, 1, 0)]
