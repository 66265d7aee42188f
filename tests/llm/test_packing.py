"""Operator 6: the subset-sum, the plan and the placed pieces."""

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import catalog, packing

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 20), st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4))
@settings(max_examples=300, deadline=None)
def test_fill_is_as_full_as_can_be(room, counts):
    taken = packing.fill(room, counts)
    assert all(0 < n <= counts[x] for x, n in taken.items())
    every = itertools.product(*(range(n + 1) for n in counts.values()))
    assert sum(x * n for x, n in taken.items()) == max(s for s in (sum(x * n for x, n in zip(counts, c, strict=True)) for c in every) if s <= room)


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=12))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(counts):
    used: dict = {}
    for chosen, times in packing.plan(counts, 32):
        assert sum(x * n for x, n in chosen.items()) <= 32
        for x, n in chosen.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts


def check(rows, capacity):
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    ids = {r.sequence_id for r in rows}
    assert ids == set(range(len(ids)))
    return len(ids)


def test_pack_with_ties_nulls_and_clashes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 7 else None, int(n), "x") for i, n in enumerate(rng.integers(1, 65, 500))] + [(1, 3, "x")] * 200
    df = spark.createDataFrame(rows, "doc_id long, length long, Offset string")
    got = packing.pack(df, "length", ["doc_id"], 64).collect()
    assert len(got) == len(rows)
    n = check(got, 64)
    assert n <= 1.02 * -(-sum(r[1] for r in rows) // 64) + 1
    assert packing.pack(df.limit(0), "length", ["doc_id"], 64).count() == 0
    odd = df.unionByName(spark.createDataFrame([(1, None, "x"), (2, 0, "x")], df.schema))
    few = packing.pack(odd, "length", ["doc_id"], 10).collect()
    assert len(few) == len(rows) + 2
    assert all((r.sequence_id is None) == (r.offset is None) == (r.length is None or not 1 <= r.length <= 10) for r in few)
    check([r for r in few if r.sequence_id is not None], 10)


def test_query_holds_every_token_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = Tokenizer.from_file(catalog.tokenizer(catalog.WORD_BPE))
    ids = {k: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    rows = catalog.op6_bin_slack(spark, SF).collect()
    check(rows, 2048)
    for k, own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(ids[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[k])


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d " * 3000)], "doc_id long, text string")
    placed = packing.pack(packing.token_pieces(docs, catalog.tokenizer(catalog.WORD_BPE)), "length", ["doc_id", "start"])
    made = packing.sequences(placed).collect()
    assert all(len(r.ids) == 2048 for r in made) and len(made) == 2
    assert sum(x == 1 for r in made for x in r.ids) >= 3


def test_keys_named_like_new_columns(spark):
    df = spark.createDataFrame([(5, "a few words"), (6, None)], "n long, text string")
    for name in ("start", "length", "doc_tokens", "ids", "Ids_CRC32"):
        got = packing.token_pieces(df.withColumnRenamed("n", name), catalog.tokenizer(catalog.WORD_BPE), key=name)
        assert sorted(r[f"{name}_of_input"] for r in got.collect()) == [5, 6]
        assert packing.pack(got, "length", [f"{name}_of_input", "start"]).where("sequence_id is not null").count() == 2
