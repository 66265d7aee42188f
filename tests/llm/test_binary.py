"""Operator 9: Elias-Fano sequences, blocks and their reading."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import binary, catalog

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(-(2**62), 2**62), max_size=300), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_sequences_come_back(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.int64))
    ef = binary.EliasFano(binary.EliasFano.encode(values))
    assert ef.all().tolist() == values.tolist()
    some = np.arange(len(values))[::-1]
    assert ef.select(some).tolist() == values[::-1].tolist()
    assert [int(ef.select(np.array([i]))[0]) for i in some[:20]] == values[::-1][:20].tolist()
    with pytest.raises(IndexError):
        ef.select(np.array([len(values)]))


def test_space_is_near_the_minimum():
    ends = np.cumsum(np.random.default_rng(7).integers(200, 2000, 5000))
    assert len(binary.EliasFano.encode(ends)) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 32 / binary.SAMPLE + 1


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_order_nulls_repeats_and_long_texts(spark, tmp_path, block):
    texts = [(5, "b"), (-3, None), (7, "long " * 3000), (0, ""), (5, "b"), (2**40, "Ünï code")] + [(100 + i, f"t {i}") for i in range(200)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, key string")
    path = str(tmp_path / f"b{block}")
    binary.write_blocks(df, path, catalog.tokenizer(catalog.WORD_BPE), block_ids=block)
    got = sorted(binary.read_blocks(spark.read.parquet(path)).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(catalog.tokenizer(catalog.WORD_BPE)), 0
    for r, (k, t) in zip(got, sorted(texts, key=lambda x: x[0]), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.key, r.start, r.n_tokens, r.ids) == (k, at, len(ids), ids)
        at += len(ids)
    empty = str(tmp_path / f"e{block}")
    binary.write_blocks(df.limit(0), empty, catalog.tokenizer(catalog.WORD_BPE))
    assert binary.read_blocks(spark.read.schema(binary.BLOCK).parquet(empty)).count() == 0


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_null_keys_stand_first(spark, tmp_path, block):
    df = spark.createDataFrame([(4, "x"), (None, "a b"), (-9, "y"), (None, "a b"), (None, None)], "doc_id long, text string")
    path = str(tmp_path / f"n{block}")
    binary.write_blocks(df, path, catalog.tokenizer(catalog.WORD_BPE), block_ids=block)
    got = sorted(binary.read_blocks(spark.read.parquet(path)).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, None, None, -9, 4]
    assert sorted(r.n_tokens for r in got[:3]) == [1, 3, 3] and [r.start for r in got[3:]] == [7, 9]


def test_query_against_the_library(spark):
    tok, at = Tokenizer.from_file(catalog.tokenizer(catalog.WORD_BPE)), 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sorted(catalog.op9_elias_fano(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
