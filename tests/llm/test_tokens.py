"""Operator 7, and the encoder behind operators 6 and 9: the library's own ids for any text."""

import random
import sys
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm import catalog, tokens

SF = "/root/testdata/sf0.001"
PATHS = [catalog.tokenizer(n) for n in (catalog.BYTE_BPE, catalog.WORD_BPE)]
PARTS = [
    "the", "Thé", "é", "<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\n\n", "\t", " ", "'s", "'re", "12", "345", "!!", "...", ",", "ab", "Ö", "́", "İ",
    "ß", "\x1c", "\x85", "\r\n", " ", "日本", "👍🏽", "</w>", "᠎", "​", "﻿", "\x0b", "Σ", "ς", "\x00", "'", "’s", "ſ", "K", "AB", "Word.",
]


LETTERS = [c for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))) if c.isalpha() or c.lower() != c or not is_normalized("NFC", c)]


def differing(texts, path, most):
    """Texts of which the encoder gives other ids, or another number of ids, than the library."""
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, counts = tokens.Encoder(path, True, most), tokens.Encoder(path, False, most)
    assert ids.cuttable
    bad = []
    for a in range(0, len(texts), 5000):
        own = pa.array(texts[a : a + 5000], pa.string())
        sizes, flat = ids.encode(own)
        assert counts.encode(own)[0].tolist() == sizes.tolist()
        got = np.split(flat, np.cumsum(sizes)[:-1])
        bad += [t for t, g, w in zip(own.to_pylist(), got, want[a : a + 5000], strict=True) if g.tolist() != w]
    return bad


@pytest.mark.parametrize("path", PATHS)
def test_every_letter_beside_every_mark(path):
    assert tokens.MARKS == b".,!?;:"
    assert differing([f".{c}. {c},{c}! {c}?{c};:{c}:" for c in LETTERS], path, 1000) == []


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize(("most", "window"), [(10, 64), (2000, 4 << 20)])
def test_same_ids_as_the_library(path, most, window, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", window)
    rng = random.Random(4)
    texts = ["".join(rng.choice(rng.choice((PARTS, PARTS, LETTERS))) for _ in range(rng.randint(0, 24))) for _ in range(15_000)]
    assert differing([*texts, None, "", "a " * 100_000 + "b" * 70_000], path, most) == []


def test_other_tokenizers_see_whole_texts(tmp_path):
    other = Tokenizer.from_file(PATHS[0])
    other.add_special_tokens(["<two words>"])  # a cut would part this one
    other.save(str(tmp_path / "t.json"))
    enc = tokens.Encoder(str(tmp_path / "t.json"))
    assert not enc.cuttable
    sizes, flat = enc.encode(pa.array(["a <two words> b", None]))
    assert sizes.tolist() == [len(flat), 0] and flat.tolist() == other.encode("a <two words> b").ids


def test_counts_nulls_repeats_and_clashes(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, N_Tokens string")
    for path in (PATHS[0], catalog.tokenizer("piece_bpe_32k.model")):
        got = tokens.token_counts(df, path).collect()
        assert sorted((r.n_bytes, r.n_tokens > 0) for r in got) == [(0, False), (0, False), (1, True), (11, True), (11, True)]
        assert tokens.token_counts(df.limit(0), path).count() == 0


def test_query_against_the_library(spark):
    library = Tokenizer.from_file(PATHS[0])
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.op7_token_counts(spark, SF).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
