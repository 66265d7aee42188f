"""Operator 13: the transform against sorted suffixes, removed bytes against a plain search, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from plumbline.llm import catalog, suffixdedup
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    """[(n_bytes, removed byte places)] by looking every string up."""
    first = {}
    for key, text in rows:
        b, o = (text or "").encode(), suffixdedup.LAST if key is None else key
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, o), o)
    out = []
    for key, text in rows:
        b, o, gone = (text or "").encode(), suffixdedup.LAST if key is None else key, set()
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < o:
                gone.update(range(i, i + length))
        out.append((len(b), frozenset(gone)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transform_and_prefixes_against_sorted_suffixes(seed):
    rng = random.Random(seed)
    docs = [bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 40))] + [b"a" * 20] * (seed % 3)
    suffixes = sorted((d[i:], k) for k, d in enumerate(docs) for i in range(len(d) + 1))
    at = {(s, k): n for n, (s, k) in enumerate(suffixes)}
    bwt, lcp, origin = suffixdedup.collection_bwt(np.frombuffer(b"".join(docs), np.uint8), np.array([len(d) for d in docs]), 12)
    assert len(at) == len(bwt) == sum(len(d) + 1 for d in docs)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for n, (s, k) in enumerate(suffixes):
        d = docs[k]
        assert not s or origin[n - len(docs)] == at[s[1:], k]
        assert bwt[n] == (d[len(d) - len(s) - 1] if len(s) < len(d) else suffixdedup.FRONT)
        if n:
            assert lcp[n] == min(12, common(s, suffixes[n - 1][0]))


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "bravo", "größe", "delta", "漢字", "zulu", "x"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    shared = [text(12) for _ in range(4)] + ["a" * 200, "ab" * 70]
    rows = [(i, " ".join(rng.choice([text(rng.randint(1, 20)), rng.choice(shared)]) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    rows += [(rng.randrange(n), rows[3][1]), (7, rows[7][1]), (7, rows[9][1]), (None, rows[5][1] + "!"), (None, rows[5][1] + "!"), (None, text(30)), (1000, None), (1001, ""), (1002, "short"), (-5, rows[0][1]), (1003, "a" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,heavy", [(1, 1 << 15), (2, 3)])
def test_against_a_plain_search(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffixdedup, "STEP", 300)
    monkeypatch.setattr(suffixdedup, "COLLECTION_BYTES", 1000)
    rows = made(seed)
    df = spark.createDataFrame([(i, k, t, 1) for i, (k, t) in enumerate(rows)], "nth int, doc_id long, text string, SPANS int").repartition(3, "nth")
    for length in (50, 24):
        got = {r.nth: (r.n_bytes, frozenset(x for s in r.spans for x in range(s.start, s.end))) for r in suffixdedup.repeated_spans(df, length=length, keep=["nth"]).collect()}
        want = plain(rows, length)
        assert [got[i] for i in range(len(rows))] == want
        assert sum(len(g) for _, g in want) > 2000


def test_small_broadcasts_off_gives_the_same(spark, monkeypatch):
    rows = made(3)
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "nth int, doc_id long, text string")
    with_broadcast = sorted(map(str, suffixdedup.repeated_spans(df).collect()))
    monkeypatch.setattr(suffixdedup, "BROADCAST_BYTES", -1)
    assert sorted(map(str, suffixdedup.repeated_spans(df).collect())) == with_broadcast
    assert suffixdedup.repeated_spans(df.limit(0)).count() == 0
    assert "SPANS" not in suffixdedup.repeated_spans(df.withColumnRenamed("nth", "SPANS")).columns
    with pytest.raises(ValueError, match="anchored"):
        suffixdedup.repeated_spans(df, length=20)


def test_query_against_a_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {}
    for (key, text), (n, gone) in zip(docs, plain(docs, 50), strict=True):
        b = (text or "").encode()
        left = bytes(x for i, x in enumerate(b) if i not in gone)
        want[key] = (n, len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.op13_column_bwt(spark, SF).collect()}
    assert got == want and len(got) == len(docs)


def test_query_against_sql(spark):
    assert_same(catalog.op13_column_bwt(spark, SF), connect(SF), catalog.ORACLES["op13_column_bwt"])


def test_ranges_leave_a_collection_as_a_row_a_block_and_a_block_as_a_row_a_text():
    rng = np.random.default_rng(5)
    block, doc, start = rng.integers(0, 3, 400) * 7, rng.integers(0, 5, 400), rng.integers(0, 900, 400)
    end = start + rng.integers(1, 60, 400)
    covered = {}
    for b, d, x, y in zip(block.tolist(), doc.tolist(), start.tolist(), end.tolist(), strict=True):
        covered.setdefault((b, d), set()).update(range(x, y))
    rows = [suffixdedup._by_block(block[i::3], doc[i::3], start[i::3], end[i::3]) for i in range(3)]
    assert [t.num_rows for t in rows] == [3, 3, 3]
    met = {}
    for b in (0, 7, 14):
        one = pa.concat_tables([t.filter(pa.compute.equal(t["block"], b)) for t in rows])
        for r in suffixdedup._of_block(one).to_pylist():
            spans = [(s["start"], s["end"]) for s in r["spans"]]
            assert all(y < x for (_, y), (x, _) in zip(spans, spans[1:], strict=False))
            met[r["block"], r["doc"]] = {i for x, y in spans for i in range(x, y)}
    assert met == covered
    none = np.zeros(0, np.int64)
    assert suffixdedup._by_block(none, none, none, none).num_rows == 0


def test_blocks_of_a_large_table_are_larger(spark, monkeypatch):
    """A block sends a row to nearly every collection: with blocks of one size, rows grow with the square of the table."""
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 200)
    monkeypatch.setattr(suffixdedup, "MOST_BLOCKS", 10)
    met, ask = [], suffixdedup._ask
    monkeypatch.setattr(suffixdedup, "_ask", lambda blocks, *a: met.append(blocks.count()) or ask(blocks, *a))
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghij ", k=60000))
    df = spark.createDataFrame([(i, text[i * 100 : i * 100 + 160]) for i in range(599)], "doc_id long, text string").coalesce(1)
    gone = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixdedup.repeated_spans(df).collect()}
    assert met[0] <= 11
    assert gone == {i: [(0, 60)] if i else [] for i in range(599)}


def test_a_common_stretch_is_not_heavy():
    """Heavy is what has many different stretches, not what stands in many places."""
    start, end = np.array([0, 4, 8, 12, 16]), np.array([4, 8, 12, 16, 20])
    assert suffixdedup._different(b"abcdabcdabcdxyzwxyzw", start, end, np.array([0, 3, 4])).tolist() == [1, 1, 1]
    assert suffixdedup._different(b"abcdabcdabcdxyzwxyzw", start, end, np.array([0, 1])).tolist() == [1, 2]


@pytest.mark.parametrize("seed", range(4))
def test_only_stretches_that_share_a_side_meet(seed):
    """Every string that two different stretches have is found, and stretches of one anchor and other surroundings stay out."""
    rng, length = random.Random(seed), (24, 31, 50, 51)[seed]
    side = lambda n: bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=n))
    anchors, sides = [side(suffixdedup.ANCHOR) for _ in range(5)] + [b"a" * suffixdedup.ANCHOR], [side(length) for _ in range(3)]
    text = b"".join(rng.choice(sides) + rng.choice(anchors) + rng.choice([side(length), rng.choice(sides)]) for _ in range(150)) + b"a" * 120
    body = np.frombuffer(text, np.uint8)
    start, count, _ = suffixdedup.stretches(body, np.array([len(body)]), length)
    pieces = list(dict.fromkeys(text[a : a + n + length - 1] for a, n in zip(start.tolist(), count.tolist(), strict=True)))
    near = suffixdedup._near_others(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), length)
    strings = [{p[i : i + length] for i in range(len(p) - length + 1)} for p in pieces]
    holders = {}
    for k, own in enumerate(strings):
        for s in own:
            holders.setdefault(s, []).append(k)
    meet = {k for ks in holders.values() if len(ks) > 1 for k in ks}
    assert meet <= set(np.flatnonzero(near).tolist())
    alone = [side(length) + b"0123456789abcdef" + side(length) for _ in range(20)] if seed == 2 else []
    assert not alone or not suffixdedup._near_others(np.frombuffer(b"".join(p[33:-33] for p in alone), np.uint8), np.full(20, 50), length).any()
