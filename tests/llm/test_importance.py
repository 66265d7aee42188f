"""Operator 12: tournament trees, ranks over many ranges, odd rows, the query against SQL."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, importance
from plumbline.llm.common import cut
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_tournament_merges_sorted_runs(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randrange(20))) for i in range(k)]
    assert list(importance.Tournament(iter(r) for r in runs)) == sorted(x for r in runs for x in r)


def test_longer_runs_of_words_hash_as_joined_text():
    n, got = importance.buckets_of("Äb, cd CD\tef".encode(), 3, 997)
    words = ["Äb", "cd", "cd", "ef"]
    want = [" ".join(words[i : i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1)]
    assert n == 4 and got.tolist() == [zlib.crc32(w.encode()) % 997 for w in want]
    assert importance.buckets_of(None)[0] == 0 and len(importance.buckets_of(b" ,;")[1]) == 0


def test_ranks_over_many_ranges_with_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 64)
    monkeypatch.setattr(importance, "RUN_ROWS", 50)
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice([None, 1, 2, rng.randrange(1000)]), i) for i in range(2000)] + [(7, 7, 2000 + i) for i in range(900)]  # a third of all rows alike
    df = cut(spark.createDataFrame(rows, "score long, key long, row long").repartition(5, "row"))
    order = [r[2] for r in sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))]
    for draws in (0, 1, 700, 1500, len(rows)):
        got = {r.row: r["rank"] for r in importance.ranked(df, draws, len(rows)).collect()}
        assert got == {row: i + 1 for i, row in enumerate(order[:draws])}


def test_odd_rows_and_clashing_names(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.Random(i).choices(words, k=30)), 5, 5) for i in range(50)] + [(None, None, 5, 5), (None, " ".join(words), 5, 5), (1, "", 5, 5), (2, "w1 " * 20000, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RANK int, row int")
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = importance.resampled(df, target).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "row", "n_words", "n_features", "weight", "score", "rank"}
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert drawn == list(range(1, 10 * 52 // 100 + 1))
    assert all(r["rank"] is None and r.weight == 0 for r in got if not r.text)
    best = sorted((r for r in got if r.n_words >= 20), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))[: len(drawn)]
    assert [r["rank"] for r in best] == drawn
    assert importance.resampled(df.limit(0), target).count() == 0
    assert importance.resampled(df, target.limit(0)).where(F.col("rank").isNotNull()).count() == len(drawn)


def test_gains_prefer_the_target():
    g = importance.gains(np.array([10, 0, 5]), np.array([0, 10, 5]))
    assert g[1] > g[2] > g[0]


def test_query_against_sql(spark):
    assert_same(catalog.op12_target_draw(spark, SF), connect(SF), catalog.ORACLES["op12_target_draw"])
