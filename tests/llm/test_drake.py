"""Operator 11: bounds against the plain algorithm, the query against SQL, odd rows."""

import hashlib

import numpy as np
import pytest

from plumbline.llm import catalog, drake
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, seed):
    """[(key, cluster, distance)] and centroids by comparing everything."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = [list(rows[i][1]) for i in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in rows]
        for j in range(len(c)):
            mine = [rows[i][1] for i in range(len(rows)) if own[i] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(key, near(x)[1], near(x)[0]) for key, x in rows], c


@pytest.mark.parametrize("k,dims,scale,seed", [(1, 2, 5, 1), (8, 3, 4, 3), (8, 8, 900, 4), (20, 5, 3, 5), (30, 16, 100_000_000, 6)])
def test_same_as_the_plain_algorithm(k, dims, scale, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.integers(-scale, scale, (400, dims)))]  # small scales give many ties
    want, _ = plain(rows, k, 6, 9)
    x = np.array([r[1] for r in rows], np.int32)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"9:{i}".encode()).hexdigest(), rows[i][1]))
    c, bounds, drift, b, computed = np.array([rows[i][1] for i in order[:k]], np.int64), None, None, min(k - 1, max(1, k // 2)), 0
    for r in range(7):
        bounds, asked, n = drake.reassigned(x, c, bounds, drift, b)
        computed += n
        if r == 6:
            break
        new = c.copy()
        for j in range(k):
            if (bounds.own == j).any():
                new[j] = x[bounds.own == j].sum(axis=0, dtype=np.int64) // (bounds.own == j).sum()
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        c = new
        if r:
            b = min(b, max(1, asked))
    assert bounds.own.tolist() == [j for _, j, _ in want]
    assert k == 1 or computed < 7 * 400 * k


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(drake, "BLOCK", 7)
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)] + [(None, [0.5, -0.5, 0.25, 0.0]), (3, [1.0, 1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0, 1.0])]
    bad = [(70, None), (71, [1.0, 2.0]), (72, [1.0, None, 2.0, 3.0]), (73, [float("nan"), 1.0, 1.0, 1.0]), (74, [float("inf"), 1.0, 1.0, 1.0]), (75, [1e9, 1.0, 1.0, 1.0]), (76, [])]
    df = spark.createDataFrame([(a, b, 1) for a, b in good + bad], "vec_id long, embedding array<double>, CLUSTER int")
    got, centroids = drake.cluster(df, dims=4, k=5, rounds=4)
    want, c = plain([(a, [int(np.floor(1024 * v)) for v in b]) for a, b in good], 5, 4, 3)
    assert sorted(map(str, ((r.key, r.cluster, r.distance) for r in got.collect()))) == sorted(map(str, want))
    assert centroids.tolist() == c
    empty, none = drake.cluster(df.limit(0), dims=4)
    assert empty.count() == 0 and len(none) == 0
    few, c = drake.cluster(df.limit(2), dims=4)
    assert len(c) == 2 and few.count() == 2 and few.agg({"distance": "sum"}).first()[0] == 0


def test_query_against_sql(spark):
    assert_same(catalog.op11_drake_bounds(spark, SF), connect(SF), catalog.ORACLES["op11_drake_bounds"])
