"""Loops, relations, epochs and scans on small tables: early stop, bijections, hot groups, draws."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import coded, decode, relation, relational, sampler, schedule


def test_relation_update_against_pairs(spark):
    rng = np.random.default_rng(1)
    layer = lambda wide: relation.Layer(rng.normal(size=(3, wide)), rng.normal(size=3))
    edge, node = (layer(6), layer(3)), (layer(6), layer(3))
    rows = [(g, i, rng.normal(size=3).tolist()) for g in range(4) for i in range(g * 3 + 1)] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "g int, o int, x array<double>")
    two = lambda f, x: f[1].weight @ np.maximum(f[0].weight @ x + f[0].bias, 0) + f[1].bias
    for residual in (True, False):
        got = {(r.g, r.slot): r.x for r in relation.relation_update(df, "g", "o", "x", 5, edge, node, residual).collect()}
        want = {}
        for g in range(4):
            xs = [np.array(x) for h, _, x in rows if h == g][:5]
            for i, xi in enumerate(xs):
                m = np.mean([two(edge, np.concatenate([xi, xj])) for xj in xs], axis=0)
                want[g, i] = two(node, np.concatenate([xi, m])) + (xi if residual else 0)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)


def _step(spark, table):
    return spark.createDataFrame([(a, b, s) for a, nexts in table.items() for b, s in nexts], "token string, next string, score long")


def _beam(table, first, width, most, alpha, n):
    beams = [(0, [first], False)]
    for _ in range(most - 1):
        made = []
        for k, (s, seq, done) in enumerate(beams):
            tail = seq[len(seq) - n + 1 :] if n else None
            blocked = {seq[i + n - 1] for i in range(len(seq) - n + 1) if seq[i : i + n - 1] == tail} if n else set()
            free = [] if done else [(b, x) for b, x in table.get(seq[-1], []) if b not in blocked]
            made += [(-(s + x), k, b, seq + [b], b == decode.END) for b, x in free] or [(-s, k, "", seq, True)]
        beams = [(-s, seq, done) for s, _, _, seq, done in sorted(made)[:width]]
    return max(enumerate(beams), key=lambda kb: (kb[1][0] / len(kb[1][1]) ** alpha, -kb[0]))[1]


@pytest.mark.parametrize("width,n,cut", [(1, 0, 1), (1, 3, 4), (3, 3, 2), (4, 2, 100)])
def test_decoding_against_a_plain_loop(spark, width, n, cut):
    rng = random.Random(width * 10 + n)
    words = [f"w{i}" for i in range(9)]
    table = {w: [(x, -rng.randint(0, 6)) for x in rng.sample([*words, decode.END], rng.randint(0, 6))] for w in words}
    start = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "unseen"])], "item int, token string")
    got = {r.item: (r.score, r.tokens) for r in decode.decode(start, _step(spark, table), "item", width, 9, no_repeat=n, cut_every=cut).collect()}
    assert got == {i: _beam(table, w, width, 9, 0.7, n)[:2] for i, w in enumerate([*words, "unseen"])}


def test_the_loop_stops_once_all_items_have_ended(spark, monkeypatch):
    cuts = []
    real = decode.stored
    monkeypatch.setattr(decode, "stored", lambda df: cuts.append(1) or real(df))
    step = _step(spark, {"a": [("b", -1)], "b": [(decode.END, -1)]})
    start = spark.createDataFrame([(1, "a"), (2, "b")], "item int, token string")
    got = {r.item: (r.tokens, r.rounds) for r in decode.decode(start, step, "item", 2, 500, cut_every=1).collect()}
    assert got == {1: (["a", "b", decode.END], 3), 2: (["b", decode.END], 2)}
    assert len(cuts) == 3  # the successors, and two rounds of 499
    assert decode.decode(start.limit(0), step, "item", 2, 5).count() == 0


def test_scheduled_inputs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, rng.choices(words, k=rng.randint(1, 40))) for i in range(60)] + [(100, []), (101, None)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    nxt = {w: rng.choice(words) for w in words[:-1]}
    step = _step(spark, {w: [(x, 0), ("zz", -1)] for w, x in nxt.items()})
    feed = lambda share, parts=3: {r.k: r.inputs for r in decode.scheduled_inputs(df.repartition(parts), "k", "t", step, share, 8).collect()}
    assert feed(0.0) == dict(rows)
    some = feed(0.3)
    assert some == feed(0.3, 7) and some != dict(rows)
    for k, t in rows:
        if not t:
            assert some[k] == t
            continue
        assert some[k][0] == t[0]
        assert all(b in (y, nxt.get(a, a)) for a, b, y in zip(some[k][:-1], some[k][1:], t[1:], strict=True))
    every = feed(1.0)
    for k, t in rows[:-2]:
        want = [t[0]]
        while len(want) < len(t):
            want.append(nxt.get(want[-1], want[-1]))
        assert every[k] == want
    free = [(a, b, y) for k, t in rows[:-2] for a, b, y in zip(some[k][:-1], some[k][1:], t[1:], strict=True) if nxt.get(a, a) != y]
    assert 0.2 < sum(b != y for _, b, y in free) / len(free) < 0.4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_is_a_bijection(spark, n):
    both = spark.range(n).select("id", sampler.permuted(F.col("id"), n, "a").alias("a"), sampler.permuted(F.col("id"), n, "b").alias("b")).collect()
    assert sorted(r.a for r in both) == sorted(r.b for r in both) == list(range(n))
    if n >= 64:
        assert sum(r.a == r.id for r in both) < n / 5 and [r.a for r in both] != [r.b for r in both]


@pytest.mark.parametrize("n,world,shuffle", [(10, 4, True), (3, 8, True), (12, 4, False), (0, 4, True), (1, 3, False)])
def test_ranks_are_equal_and_hold_every_row(spark, n, world, shuffle):
    df = spark.range(n).select((F.col("id") * 5).alias("k"))
    got = sampler.dealt(df, "k", world, 7, [0, 3], shuffle).collect()
    for e in (0, 3):
        own = sorted((r.slot * world + r["rank"], r.k) for r in got if r.epoch == e)
        total = -(-n // world) * world
        assert [p for p, _ in own] == list(range(total))
        assert sorted(k for _, k in own[:n]) == [5 * i for i in range(n)]
        assert all(k == own[p - n][1] for p, k in own[n:])  # wrapped around
        assert shuffle or [k for _, k in own[:n]] == [5 * i for i in range(n)]
    plan = sampler.dealt(df, "k", world, 7, [0])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_running_values_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.randint(1, 900), rng.random()) for i in range(800)] + [(rng.choice([None, "a", "b"]), i, rng.randint(1, 900), rng.random()) for i in range(800, 1200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, n int, x double").repartition(5)
    got = {r.o: r for r in schedule.crossings(df, "g", "o", "n", 500).join(schedule.best_so_far(df, "g", "o", "x").select("o", "best", "improved"), "o").collect()}
    seen, best = {}, {}
    for g, o, n, x in sorted(rows, key=lambda r: r[1]):
        before = seen.get(g, 0)
        seen[g] = before + n
        assert (got[o].seen, got[o].saves) == (seen[g], seen[g] // 500 - before // 500)
        assert got[o].improved == (x > best.get(g, -1)) and got[o].best == max(best.get(g, -1), x)
        best[g] = got[o].best
    parts = relational.with_part(df, "o").groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 500  # no task holds the hot group
    with pytest.raises(ValueError, match="number"):
        relational.numbered(df, [], "g", "p")


@pytest.mark.parametrize("ranges", [1 << 20, 40])
def test_successors_against_a_plain_count(spark, monkeypatch, ranges):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.choices(words, weights=[900] + [1] * 59, k=rng.randint(0, 30)),) for _ in range(80)] + [([],), (None,), (["w0", decode.END],)]
    monkeypatch.setattr(coded, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(coded, "RANGE_PAIRS", ranges)
    df = spark.createDataFrame(rows, "t array<string>").repartition(3)
    counts = {}
    for (t,) in rows:
        for a, b in zip(t or [], [*(t or [])[1:], decode.END], strict=False):
            counts.setdefault(a, Counter())[b] += 1
    score = lambda a, b: round(decode.UNIT * math.log(counts[a][b] / counts[a].total()))
    for most in (1, 4, 100):
        got = {r.token: [(s["next"], s.score) for s in r.successors] for r in decode.successors(df, F.col("t"), most).collect()}
        assert got == {a: sorted(((b, score(a, b)) for b in nexts), key=lambda s: (-s[1], s[0]))[:most] for a, nexts in counts.items()}


def test_no_row_is_a_token_or_a_pair(spark, monkeypatch):
    """Tokens and their pairs stay in blocks: what is stored or shuffled has far fewer rows than tokens."""
    sizes = []
    real = coded.stored
    monkeypatch.setattr(coded, "stored", lambda df: sizes.append((out := real(df)).count()) or out)
    monkeypatch.setattr(decode, "stored", coded.stored)
    rows = [(i, [f"w{(i * j) % 7}" for j in range(500)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = decode.scheduled_inputs(df, "k", "t", None, 0.3, 8)
    assert got.count() == 40 and max(sizes) < 200
    plan = decode.successors(df, F.col("t"), 3)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_scheduled_inputs_of_blocks(spark, monkeypatch):
    """Small and large blocks, rows in any order, and runs over whole lists give the same; draws are those of the SQL."""
    rng = random.Random(9)
    rows = [(i, rng.choices(["a", "b", "c", "d"], k=rng.randint(0, 25))) for i in range(50)] + [(None, ["a", "c", "a"]), (77, None)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    best = {"a": "b", "b": "c", "d": "a"}
    step = _step(spark, {a: [(b, 0)] for a, b in best.items()})
    def want(key, toks, share):
        fed = []
        for at, own in enumerate(toks or []):
            number = int(hashlib.md5(f"{'8' if key is None else f'8:{key}'}:{at}".encode()).hexdigest()[:8], 16)
            fed.append(best.get(fed[-1], fed[-1]) if at and number < round(share * (1 << 32)) else own)
        return fed if toks is not None else None

    for share in (0.0, 0.5, 1.0):
        for tokens in (7, 1 << 20):
            monkeypatch.setattr(coded, "BLOCK_TOKENS", tokens)
            got = {r.k: r.inputs for r in decode.scheduled_inputs(df.repartition(4), "k", "t", step, share, 8).collect()}
            assert got == {k: want(k, t, share) for k, t in rows}


def test_texts_are_cut_into_tokens_in_blocks(spark, monkeypatch):
    """Texts go to the blocks as they are: the tokens are those of the column function, at any size of step and block."""
    odd = ["", " ", "a", "a b", "It's  A\tTEST\n42!", "don't--stop", "ÄÖ ß straße", "Kelvin İstanbul", "日本 go 語x", "x퟿\U0001f600y z'", "'", None, "end"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd * 3)], "k int, s string").repartition(2)
    want = {r.k: r.toks for r in df.select("k", text.tokens(F.col("s")).alias("toks")).collect()}
    for step, size in ((1, 4), (30, 9), (1 << 20, 1 << 20)):
        monkeypatch.setattr(coded, "STEP_BYTES", step)
        monkeypatch.setattr(coded, "BLOCK_TOKENS", size)
        assert {r.k: r.inputs for r in decode.scheduled_inputs(df, "k", "s", _step(spark, {"a": [("b", 0)]}), 0.0, 1).collect()} == want
    lists = df.select(text.tokens(F.col("s")).alias("s"))
    both = [sorted(map(tuple, decode.successors(d, F.col("s"), 3).collect())) for d in (df, lists)]
    assert both[0] == both[1] and len(both[0]) > 5
    first = {r.k: r.f for r in df.select("k", text.first_token(F.col("s")).alias("f")).collect()}
    assert first == {k: t[0] if t else None for k, t in want.items()}
