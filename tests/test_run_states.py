"""Run states along a stream: random micro-batches, a restart, late and repeated rows, against the batch operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import schedule
from plumbline.streaming import run_states

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    before = run_states.use_store(spark)
    yield
    run_states.restore_store(spark, before)


def test_stream_and_batch_agree_over_a_restart(spark, store, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(
        (F.col("o_custkey") % 40).alias("run"), F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") % 700 + 1).alias("samples"), F.col("o_totalprice").alias("score")
    )
    rows = sorted(map(tuple, orders.collect()), key=lambda r: r[1])
    rng, at, nth, source = random.Random(1), 0, 0, str(tmp_path / "in")

    def deliver(upto):
        nonlocal at, nth
        while at < upto:
            n = rng.randint(1, 500)
            part = rows[at : min(upto, at + n)] + rng.sample(rows[:at], min(at, 60))  # some come again, and late
            rng.shuffle(part)
            spark.createDataFrame(part, orders.schema).coalesce(1).write.mode("append").parquet(source)
            at, nth = min(upto, at + n), nth + 1

    def run():
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_states.write_available(run_states.run_states(stream, "run", "batch", "samples", "score", 500), str(tmp_path / "out"), str(tmp_path / "check"))

    deliver(800)
    run()
    deliver(len(rows))
    run()
    got = {(r.run, r.batch): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = schedule.crossings(orders, "run", "batch", "samples", 500).join(schedule.best_so_far(orders, "run", "batch", "score").select("batch", "best", "improved"), "batch").collect()
    assert nth > 4 and len(got) == len(want) == len(rows)
    for r in want:
        g = got[r.run, r.batch]
        assert (g.seen, g.saves, g.best, g.improved, g.next_at) == (r.seen, r.saves, r.best, r.improved, (r.seen // 500 + 1) * 500)


def test_odd_settings(spark):
    with pytest.raises(ValueError, match="above 0"):
        run_states.run_states(spark.range(1), "id", "id", "id", "id", 0)


def _plain(rows, states, every):
    out = []
    for run, batch, samples, score in sorted(rows, key=lambda r: r[1]):
        last, seen, best = states.get(run, (None, 0, None))
        if last is not None and batch <= last:
            continue
        better = best is None or score > best
        states[run] = batch, seen + samples, score if better else best
        after = seen + samples
        out.append((run, batch, after, after // every - seen // every, (after // every + 1) * every, states[run][2], better))
    return out


@pytest.mark.parametrize("name", [int, str])
def test_runs_of_a_part_advance_together(name):
    """Random deliveries, late and repeated ids, ties, signed zeros and ids beyond 2**53, against a loop over rows."""
    rng, states = random.Random(5), {}
    known = pd.DataFrame({"run": [], "batch": [], "seen": [], "best": []}).astype({"batch": "int64", "seen": "int64", "best": "float64"})
    for step in range(30):
        rows = [(name(rng.randint(0, 6)), 2**60 + rng.randint(step * 3, step * 3 + 12), rng.randint(-50, 700), rng.choice([-0.0, 0.0, 1.5, -2.0, float("inf"), rng.random()])) for _ in range(rng.choice([1, 3, 25]))]
        arrived = pd.DataFrame(rows, columns=["run", "batch", "samples", "score"])
        made, now = run_states.advanced(known.astype({"run": arrived["run"].dtype}), arrived, 500)
        want = _plain(rows, states, 500)
        assert sorted(map(repr, made.itertuples(index=False, name=None))) == sorted(map(repr, want))
        known = pd.concat([known[~known["run"].isin(now["run"])], now], ignore_index=True) if len(known) else now
        assert {r: (b, s, repr(x)) for r, b, s, x in known.itertuples(index=False, name=None)} == {r: (b, s, repr(x)) for r, (b, s, x) in states.items()}
    with pytest.raises(OverflowError):
        run_states.advanced(known.iloc[:0], pd.DataFrame([("a", 1, 2**62, 0.0), ("a", 2, 2**62, 0.0)], columns=["run", "batch", "samples", "score"]), 500)


def test_groups_are_parts_not_runs(spark, store, tmp_path, monkeypatch):
    """A group, and a row of state, is a part with many runs; with names as runs, over a restart."""
    monkeypatch.setattr(run_states, "PARTS", 3)
    rows = [(f"r{i % 50}", i, i % 9 + 1, float(i * 7 % 31)) for i in range(400)]
    source, states, want = str(tmp_path / "in"), {}, []
    for part in (rows[:250], rows[200:]):
        df = spark.createDataFrame(part, "run string, batch long, samples long, score double")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        run_states.write_available(run_states.run_states(stream, "run", "batch", "samples", "score", 10), str(tmp_path / "out"), str(tmp_path / "check"))
        want += _plain(part, states, 10)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)
    state = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "runs").load()
    assert state.count() == 3
