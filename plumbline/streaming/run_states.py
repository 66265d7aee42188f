"""Running totals, bests and thresholds of many runs along a stream, held as state per run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.schedule import positive

#: The store that keeps the state; transformWithState asks for it.
_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Runs are dealt to so many parts; a part that gets rows costs a micro-batch about 20 ms, and its state, one row, is written again.
PARTS = 1024

_STATE = (("batch", T.LongType()), ("seen", T.LongType()), ("best", T.DoubleType()))
_MADE = (
    ("batch", T.LongType()), ("seen", T.LongType()), ("saves", T.LongType()), ("next_at", T.LongType()), ("best", T.DoubleType()), ("improved", T.BooleanType()),
)


def advanced(known: pd.DataFrame, arrived: pd.DataFrame, every: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows made, runs touched as they are now) from the states known (run, batch, seen, best) and the rows that arrived."""
    names = pd.concat([known["run"], arrived["run"]], ignore_index=True).factorize()[0]
    known, arrived = known.assign(code=names[: len(known)]), arrived.assign(code=names[len(known) :])
    place = np.full(len(names), -1)
    place[known["code"]] = np.arange(len(known))
    at = place[arrived["code"]]
    late = at >= 0
    late[late] = arrived["batch"].to_numpy()[late] <= known["batch"].to_numpy()[at[late]]
    arrived = arrived[~late].drop_duplicates(["code", "batch"])  # late, or delivered again
    before = known[known["code"].isin(arrived["code"])].rename(columns={"seen": "samples", "best": "score"})
    rows = pd.concat([before.assign(new=False), arrived.assign(new=True)] if len(before) else [arrived.assign(new=True)], ignore_index=True)
    rows = rows.sort_values(["code", "batch"], kind="stable", ignore_index=True)
    of = rows.groupby("code", sort=False)
    seen, score = of["samples"].cumsum().to_numpy(), rows["score"].to_numpy()
    if np.abs(rows["samples"].astype("float64")).sum() >= 2**63 and rows["samples"].astype("float64").groupby(rows["code"]).cumsum().abs().max() >= 2**63:
        raise OverflowError("the samples of a run do not fit 64 bits")
    highest = of["score"].cummax()
    above = highest.groupby(rows["code"], sort=False).shift().to_numpy()  # NaN before a run's first row
    improved = np.isnan(above) | (score > above)
    best = score[np.maximum.accumulate(np.where(improved, np.arange(len(rows)), 0))]
    made = pd.DataFrame({"run": rows["run"], "batch": rows["batch"], "seen": seen, "best": best})
    ends = ~rows["code"].duplicated(keep="last").to_numpy()
    crossed = seen // every
    out = made.assign(saves=crossed - (seen - rows["samples"].to_numpy()) // every, next_at=(crossed + 1) * every, improved=improved)
    return out.loc[rows["new"].to_numpy(), ["run", *(n for n, _ in _MADE)]], made[ends]


class RunProcessor(StatefulProcessor):
    """The state of a part's runs: of each the last batch, the samples seen and the best score so far."""

    def __init__(self, every: int, kind: T.DataType):
        self.every, self.kind = every, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        lists = [T.StructField("run", T.ArrayType(self.kind)), *(T.StructField(n, T.ArrayType(k)) for n, k in _STATE)]
        self.state = handle.getValueState("runs", T.StructType(lists))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["run", *(n for n, _ in _STATE)]
        arrived = pd.concat(list(rows), ignore_index=True)[["run", "batch", "samples", "score"]]
        held = self.state.get()
        known = pd.DataFrame(dict(zip(names, held if held is not None else [[]] * len(names), strict=True)))
        known = known.astype({"run": arrived["run"].dtype, "batch": "int64", "seen": "int64", "best": "float64"})
        made, now = advanced(known, arrived, self.every)
        if len(now):
            if len(known):
                now = pd.concat([known[~known["run"].isin(now["run"])], now[names]], ignore_index=True)
            self.state.update(tuple(now[n].tolist() for n in names))
        yield made

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> str | None:
    """Sets the state store of queries that start from now on, and returns what was set before."""
    before = spark.conf.get(_KEY, None)
    spark.conf.set(_KEY, STORE)
    return before


def restore_store(spark: SparkSession, before: str | None) -> None:
    spark.conf.unset(_KEY) if before is None else spark.conf.set(_KEY, before)


def run_states(stream: DataFrame, run: str, batch: str, samples: str, score: str, every: int) -> DataFrame:
    """(run, batch, seen, saves, next_at, best, improved) for each new batch of each run, as it arrives.

    seen sums the samples; saves is how many multiples of ``every`` the batch crosses, next_at the next one; best is the
    running maximum and improved whether the batch is strictly above all before. A run's batches are taken in the
    order of their ids within a micro-batch; an id at or below the last one taken is late or repeated and gives no
    row. Runs are dealt to PARTS parts by hash; a part's runs are taken together, in arrays, and its state is one
    row with a place for each run, so it grows with the runs, not with their batches. Null ids, samples or
    scores are left out. The session needs ``use_store``.
    """
    rows = stream.select(F.col(run).alias("run"), F.col(batch).cast("long").alias("batch"), F.col(samples).cast("long").alias("samples"), F.col(score).cast("double").alias("score"))
    schema = T.StructType([rows.schema["run"], *(T.StructField(n, k) for n, k in _MADE)])
    dealt = rows.dropna().withColumn("part", F.pmod(F.xxhash64("run"), F.lit(PARTS)).cast("int"))
    processor = RunProcessor(positive(every), rows.schema["run"].dataType)
    return dealt.groupBy("part").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def write_available(found: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what its source has now; the next call with the same ``checkpoint`` goes on from there."""
    query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
