"""Operator 3: the jump hash against its scalar form, moves on growth, slots."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import catalog, shards
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


def scalar(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * shards.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_same_as_the_scalar_form_and_only_new_shards_grow():
    keys = np.array([0, 1, -1, 2**62, -(2**63), *range(2000)], np.int64)
    for n in (1, 2, 8, 9, 100):
        assert shards.jump(keys, n).tolist() == [scalar(int(k), n) for k in keys]
    a, b = shards.jump(keys, 8), shards.jump(keys, 9)
    assert ((a == b) | (b == 8)).all() and 0.08 < (a != b).mean() < 0.15


def test_slots_nulls_repeats_and_clashes(spark):
    rows = [(1, "a", 7), (None, "b", 7), (1, "a", 7), (5, None, 7)] + [(i, "x" * i, 7) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SHARD int")
    narrow = df.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    got = shards.place(narrow, "doc_id", 8, ["crc"]).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.shard for r in got if r.doc_id is None} == {scalar(0, 8)}
    assert shards.place(narrow.limit(0), "doc_id", 8).count() == 0
    m = {r.doc_id: r for r in shards.manifest(df, "text", "doc_id").collect()}
    assert m[5].size in (1, 6) and m[49].size == 50


def test_query_against_sql(spark):
    assert_same(catalog.op3_jump_shards(spark, SF), connect(SF), catalog.ORACLES["op3_jump_shards"])
