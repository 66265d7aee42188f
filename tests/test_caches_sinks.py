"""Feature caches, the caption sink and resized images: killed and repeated writes, headers, brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import resize
from plumbline.sources import caption_sink
from plumbline.sources.feature_cache import FeatureCache
from plumbline.sources.images import read_images


def test_killed_and_repeated_writes_leave_one_row_a_key(spark, tmp_path):
    cache = FeatureCache(spark, str(tmp_path / "c"), "k")
    keys = lambda *r: spark.range(*r).select(F.col("id").alias("k"))
    asked = []

    def compute(df, fail=False):
        asked.append(sorted(r.k for r in df.collect()))
        if fail:
            return df.select("k", F.raise_error(F.lit("lost")).alias("x"))
        return df.select("k", (F.col("k") * 2).alias("x"))

    assert cache.table() is None and cache.missing(keys(3)).count() == 3
    assert sorted((r.k, r.x) for r in cache.read_through("a", keys(10), compute).collect()) == [(i, 2 * i) for i in range(10)]
    with pytest.raises(Exception, match="lost"):
        cache.read_through("b", keys(5, 15), lambda df: compute(df, True))
    assert cache.batches() == ["a"] and cache.missing(keys(5, 15)).count() == 5  # nothing of the failed write is read
    for _ in range(2):  # the same batch again
        cache.append("b", compute(keys(5, 15)))
    assert cache.batches() == ["a", "b"]
    assert sorted(r.k for r in cache.read_through("c", keys(15), compute).collect()) == list(range(15))
    assert cache.batches() == ["a", "b"]  # a hit computes nothing
    cache.read_through("d", keys(14, 17), compute)
    assert asked[-1] == [14, 15, 16]  # a batch is a hit as a whole only
    cache.read_through("e", keys(16, 19), compute, whole=False)
    assert asked[-1] == [17, 18]


def test_the_header_counts_the_rows_and_a_failed_run_leaves_none(spark, tmp_path):
    caption_sink.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(100, numPartitions=5).select(F.col("id").alias("question_id"), F.when(F.col("id") % 3 == 0, "color").otherwise("yes").alias("rule"), F.lit('say "é"').alias("caption"))
    write = lambda d: d.write.format("caption_json").mode("overwrite").option("path", path).option("description", "d").save()
    write(df)
    head = json.loads((tmp_path / "out" / "info.json").read_text())
    assert head["num_samples"] == 100 and head["rule_counts"] == {"color": 34, "yes": 66} and head["description"] == "d"
    back = spark.read.json(f"{path}/annotations-*.json")
    assert back.count() == 100 and back.where("caption = 'say \"é\"'").count() == 100 and len(head["files"]) == 5
    write(df.limit(7))
    assert json.loads((tmp_path / "out" / "info.json").read_text())["num_samples"] == 7 == spark.read.json(f"{path}/annotations-*.json").count()
    other = str(tmp_path / "none")
    bad = df.withColumn("caption", F.when(F.col("question_id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("caption_json").mode("overwrite").option("path", other).save()
    assert not (tmp_path / "none" / "info.json").exists()
    df.limit(3).write.format("caption_json").mode("overwrite").option("path", other).save()
    head = json.loads((tmp_path / "none" / "info.json").read_text())
    assert {f.name for f in (tmp_path / "none").glob("*.json")} == {"info.json", *head["files"]} and head["num_samples"] == 3


@pytest.mark.parametrize("corners", [False, True])
@pytest.mark.parametrize("size", [(5, 11), (8, 8), (1, 1), (16, 3)])
def test_resize_against_plain_loops(spark, size, corners):
    rng, (c, h, w), (hh, ww) = np.random.default_rng(3), (3, 8, 6), size
    images = [rng.normal(size=(c, h, w)) for _ in range(4)]
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(images)] + [(9, None)], "k int, x array<double>").repartition(2)
    got = {r.k: r.x for r in resize.resize_images(df, "k", "x", (c, h, w), hh, ww, corners).collect()}
    assert got.pop(9) is None

    def at(i, n, m):
        p = i * (n - 1) / (m - 1) if corners and m > 1 else 0.0 if corners else min(max((i + 0.5) * n / m - 0.5, 0), n - 1)
        a = int(p)
        return a, min(a + 1, n - 1), p - a

    for k, x in enumerate(images):
        want = np.empty((c, hh, ww))
        for i in range(hh):
            for j in range(ww):
                (a, b, f), (d, e, g) = at(i, h, hh), at(j, w, ww)
                want[:, i, j] = (x[:, a, d] * (1 - f) + x[:, b, d] * f) * (1 - g) + (x[:, a, e] * (1 - f) + x[:, b, e] * f) * g
        assert np.allclose(got[k], want.ravel())
    with pytest.raises(Exception, match="not 10"):
        resize.resize_images(df, "k", "x", (1, 2, 5), hh, ww).collect()


def test_image_files_by_id(spark, tmp_path):
    for i in (7, 123):
        (tmp_path / f"COCO_val2014_{i:012d}.jpg").write_bytes(bytes([i]) * i)
    (tmp_path / "notes.txt").write_text("no image")
    assert sorted((r.image_id, len(r.content)) for r in read_images(spark, str(tmp_path)).collect()) == [(7, 7), (123, 123)]
