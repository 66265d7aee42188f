"""The parallel reader of JSON arrays against a plain parse: hostile strings, tiny byte ranges, odd files."""

import json
import random

import pytest

from plumbline.sources import json_split

NASTY = ['{"a":', "}", '"', "\\", '\\"', "]}", '"questions":[', '\\\\"}', "{[", "é漢", "x" * 30, "\n", "\\}", "", ",", '"questions" : [{"id":1}]']


def hostile(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(NASTY, k=rng.randint(0, 6)))
    return [{"id": i, "text": word(), "deep": [{"t": word()} for _ in range(rng.randint(0, 3))], "more": {"questions": [{"t": word()}], "z": {}}} for i in range(n)]


def written(tmp_path, name, doc, **how):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(doc, **how), encoding="utf-8")
    return str(path)


ELEMENT = "id bigint, text string, deep array<struct<t:string>>"


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"indent": 1}), (3, {"ensure_ascii": False, "separators": (",", ":")})])
def test_same_records_and_places_as_a_plain_parse(spark, tmp_path, small_ranges, seed, how):
    rows = hostile(seed, 60)
    doc = {"info": {"questions": "no", "x": [1, {"questions": [{"id": -1}]}]}, "first": [{"id": 7, "text": "}"}], "questions": rows, "behind": [{"id": 8}], "last": {"a": []}}
    path = written(tmp_path, f"f{seed}", doc, **how)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
    got = sorted(json_split.read_records(spark, path, "questions", ELEMENT).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.id, r.text, [d.t for d in r.deep]) for r in got] == [(i, x["id"], x["text"], [d["t"] for d in x["deep"]]) for i, x in enumerate(rows)]
    behind = json_split.read_records(spark, path, "behind", ELEMENT).collect()
    assert [(r.pos, r.id) for r in behind] == [(0, 8)]


def test_odd_files(spark, tmp_path, small_ranges):
    cases = {
        "empty": ({"questions": []}, []), "none": ({"other": [{"id": 1}]}, []), "one": ({"questions": [{"id": 5}]}, [5]), "blank": ({"questions": [], "behind": [{"id": 3}]}, []),
        "flat": ({"a": 1, "questions": [{"id": i} for i in range(200)], "b": "]"}, list(range(200))), "bare": ({"questions": [{}, {"id": 2}]}, [None, 2]),
    }
    for name, (doc, want) in cases.items():
        got = json_split.read_records(spark, written(tmp_path, name, doc), "questions", "id bigint").orderBy("pos").collect()
        assert [r.id for r in got] == want, name
        assert [r.pos for r in got] == list(range(len(want))), name
    per_file = json_split.read_records(spark, str(tmp_path), "questions", "id bigint").groupBy("file").count().collect()
    assert sorted(r["count"] for r in per_file) == [1, 2, 200]
