"""Operators on small tables: ties, caps, lookups, vocabularies, metrics, vectors, schedules, files."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.functions import vectors as v
from plumbline.operators import cache, metrics, relational, schedule, tensor, vocab
from plumbline.sources import config, json_tables, sinks, vqa


def test_mode_takes_the_first_of_equals_whatever_the_partitions(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "A "), (1, 3, "b"), (2, 0, None)], "k int, o int, a string")
    for parts in (1, 5):
        got = {r.k: (r.answer, r.votes) for r in relational.mode(df.repartition(parts), "k", t.plain_answer(F.col("a")), "o").collect()}
        assert got == {1: ("b", 2), 2: (None, 1)}


def test_last_row_wins(spark):
    df = spark.createDataFrame([(1, 0, "bus"), (1, 1, "car"), (2, 0, None)], "k int, pos int, x string")
    assert {r.k: r.x for r in relational.keep_last(df, ["k"], ["pos"]).collect()} == {1: "car", 2: None}


@pytest.mark.parametrize(("most", "want"), [(None, 3), (0, 3), (-1, 3), (2, 2), (9, 3)])
def test_caps(spark, most, want):
    df = spark.createDataFrame([(i,) for i in range(3)], "k int")
    assert relational.capped(df, ["k"], most).count() == want


def test_look_up_prefers_the_first_split(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, x string")
    assert relational.look_up_one([("val", a), ("train", b)], "k", 1).split == "val"
    assert relational.look_up_one([("val", a), ("train", b)], "k", 2).x == "b"
    with pytest.raises(KeyError):
        relational.look_up_one([("val", a), ("train", b)], "k", 3)


@pytest.mark.parametrize("most", [1, 1000])
def test_vocabulary_encodes_and_decodes(spark, monkeypatch, most):
    df = spark.createDataFrame([(1, "b a b"), (2, "a c"), (3, "")], "k int, text string")
    table = vocab.build(df, "text", 2)
    assert {r.word: r.id for r in vocab.itos(table).collect()} == {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3, "a": 4, "b": 5}
    monkeypatch.setattr(vocab, "BROADCAST_WORDS", most)
    words = vocab.Vocabulary(table)
    assert (words.broadcast is None) == (most == 1)
    encoded = vocab.encode(df, "k", "text", words)
    assert {r.k: r.ids for r in encoded.collect()} == {1: [1, 5, 4, 5, 2], 2: [1, 4, 3, 2], 3: [1, 2]}
    assert {r.k: r.ids for r in vocab.encode(df, "k", "text", words, 4).collect()}[1] == [1, 5, 4, 2]
    padded = vocab.padded(encoded.withColumn("b", F.lit(0)), "b")
    assert {r.k: r.ids for r in padded.collect()}[3] == [1, 2, 0, 0, 0]
    assert {r.k: r.text for r in vocab.decode(padded, "k", "ids", words).collect()} == {1: "b a b", 2: "a <unk>", 3: ""}


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_repeated_and_null_keys_keep_their_rows_on_both_paths(spark, monkeypatch, most):
    rows = [(1, "a b"), (1, "a c"), (1, "a b"), (None, "b c"), (None, None), (None, ""), (2, "zz a")]
    df = spark.createDataFrame(rows, "k int, text string")
    table = vocab.build(df, "text", 2)
    ids = {r.word: r.id for r in table.collect()}
    monkeypatch.setattr(vocab, "BROADCAST_WORDS", most)
    words = vocab.Vocabulary(table)
    assert (words.broadcast is None) == (most < 2)
    encoded = vocab.encode(df, "k", "text", words)
    want = [(k, [1, *(ids.get(w, 3) for w in (x or "").split()), 2]) for k, x in rows]
    assert sorted(map(str, ((r.k, r.ids) for r in encoded.collect()))) == sorted(map(str, want))
    mixed = spark.createDataFrame([(k, [*i, 0, 77]) for k, i in want] + [(None, None), (3, [])], "k int, ids array<long>")
    told = sorted(map(str, ((r.k, r.text) for r in vocab.decode(mixed, "k", "ids", words).collect())))
    say = lambda x: " ".join(w if w in ids else "<unk>" for w in (x or "").split())
    text = lambda rows: sorted(map(str, rows))
    in_place = [(k, say(x)) for k, x in rows] + [(3, "")]
    assert told in (text([*in_place, (None, "")]), text([*in_place, (None, None)]))
    assert told.count("(1, 'a b')") == 2


def _bleu(hyps, refs):
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    out, logs = {}, 0.0
    hl, rl = sum(map(len, hyps)), sum(min((len(r) for r in rs), key=lambda x, h=h: (abs(x - len(h)), x)) for h, rs in zip(hyps, refs, strict=True))
    for n in range(1, 5):
        clipped = sum(min(c, max(grams(r, n)[g] for r in rs)) for h, rs in zip(hyps, refs, strict=True) for g, c in grams(h, n).items())
        p = clipped / max(1, sum(max(0, len(h) - n + 1) for h in hyps))
        logs += math.log(p) if p else -1e9
        out[n] = (1.0 if hl > rl else math.exp(1 - rl / hl)) * math.exp(logs / n) if p else 0.0
    return out


def test_bleu_against_the_formula(spark):
    hyps = [["a", "b", "c", "d", "e"], ["x", "y", "x"]]
    refs = [[["a", "b", "c", "d"], ["e", "a", "b"]], [["x", "y", "z", "x", "y"]]]
    h = spark.createDataFrame([(i, x) for i, x in enumerate(hyps)], "grp int, toks array<string>")
    r = spark.createDataFrame([(i, j, x) for i, xs in enumerate(refs) for j, x in enumerate(xs)], "grp int, ref int, toks array<string>")
    got = {x.n: x.bleu for x in metrics.bleu(h, r, "grp", "toks").collect()}
    want = _bleu(hyps, refs)
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)
    same = metrics.bleu(h.where("grp = 0"), h.where("grp = 0").withColumn("ref", F.lit(0)), "grp", "toks")
    assert all(abs(x.bleu - 1) < 1e-9 for x in same.collect())


def test_cider_of_one_group_is_zero(spark):
    h = spark.createDataFrame([(0, ["a", "b"])], "grp int, toks array<string>")
    assert metrics.cider_d(h, h.withColumn("ref", F.lit(0)), "grp", "toks").first().cider == 0.0


def test_accuracies(spark):
    one = spark.range(1)
    answers = F.array(*map(F.lit, ["red", " Red", *["blue"] * 8]))
    assert one.select(metrics.soft_accuracy(F.lit("red"), answers).alias("x")).first().x == pytest.approx(2 / 3)
    assert one.select(metrics.soft_accuracy(F.lit("blue"), answers).alias("x")).first().x == 1.0
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (1, 1), (4, 4), (2, 2), (0, 5)], "t int, p int")
    assert df.agg(metrics.token_accuracy(F.col("t"), F.col("p")).alias("x")).first().x == pytest.approx(5 / 6)
    assert df.where("t = 0").agg(metrics.token_accuracy(F.col("t"), F.col("p")).alias("x")).first().x == 0.0
    words = F.array(*map(F.lit, ["<pad>", "<bos>", "<eos>", "<unk>", "yes"]))
    assert one.select(metrics.predicted_text(F.array(*map(F.lit, [1, 4, 2, 3, 77])), words).alias("x")).first().x == "yes <unk>"


def test_vectors(spark):
    row = spark.range(1).select(
        v.argmax(F.array(*map(F.lit, [1.0, 3.0, 3.0]))).alias("a"), v.log_softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("l"),
        v.fused(F.array(F.lit(2.0)), F.array(F.lit(3.0)), "mul").alias("m"), tensor.blocked_words(F.split(F.lit("a horse x a horse"), " "), 3).alias("b"),
        tensor.blocked_words(F.split(F.lit("a horse a"), " "), 3).alias("none"), metrics.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)).alias("ce"),
    ).first()
    assert row.a == 1 and row.m == [6.0] and row.b == ["x"] and row.none == []
    assert row.l == pytest.approx([-math.log(2)] * 2) and row.ce == pytest.approx(math.log(2))
    with pytest.raises(ValueError, match="unknown"):
        v.fused(F.lit(1), F.lit(1), "xor")


def test_attention_of_equal_rows_is_the_row(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [0.5, 0.5])] * 3, "g int, x array<double>, q array<double>")
    for pool in (tensor.dot_attention, tensor.tanh_attention):
        assert {r.dim: r.value for r in pool(df, "g", "x", "q").collect()} == pytest.approx({0: 1.0, 1: 2.0})


def test_rows_up_to_the_first_end(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([5, 6, 2, 7])] + [(1, 0, 9)], "g int, o int, x int")
    assert sorted((r.g, r.x) for r in tensor.up_to_first(df, "g", "o", F.col("x") == 2).collect()) == [(0, 2), (0, 5), (0, 6), (1, 9)]


def test_beam_search_follows_the_table(spark):
    low = -9.0
    steps = [(1, [low, low, low, -0.1, -0.2]), (3, [low, low, -0.1, low, low]), (4, [low, low, -3.0, low, low])]
    table = spark.createDataFrame(steps, "token int, log_probs array<double>")
    got = tensor.beam_search(spark.createDataFrame([(0,)], "item int"), table, "item", 1, 2, 2, 4).first().ids
    assert got[:3] == [1, 3, 2] and set(got[3:]) <= {0}


def test_schedules(spark):
    e = spark.range(1, 31).withColumnRenamed("id", "e")
    assert [r.e for r in e.where(schedule.should_evaluate(F.col("e"), 5, 30)).collect()] == [5, 10, 15, 20, 25, 30]
    p = {r.e: r.p for r in e.select("e", schedule.sampling_probability(F.col("e"), 0.06, 4, 0.24).alias("p")).collect()}
    assert [p[k] for k in (3, 4, 8, 16, 20)] == pytest.approx([0, 0.06, 0.12, 0.24, 0.24])
    r = {x.e: x.r for x in e.select("e", schedule.step_rate(5e-4, 0.6, 4, F.col("e")).alias("r")).collect()}
    assert [r[k] for k in (4, 8, 12)] == pytest.approx([3e-4, 1.8e-4, 1.08e-4])
    n = spark.createDataFrame([(0,), (50,), (120,)], "s int").select(schedule.next_threshold(F.col("s"), 50).alias("n")).collect()
    assert [x.n for x in n] == [50, 100, 150]
    with pytest.raises(ValueError):
        schedule.positive(0)
    with pytest.raises(ValueError):
        schedule.save_kind("never")


def test_files_in_and_out(spark, tmp_path):
    q = {"questions": [
        {"question_id": 2, "image_id": 9, "question": "How many dogs are there?"}, {"question_id": 1, "image_id": 9, "question": "What color is the car?"},
        {"question_id": 1, "image_id": 9, "question": "What color is the bus?"}, {"question_id": 3, "image_id": 8, "question": "Is it raining?"},
    ]}
    a = {"annotations": [{"question_id": 1, "answers": [{"answer": x} for x in (" Red", "blue", "blue ", "red")]}, {"question_id": 2, "answers": [{"answer": "3"}]}]}
    c = {"annotations": [{"image_id": 9, "caption": "one"}, {"image_id": 8, "caption": "x"}, {"image_id": 9, "caption": "two"}]}
    for name, data in (("q", q), ("a", a), ("c", c)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    paths = [str(tmp_path / f"{x}.json") for x in "qac"]
    made = vqa.generated_captions(spark, paths[0], paths[1])
    assert [(r.question_id, r.answer, r.caption) for r in made.orderBy("question_id").collect()] == [(1, "red", "The bus is red."), (2, "3", "There are three dogs.")]
    assert vqa.generated_captions(spark, paths[0], paths[1], 1).count() == 1
    assert [r.question_id for r in json_tables.all_question_ids(spark, paths[0], 2).collect()] == [2, 1]
    assert {r.image_id: r.captions for r in vqa.caption_lists(spark, paths[2]).collect()} == {9: ["one", "two"], 8: ["x"]}
    assert vqa.caption_samples(spark, paths[2], most_images=1).count() == 1
    samples = lambda ids=None: sorted((r.image_id, r.pos, r.caption) for r in vqa.caption_samples(spark, paths[2], ids).collect())
    assert [(i, c) for i, _, c in samples()] == [(8, "x"), (9, "one"), (9, "two")]
    assert [c for _, _, c in samples(spark.createDataFrame([(9,), (9,), (77,)], "image_id long"))] == ["one", "two"]
    assert len(samples(spark.createDataFrame([], "image_id long"))) == 3
    sinks.write_captions(made, str(tmp_path / "out"), *paths[:2])
    info = spark.read.json(str(tmp_path / "out/info")).first()
    assert info.num_samples == 2 and info.rule_counts.what_color == 1
    words = vocab.Vocabulary(vocab.build(made, "question"))
    batches = vqa.split_batches(spark, {"val": paths[0]}, {"val": paths[1]}, "val", words, 20, 1).collect()
    assert sorted(r.batch for r in batches) == list(range(len(batches))) and len(batches) == made.count()
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 and 3 not in r.ids for r in batches)
    with pytest.raises(ValueError, match="unknown split"):
        json_tables.split_of({"val": "x"}, "test")
    (tmp_path / "c.cfg.json").write_text('{"a": "x/y", "b": "/z", "region_cache": true, "region_cache_dir": "r"}')
    cfg = config.with_paths(config.load_config(str(tmp_path / "c.cfg.json")), ["a", "b"], "/root")
    assert (cfg["a"], cfg["b"], config.cache_folder(cfg, "region", "val"), config.cache_folder(cfg, "global", "val")) == ("/root/x/y", "/z", "r/val", None)


def test_yaml_settings_read_as_json_ones(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: x/y\nnested:\n  on: true\nlist: [1, 2]\n")
    assert config.load_config(str(tmp_path / "c.yaml")) == {"a": "x/y", "nested": {True: True}, "list": [1, 2]}


def test_read_through_computes_only_what_is_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.withColumn("f", F.col("k") * 2)

    path = str(tmp_path / "cache")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert cache.read_through(ids(1, 2), path, "k", compute).count() == 2
    assert {r.k: r.f for r in cache.read_through(ids(2, 3), path, "k", compute).collect()} == {2: 4, 3: 6}
    assert seen == [[1, 2], [3]]
    ids(2).withColumn("f", F.lit(4)).write.mode("append").parquet(path)  # as a second run at the same time might
    assert cache.read_through(ids(1, 2, 2), path, "k", compute).count() == 2


def test_places_in_groups_with_ties_and_null_keys(spark):
    rows = [(g, i // 2) for g in ("a", None) for i in range(40)] + [("b", 7)]
    got = relational.numbered(spark.createDataFrame(rows, "g string, o long"), ["g"], "o", "place").collect()
    for g, n in (("a", 40), (None, 40), ("b", 1)):
        own = sorted((r.place, r.o) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(n)) and [o for _, o in own] == sorted(o for _, o in own)
    assert relational.numbered(spark.createDataFrame([], "g string, o long"), ["g"], "o", "place").count() == 0


def test_question_context_counts_padding_and_needs_a_table(spark):
    df = spark.createDataFrame([(1, [1, 1, 0]), (2, []), (3, None)], "k long, ids array<long>")
    table = spark.createDataFrame([(0, [3.0, 0.0]), (1, [6.0, 9.0])], "id long, x array<float>")
    found = tensor.question_context(df.withColumnRenamed("ids", "own"), "k", "own", table, "id", "x", 2)
    assert {r.k: r.x for r in found.collect()} == {1: [5.0, 6.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    with pytest.raises(ValueError, match="table of vectors"):
        tensor.question_context(df, "k", "ids", None, "id", "x", 2)


def test_states_are_appended_and_the_latest_is_found(spark, tmp_path):
    path = str(tmp_path / "states")
    for epoch, seen in ((1, 50), (2, 150), (3, 100)):
        sinks.append_state(spark, path, epoch=epoch, samples_seen=seen, best=0.1 * epoch)
    assert sinks.latest_state(spark.read.parquet(path)).first().epoch == 2
    assert sinks.latest_state(spark.read.parquet(path).limit(0)).first() is None


def test_looking_up_words_makes_no_python_objects_of_the_vocabulary():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    known = pa.array([f"w{i:06d}" for i in range(100_000)])
    own = pa.array(np.arange(100_000) + 4)
    lists = pa.array([["w000007", "no"], [], None, ["w099999", "w000000"]])
    tracemalloc.start()
    found = vocab._looked_up(lists, *vocab._by_word(known, own)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [[11, 3], [], [], [100_003, 4]]
    assert peak < 3_000_000  # as Python strings they take 6 MB and more
    assert vocab._looked_up(lists, *vocab._by_word(known[:0], own[:0])).to_pylist() == [[3, 3], [], [], [3, 3]]
