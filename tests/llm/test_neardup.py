"""Operator 4: signatures, exact similarity and classes against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, common, neardup
from plumbline.llm.components import components
from plumbline.llm.neardup import probability_jaccard, shingles, signatures

SF, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_similarity(x, y):
    a, b = dict(zip(*(v.tolist() for v in x), strict=True)), dict(zip(*(v.tolist() for v in y), strict=True))
    both = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both) for i in a.keys() & b.keys())


def brute_classes(texts):
    sets = {i: shingles(t.encode()) if t is not None else None for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if texts[i] is None or texts[j] is None:
                continue
            if texts[i] == texts[j] or (len(sets[i][0]) and len(sets[j][0]) and probability_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sets = []
        for _ in range(2):
            h = np.unique(rng.integers(0, 30, 20)).astype(np.uint64)
            sets.append((h, 1 + np.log(rng.integers(1, 5, len(h)))))
        assert probability_jaccard(*sets) == pytest.approx(brute_similarity(*sets))


def test_registers_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(2)
    x = (np.sort(neardup.mix(np.arange(300, dtype=np.uint64))), 1 + np.log(rng.integers(1, 4, 300)))
    y = (x[0][30:], x[1][30:])
    a, b = signatures([x, y], 4096)
    assert abs((a == b).mean() - brute_similarity(x, y)) < 0.03


@pytest.mark.parametrize("small", [0, 1])
def test_classes_with_copies_chains_and_odd_rows(spark, monkeypatch, small):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = {0: " ".join(base), 1: " ".join(base), 2: " ".join([*base[:60], word(), *base[61:]]), 3: None, 4: "", 5: "", 6: "one two", 7: "One, two!", 8: "...", 9: None}
    for k in range(10, 40):  # a chain: each a little further from the start
        base = [*base[:k], word(), *base[k + 1 :]]
        texts[k] = " ".join(base)
    for k in range(40, 60):
        texts[k] = " ".join(word() for _ in range(50))
    rows = [(i, t, 1, f"of {i}") for i, t in texts.items()] + [(0, texts[0], 1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int, kept_key string").withColumns({"digest": F.lit("x"), "digest_of_class": F.create_map(F.lit(1), F.lit(2))})
    if small == 0:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute_classes(texts)
    kept = neardup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_classes(texts).values()))
    assert all(r.class_id == 1 and r.digest == "x" and r.digest_of_class == {1: 2} for r in kept) and kept[0].asDict().keys() == set(df.columns)
    # of two rows with equal key and text, the same one stays however the rows are dealt
    stay = {next(r.kept_key for r in neardup.keep_one(d).collect() if r.doc_id == 0) for d in (df, df.repartition(7, "kept_key"), df.orderBy(F.desc("kept_key")))}
    assert len(stay) == 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in catalog.op4_prob_minhash(spark, SF).collect()}
    want = brute_classes(docs)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_recall_of_searches(spark):
    """Every row whose id is divisible by 50 against all rows: each text of similarity 0.8 or more shares its class."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in catalog.op4_prob_minhash(spark, MEDIUM).collect()}
    sets = {i: shingles(t.encode()) for i, t in docs.items()}
    pairs = [(i, j) for i in docs if i % 50 == 0 for j in docs if i != j and probability_jaccard(sets[i], sets[j]) >= neardup.SIMILARITY]
    assert pairs and all(got[i] == got[j] for i, j in pairs)


def test_components_of_a_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("repeats", [False, True])
def test_blocks_join_all_similar_texts_of_a_bucket(spark, monkeypatch, repeats):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    centre = [[word() for _ in range(120)] for _ in range(3)]
    rows, sets = [], {}
    for node in range(24):
        body = list(centre[node % 3])
        for _ in range(rng.choice((1, 1, 2))):  # one change each: similar; more: not
            body[rng.randrange(120)] = word()
        text = " ".join(body * (1 + repeats * (1 + node % 2)))
        rows.append((node % 2, 0, node, 0 if node < 9 else node, [node % 2], text))
        sets[node] = shingles(text.encode())
    df = spark.createDataFrame(rows, "bucket long, band int, node long, comp long, bands array<long>, text string")
    links = [(r.a, r.b) for r in neardup._compared(df, 0.8).collect()]
    near = lambda a, b: probability_jaccard(sets[a], sets[b]) >= 0.8
    assert links and all(a > b and near(a, b) for a, b in links)
    comp = {node: c for _, _, node, c, _, _ in rows}

    def closed(pairs):
        pairs, reach = [*pairs, *comp.items()], {n: n for n in comp}
        for _ in range(len(comp)):
            for a, b in pairs:
                reach[a] = reach[b] = min(reach[a], reach[b])
        return reach

    assert closed(links) == closed([(a, b) for a in comp for b in comp if a > b and a % 2 == b % 2 and near(a, b)])


def test_keys_named_like_new_columns(spark):
    df = spark.createDataFrame([(5, "a few words"), (6, "a few words"), (7, None)], "n long, text string")
    for name in ("class_id", "digest", "KEPT", "class_size", "node", "bucket"):
        got = neardup.near_duplicates(df.withColumnRenamed("n", name), key=name)
        own = name if name in ("node", "bucket") else f"{name}_of_input"
        assert sorted((r[own], r["class_id"]) for r in got.collect()) == [(5, 5), (6, 5), (7, 7)]
