"""The pipeline's stages on planted cases, and the whole on the smallest tables."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import catalog, language, linededup
from plumbline.llm.decontaminate import words_of
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_runs", "near_duplicates", "benchmark", "packing"]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's rows, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = docs.orderBy("doc_id").first().text
    extra = [
        (9001, None, None, "s", 0), (9002, "12 34", "en", "s", 5), (9003, "Это другой язык и другая азбука", "en", "s", 31), (9004, text, "en", "s", len(text)),
        (9005, "A fresh start here. " + items[0], "en", "s", 1), (9006, text.replace("the", "teh", 1), "en", "s", len(text)),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for clash in ("score", "Rejected", "n_lines", "hits"):
        docs = docs.withColumn(clash, F.lit("own"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
        docs = stage(spark, out[-1], SF)
    docs.write.parquet(str(folder / "last"))
    return [*out, spark.read.parquet(str(folder / "last"))]


def test_each_decision_takes_effect(results):
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in results]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert {9001, 9002, 9003} <= ids[0] - ids[1]
    assert 9004 not in ids[3] and 9005 in ids[3] and 9005 not in ids[4]
    assert len(ids[1]) > 0.95 * (len(ids[0]) - 3)
    assert all(df.columns == results[0].columns for df in results[:-1])
    assert results[4].where("score = 'own' and Rejected = 'own' and n_lines = 'own' and hits = 'own'").count() == len(ids[4])


def test_no_window_of_the_benchmark_is_left(spark, results):
    wanted = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text.encode())
        m = min(10, len(w))
        wanted |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    sizes = {len(x) for x in wanted}
    for r in results[4].collect():
        w = words_of(r.text.encode())
        assert not any(tuple(w[i : i + m]) in wanted for m in sizes for i in range(len(w) - m + 1)), r.doc_id


def test_run_against_brute_force(spark):
    """The stages after language identification by plain loops over the smallest tables; ids by the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = language.identify(docs, language.fit_on_fold(docs)).where("not rejected").select("doc_id", "text").collect()
    known.sort(key=lambda r: r.doc_id)
    lines = brute_lines([r.text for r in known], linededup.MIN_WORDS)
    texts = {r.doc_id: text for r, (_, removed, text) in zip(known, lines, strict=True) if not (removed and not text)}
    assert any(removed for _, removed, _ in lines)
    left = sorted({c for i, c in brute_classes(texts).items()})
    assert len(left) < len(texts)
    wanted = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text.encode())
        m = min(10, len(w))
        wanted |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    sizes = {len(x) for x in wanted}

    def leaks(text):
        w = words_of(text.encode())
        return any(tuple(w[i : i + m]) in wanted for m in sizes for i in range(len(w) - m + 1))

    library = Tokenizer.from_file(catalog.tokenizer(catalog.WORD_BPE))
    ids = {i: np.array([*library.encode(texts[i], add_special_tokens=False).ids, 1], "<u4") for i in left if not leaks(texts[i])}
    assert len(ids) < len(left)
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    for own in (list(g) for _, g in itertools.groupby(rows, lambda r: r.sequence_id)):
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == found.get(r.doc_id, 0) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        found[r.doc_id] = r.start + r.length
    assert found == {i: len(x) for i, x in ids.items()}


def test_run_gives_pieces_and_empty_tables_pass(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
