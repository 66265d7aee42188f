"""Operator 2: Wu-Manber over words against a plain search."""

import hashlib
import pickle
import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import catalog, decontaminate
from plumbline.llm.decontaminate import WuManber, benchmark_hits, digest, words_of
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=3, max_size=3), max_size=6), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_every_occurrence_is_found(words, patterns, length):
    known = {tuple(p[:length]): {str(i)} for i, p in enumerate(patterns)}
    got = {(i, tuple(x)) for i, x in WuManber(length, known).find(words)} if known else set()
    want = {(i, tuple(sorted(known[tuple(words[i : i + length])]))) for i in range(len(words) - length + 1) if tuple(words[i : i + length]) in known}
    assert got == want


def brute(text, items):
    words, hit, names = words_of(text.encode() if text else None), set(), set()
    for name, body in items:
        own = words_of(body.encode() if body else None)
        m = min(10, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_cases_and_many_passes(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [("1", long), ("2", "Short, item"), ("2", "other words"), ("3", None), ("4", "... !!"), ("5", "été")]
    texts = [None, "", "!!", f"x {long.upper()} y", "short ITEM! short item", " ".join(f"w{i}" for i in range(5, 15)), "an ÉTÉ été", ("w1 " * 50_000) + long, f"x {long.upper()} y"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, Hits string")
    for limit in ({}, {"pass_bytes": 100}, {"pass_windows": 3}):  # the first item is split over passes
        got = {r.doc_id: r for r in digest(benchmark_hits(docs, bench, **limit)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            if len(t or "") < 1000:
                assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == brute(t, items), (limit, i)
        assert got[7].n_hit == 25 and got[7].contaminated
    assert digest(benchmark_hits(docs, bench.limit(0))).where("contaminated").count() == 0
    assert benchmark_hits(docs.limit(0), bench).count() == 0


def test_a_pass_of_windows_stays_small():
    """A tenth of a full pass; its tables and its pickle must stay below a tenth of 500 MB."""
    rng, n = random.Random(1), decontaminate.PASS_WINDOWS // 10
    words = [f"word{i}" for i in range(20_000)]
    text = " ".join(rng.choices(words, k=n + decontaminate.WINDOW - 1)).encode()
    tracemalloc.start()
    tables = pickle.loads(pickle.dumps(decontaminate.build((w, ["item"]) for w in decontaminate.windows_of(text))))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sum(len(p) for b in tables[0].bucket.values() for p in b.values()) == n
    assert held < 50_000_000


def test_query_against_sql(spark):
    assert_same(catalog.op2_wu_manber(spark, SF), connect(SF), catalog.ORACLES["op2_wu_manber"])
