"""Operator 1: rules per line, verdicts, edge cases and the query's SQL."""

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import catalog, quality
from tests.duck import assert_same, connect

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def brute_repeat(words):
    hit = set()
    for i in range(len(words) - 4):
        for j in range(len(words) - 4):
            if i != j and words[i : i + 5] == words[j : j + 5]:
                hit |= set(range(i, i + 5))
    return len(hit)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_repeated_windows(words):
    assert quality.repeat_words(words) == brute_repeat(words)


def test_rules_and_verdicts(spark):
    good = "A plain sentence that ends as it should, with enough words in it."
    rows = [
        (1, good), (2, None), (3, ""), (4, " \t\n \x0b"), (5, "Home | News | Sport | Shop | Help\n" + good), (6, "BUY!! NOW!! IT!! IS!! CHEAP!! SO!! BUY!! MORE!! OF!! IT!!"),
        (11, "See http://a.example and WWW.b.example for it\nTous droits réservés.\nKlicken Sie hier\n" + good + "\nAnother sentence has its own words, and stands below."),
        (7, "All rights reserved, see the terms of use.\n" + good), (8, "one two"), (9, "x " * 200_000), (1, good), (10, "été über 日本 ñ a b c d e f"),
    ]
    df = spark.createDataFrame([(*r, "old", None) for r in rows], "doc_id long, text string, KEPT string, other string")
    got = {r.doc_id: r for r in quality.line_quality(df).collect()}
    assert quality.line_quality(df).count() == len(rows)
    assert [c for c in quality.line_quality(df).columns if c.lower() == "kept"] == ["kept"]
    assert got[1].kept and got[1].clean_text == good
    assert not got[2].kept and got[2].base_failed and got[2].clean_text is None and got[2].n_words == 0
    assert not got[3].kept and got[3].clean_text == "" and not got[4].kept
    assert got[5].n_failed_lines == 1 and got[5].kept and got[5].clean_text == good
    assert not got[6].kept and not got[6].base_failed
    assert got[7].n_failed_lines == 1 and got[7].kept
    assert got[11].n_failed_lines == 3 and got[11].clean_text == f"{good}\nAnother sentence has its own words, and stands below."
    assert got[8].base_failed and got[9].n_repeat_words == 200_000 and not got[9].kept
    assert got[10].word_chars == 3 + 4 + 2 + 1 + 6 and got[10].n_words == 10
    assert quality.line_quality(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    assert_same(catalog.op1_line_quality(spark, SF), connect(SF), catalog.ORACLES["op1_line_quality"])


def test_labelled_good_documents_are_kept(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    found = catalog.op1_line_quality(spark, LARGE).where("not base_failed").join(labels, "doc_id").where("toxic = 0").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= n.get((0, False), 0)


def test_phrases_in_capitals_of_any_script():
    for line in ("DATENSCHUTZERKLÄRUNG und Impressum", "POLITIQUE DE CONFIDENTIALITÉ", "SUSCRÍBETE A nuestro boletín", "Zurück Zum Seitenanfang", "ALL RIGHTS RESERVED"):
        assert quality.failing_rule(line.encode(), line.encode().split(), len(line.replace(" ", ""))) == "boilerplate"
    assert quality.failing_rule("Größe und Stärke".encode(), [b"x"] * 3, 14) is None
