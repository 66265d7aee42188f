"""Operator 8: repeated runs against brute force and SQL."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, linededup
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"
WHITE = " \t\x0b\f\r"


def brute(rows, least):
    """Per row (in order): lines that a run of ``least`` words or more with an earlier copy covers."""
    docs = [[x for x in (t or "").split("\n") if x.strip(WHITE)] for t in rows]
    flat = [(d, p, line.strip(WHITE)) for d, lines in enumerate(docs) for p, line in enumerate(lines)]
    gone = set()
    for i in range(len(flat)):
        for j in range(i):
            k = n = 0
            while i + k < len(flat) and flat[i + k][0] == flat[i][0] and j + k < len(flat) and flat[j + k][0] == flat[j][0] and flat[i + k][2] == flat[j + k][2]:
                n += len(flat[i + k][2].split())
                k += 1
            if n >= least:
                gone |= {flat[i + m][:2] for m in range(k)}
    out = []
    for d, lines in enumerate(docs):
        keep = [x for p, x in enumerate(lines) if (d, p) not in gone]
        out.append((len(lines), len(lines) - len(keep), rows[d] if len(keep) == len(lines) else "\n".join(keep)))
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(6)
    lines = ["a b", "c d e", "f", "g h i j", " f", "", "k l m"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None, "x\n" * 40, "y z " * 30, "y z " * 30]
    rows = [(i, t, f"u{i}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Lines string, other string")
    for least in (1, 4, 9):
        got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.text) for r in linededup.drop_repeated_lines(df, min_words=least).collect()}
        want = brute(texts, least)
        assert [got[i] for i in range(len(texts))] == want, least


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"head\n{passage}\ntail"), (1, f"{passage}\nmore"), (None, passage), (3, None), (4, ""), (2, f"head\n{passage}\ntail"), (5, "\n".join(str(i) for i in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_repeated_lines(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].n_removed_lines == 0 and by[1].text == "more" and by[2].text == "head\ntail"
    assert by[3].text is None and by[3].n_lines == 0 and by[4].text == "" and by[5].n_lines == 3000
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    passage = [" ".join(f"w{i}_{j}" for j in range(10)) for i in range(6)]
    first, later = "\n".join(["head", *passage, "tail"]), "\n".join(["top", *passage, "end"])
    for copies in ((3, 1), (1, 3), (3, 3)):
        rows = [(1, first)] * copies[0] + [(2, later)] * copies[1]
        got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.text for r in got if r.doc_id == 1) == [first] * copies[0], copies
        assert sorted((r.n_removed_lines, r.text) for r in got if r.doc_id == 2) == [(6, "top\nend")] * copies[1], copies
    inside = "\n".join([*passage, "between", *passage])
    got = linededup.drop_repeated_lines(spark.createDataFrame([(1, inside)] * 3, "doc_id long, text string")).collect()
    assert [r.text for r in got] == ["\n".join([*passage, "between"])] * 3


@pytest.mark.parametrize("copies", [1, 2, 50])
def test_repeated_rows_against_sql_and_brute_force(spark, tmp_path, copies):
    rng = random.Random(copies)
    runs = [[" ".join(f"w{k}_{i}_{j}" for j in range(9)) for i in range(8)] for k in range(3)]
    texts = ["\n".join([f"head {i}", *rng.choice(runs), "", f"between {i}", *rng.choice(runs)[1:], f"tail {i}"]) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(copies if i % 3 else 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(catalog.op8_line_runs(spark, str(tmp_path)), connect(str(tmp_path)), catalog.ORACLES["op8_line_runs"])
    want = brute(texts, linededup.MIN_WORDS)
    got = [(r.doc_id, (r.n_lines, r.n_removed_lines, r.text)) for r in catalog.op8_line_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows) and any(n for _, n, _ in want)


def test_maps_anywhere_in_other_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, passage)], "doc_id long, text string")
    df = df.withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "s": F.struct(F.create_map(F.lit("a"), F.lit(1)).alias("deep")), "l": F.array(F.create_map(F.lit(1), F.lit(2)))})
    assert sorted((r.doc_id, r.n_removed_lines, r.s.deep["a"]) for r in linededup.drop_repeated_lines(df).collect()) == [(1, 0, 1), (2, 1, 1)]


def test_query_against_sql(spark):
    assert_same(catalog.op8_line_runs(spark, SF), connect(SF), catalog.ORACLES["op8_line_runs"])


def test_only_dataframe_functions():
    source = open(linededup.__file__).read()
    assert not [w for w in ("udf", "mapIn", "applyIn", "pandas", "pyarrow", ".rdd") if w in source]
