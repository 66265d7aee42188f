"""Operator 10: language identification by nearest centroids.

A text is a vector of hashed letter n-grams (1 to 3, runs of other characters read as one space) with
TF-IDF weights and unit length. Each language is learnt as several centroids by spherical k-means over
a bounded sample; a text takes the language of the centroid nearest by cosine, and is rejected if even
that one is too far. How far is too far is learnt for each language from its own labelled texts.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, give_back, join_narrow, map_texts

#: Width of a vector; centroids per language; rounds of k-means.
WIDTH, CENTROIDS, ROUNDS = 1 << 13, 4, 12
#: Labelled rows per language that the fit uses (the documented bound); characters of each in the vector are all of it.
SAMPLE_PER_LANGUAGE = 600
#: Languages whose centroids one pass over the texts holds (128 KB each); more take more passes.
PASS_LANGUAGES = 256
#: A text is rejected below its nearest language's floor: this share of the low quantile of the cosines that the
#: language's own labelled texts have with centroids learnt from others of them.
FLOOR_QUANTILE, FLOOR_SHARE = 0.01, 2 / 3
#: The floor of a language with fewer labelled texts of enough n-grams than FLOOR_ROWS, the least any language has,
#: and that of texts of fewer different n-grams (about 15 letters), whose cosine is low in any language.
LEAST_COSINE, FLOOR_ROWS, FLOOR_GRAMS = 0.08, 20, 48
UNKNOWN = "und"

# Odd multipliers of the n-gram hash.
P1, P2, P3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D

OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in each Python worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of the whole text; empty if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    stay = is_letter | np.concatenate([[True], is_letter[:-1]])
    c = np.where(is_letter, code, np.uint32(32))[stay]
    ends = np.flatnonzero(c != 32)
    c = np.concatenate([np.array([32], np.uint32), c[ends[0] : ends[-1] + 1], np.array([32], np.uint32)])
    one = c * np.uint32(P1)
    two = one[:-1] ^ c[1:] * np.uint32(P2)
    three = two[:-1] * np.uint32(P1) ^ c[2:] * np.uint32(P3)
    every = np.concatenate([one[c != 32], two * np.uint32(P2), three * np.uint32(P3)])
    return ((every ^ every >> np.uint32(15)) * np.uint32(P1) >> np.uint32(32 - WIDTH.bit_length() + 1)).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts per text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        g = grams(t)
        if len(g):
            out[i] = np.bincount(g, minlength=WIDTH)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(x) * idf)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started at the farthest points from the mean; the same for the same rows."""
    centres = unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))][None]])
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        centres = unit(np.vstack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def floor_of(x: np.ndarray, idf: np.ndarray, k: int) -> float:
    """The least cosine for a language of which these are the n-gram counts: each half of the rows is held against the other."""
    x = weigh(x[(x > 0).sum(axis=1) >= FLOOR_GRAMS], idf)
    if len(x) < FLOOR_ROWS:
        return LEAST_COSINE
    halves = x[::2], x[1::2]
    own = [(a @ k_means(b, k).T).max(axis=1) for a, b in (halves, halves[::-1])]
    return max(LEAST_COSINE, FLOOR_SHARE * float(np.quantile(np.concatenate(own), FLOOR_QUANTILE)))


@dataclass
class Model:
    """idf (WIDTH values) and the table (lang, j, floor, c): a unit centroid a row, k per language at most."""

    idf: np.ndarray
    table: DataFrame | None
    langs: list[str]


def vectors(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with dims and counts: the n-grams of each whole text, at most WIDTH of them whatever its length."""
    out = T.StructType([T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])

    def compute(texts: list) -> dict[str, list]:
        found = [np.unique(grams(t), return_counts=True) for t in texts]
        return {"dims": [d.astype(np.int32) for d, _ in found], "counts": [c.astype(np.float32) for _, c in found]}

    return map_texts(df, text, compute, out, keep, as_bytes=False)


def sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, nth, text): of each language, the ``per_language`` rows of the least ``at``, then ``tie``; all if there are fewer.

    ``rows``: lang, at, tie (two hashes of the row), text. The choice is made on the hashes alone, and exactly: each
    partition keeps its own first ones before anything is shuffled, so neither a language nor a key that holds
    much of the table comes to one task. Rows that are equal in both hashes are one text that counts as often
    as it was chosen; its copies are reduced where they lie.
    """
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at", "tie"))
    chosen = rows.select("lang", "at", "tie").withColumn("nth", nth).where(F.col("nth") <= per_language)
    times = cut(chosen.groupBy("lang", "at", "tie").agg(F.count(F.lit(1)).alias("times")))
    found = join_narrow(rows, times, ["lang", "at", "tie"]).groupBy("lang", "at", "tie").agg(F.max("times").alias("times"), F.any_value("text").alias("text"))
    each = found.select("lang", "at", "tie", "text", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("k"))
    return each.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy("at", "tie", "k")).alias("nth"), "text")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", order: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """The model learnt from at most ``per_language`` rows of each language: those with letters in their
    text and the least hash of ``order`` (if given) and the text.

    Rows without text or language are left out; from a table without any, no language is learnt.
    Sampled texts are turned into vectors where they lie, so what a language's task gathers is bounded
    by ``per_language`` vectors. The driver gets document frequencies (WIDTH numbers) and the names of
    the languages; centroids stay a table.
    """
    own = [F.col(f"`{c}`") for c in ([order] if order else []) + [text]]
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(*own).alias("at"), F.hash(*own).alias("tie"))
    known = cut(vectors(sampled(rows.where(r"lang is not null and text rlike '\\p{L}'"), per_language), "text", ["lang", "nth"]))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return Model(np.ones(WIDTH, np.float32), None, [])
    total, within = known.count(), np.zeros(WIDTH)
    for r in known.select(F.explode("dims").alias("dim")).groupBy("dim").count().collect():
        within[r["dim"]] = r["count"]
    idf = np.log((1 + total) / (1 + within)).astype(np.float32) + np.float32(1)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        x = np.zeros((len(pdf), WIDTH), np.float32)
        for i, (d, c) in enumerate(zip(pdf["dims"], pdf["counts"], strict=True)):
            x[i, d] = c
        found = k_means(weigh(x, idf), k)
        floor = floor_of(x, idf, k)
        del x
        give_back()
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "j": range(len(found)), "floor": floor, "c": list(found.astype(np.float32))})

    return Model(idf, cut(known.groupBy("lang").applyInPandas(centroids, "lang string, j int, floor double, c array<float>")), langs)


def _nearest(df: DataFrame, text: str, keep: list[str], idf: np.ndarray, rows: list, names: list[str]) -> DataFrame:
    """``keep`` with the nearest of these centroids (lang, floor, c), its cosine and whether it is too far, under ``names``."""
    centres = np.array([r.c for r in rows], np.float32).reshape(len(rows), WIDTH)
    shared = df.sparkSession.sparkContext.broadcast((idf, centres.T.copy(), [(r.lang, r.floor) for r in rows]))
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, OUT.fields, strict=True)])

    def compute(texts: list) -> dict[str, list]:
        idf, centres, of = shared.value
        found: list[list] = [[], [], []]
        for a in range(0, len(texts), 64):
            x = counts(texts[a : a + 64])
            blank, few = ~x.any(axis=1), (x > 0).sum(axis=1) < FLOOR_GRAMS
            cosine = weigh(x, idf) @ centres
            best = cosine.argmax(axis=1) if of else np.zeros(len(x), np.int64)
            for i, j in enumerate(best.tolist()):
                if blank[i] or not of:
                    one = (UNKNOWN, 0.0, bool(blank[i]))
                else:
                    score = min(1.0, max(0.0, float(cosine[i, j])))
                    one = (of[j][0], score, score < (LEAST_COSINE if few[i] else of[j][1]))
                for column, v in zip(found, one, strict=True):
                    column.append(v)
        return dict(zip(names, found, strict=True))

    return map_texts(df, text, compute, out, keep, as_bytes=False)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected.

    A text that is null or has no letter gets ``und``, score 0 and is rejected; any other gets a learnt
    language, and is rejected if the score is below that language's floor (below LEAST_COSINE if it has
    fewer than FLOOR_GRAMS different n-grams). If no language was learnt, the others get ``und`` and
    score 0 too, and are not rejected. Ties go to the first language. One row for each input row; new
    columns replace input columns of the same name. No shuffle; more than PASS_LANGUAGES languages take
    more passes over the texts.
    """
    fresh = {n.lower() for n in OUT.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in fresh]
    blocks = [model.langs[i : i + PASS_LANGUAGES] for i in range(0, len(model.langs), PASS_LANGUAGES)] or [[]]
    found, made = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text]))), []
    for b, block in enumerate(blocks):
        rows = sorted(model.table.where(F.col("lang").between(block[0], block[-1])).collect(), key=lambda r: (r.lang, r.j)) if block else []
        names = OUT.names if len(blocks) == 1 else [f"{n}_of_pass_{b}" for n in OUT.names]
        found = _nearest(found, text, kept if len(blocks) == 1 else found.columns, model.idf, rows, names)
        made.append(names)
    if len(blocks) == 1:
        return found
    passes = [F.struct(F.col(s).alias("score"), F.lit(-b).alias("first"), F.col(p).alias("lang_pred"), F.col(r).alias("rejected")) for b, (p, s, r) in enumerate(made)]
    best = F.array_max(F.array(*passes))
    return found.select(*(F.col(f"`{c}`") for c in kept), *(best[n].alias(n) for n in OUT.names))


def held_out(key: str) -> F.Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def fit_on_fold(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model learnt from the rows that are not held out."""
    fold = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(~held_out("k"))
    return fit(fold, "t", "l", "k")
