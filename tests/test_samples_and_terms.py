"""Exact shares, threshold samples, sets of samples, and many terms at once, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import quoted
from tessella.operators import cohort, keywords, score, term_automaton

STRATA = "key long, stratum string"


@pytest.mark.parametrize("sizes", [[1], [3, 1, 1, 1, 2], [7, 11, 13, 100, 1, 1], [10, 10, 10], []])
def test_apportioned_split(spark, sizes):
    rows = [(100 * s + i, None if s == 1 else f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    got = cohort.apportioned_split(spark.createDataFrame(rows, STRATA), "key", "stratum").collect()
    n = len(rows)
    by = Counter(r["split"] for r in got)
    assert Counter((r["key"], r["stratum"]) for r in got) == Counter(rows)
    train = n * 70 // 100
    assert (by["train"], by["val"]) == (train, (n - train) * 15 // 30)
    for s, size in enumerate(sizes):
        own = Counter(r["split"] for r in got if r["stratum"] == (None if s == 1 else f"s{s}"))
        assert abs(own["train"] - size * 0.7) < 1 and abs(own["val"] - (size - own["train"]) / 2) < 1


@pytest.mark.parametrize("n", [0, 1, 5, 500, 1999, 2000, 5000])
def test_fixed_sample_is_the_least_hashes(spark, n):
    df = spark.range(2000).select((F.col("id") * 7 + 1).alias("key"), F.lit("x").alias("_h2")).repartition(5)
    want = sorted(range(1, 14001, 7), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:n]
    assert sorted(r["key"] for r in cohort.fixed_sample(df, "key", n).collect()) == sorted(want)


def test_fixed_sample_of_equal_and_null_keys(spark):
    df = spark.createDataFrame([(1,)] * 40 + [(None,)] * 40 + [(2,)] * 3, "key long")
    assert all(cohort.fixed_sample(df, "key", n).count() == min(n, 83) for n in (1, 39, 41, 80, 90))
    assert cohort.fixed_sample(df.limit(0), "key", 5).count() == 0


def test_sets_of_samples(spark):
    rows = [(s, i) for s in "abcd" for i in range(50)] + [("e", i + 1) for i in range(50)] + [("f", i) for i in range(49)]
    rows = [r for r in rows if r != ("d", 7)] + [("d", 50)]
    scores = spark.createDataFrame(rows, "strategy string, sample_id long").repartition(4)
    got = {(r["strategy_a"], r["strategy_b"]): r["aligned"] for r in score.aligned_pairs(scores).collect()}
    assert len(got) == 15 and {k for k, v in got.items() if v} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert sorted(score.aligned_with(scores, "b")) == ["a", "b", "c"] and score.aligned_with(scores, "f") == ["f"]


ODD = ["the", "The", "of the", "a", "a a", "(b)", "c++", "x-ray", "é", "café", "l'été", "漢", "_u", "3.5", "-", "mg/dl", "å", "ab", "b c d", "²", "i̇"]


def test_terms_as_by_regexes(spark, monkeypatch):
    rng = random.Random(3)
    parts = [*ODD, " ", " ", " ", ", ", "\n", "b", "x", "_", "́", "²", "ß", "A", "À"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "a " * 5000, "A a a a"]
    docs = spark.createDataFrame([(t, "n") for t in texts], "text string, term string").repartition(3)
    found = lambda t: F.regexp_count(F.lower("text"), F.lit("\\b" + quoted(t.lower()) + "\\b"))
    counts = docs.agg(*[F.sum((found(t) > 0).cast("long")) for t in ODD], *[F.sum(found(t)) for t in ODD]).first()
    want = {t: (counts[i], counts[len(ODD) + i]) for i, t in enumerate(ODD)}
    for most in (8_000_000, 12):
        monkeypatch.setattr(term_automaton, "MOST_CHARS", most)
        got = term_automaton.term_frequency(docs, "text", ODD).collect()
        assert {r["term"]: (r["n_docs"], r["n_occurrences"]) for r in got} == want
    table = spark.createDataFrame([(t,) for t in [*ODD, "the", None, ""]], "term string")
    got = term_automaton.term_frequency(docs, "text", table).collect()
    assert {r["term"]: (r["n_docs"], r["n_occurrences"]) for r in got} == want | {"": (0, 0)}
    assert {r["term"]: r["n_docs"] for r in keywords.term_document_frequency(docs, "text", ODD).collect()} == {t: n for t, (n, _) in want.items()}


def test_a_hundred_thousand_terms(spark):
    terms = [f"w{i % 1000} v{i // 1000}" for i in range(100_000)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice("wv") + str(rng.randrange(100)) for _ in range(200)) for _ in range(40)]
    want = Counter(m for t in texts for m in set(re.findall(r"(?=\b(w\d+ v\d+)\b)", t)))
    got = term_automaton.term_frequency(spark.createDataFrame([(t,) for t in texts], "text string"), "text", terms)
    assert {r["term"]: r["n_docs"] for r in got.where("n_docs > 0").collect()} == want
    assert got.count() == 100_000
