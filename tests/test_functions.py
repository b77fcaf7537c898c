"""Expressions on edge cases, with the results worked out by hand or by plain Python."""

import json
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.functions import metrics as M
from tessella.functions import text as X
from tessella.operators import chunk, cohort, hooks, keywords, rank, resample, score
from tessella.streaming import scoring


def values(spark, items, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_codes(spark):
    assert values(spark, ["F329", " F32.9 ", "F17210", "F05", "", None], L.format_code) == ["F32.9", "F32.9", "F17.210", "F05", "", None]
    assert values(spark, ["F32.9, F419", "", None, " F329 ,"], L.comma_list) == [["F32.9", "F41.9"], [""], [""], ["F32.9", ""]]
    assert values(spark, ["F32.9, F419", "F29 R45851", "", None], L.mixed_list) == [["F32.9", "F41.9"], ["F29"], [], []]
    assert values(spark, ["F32.9, R1", "", None], L.comma_codes) == [["F32.9"], [], []]
    assert values(spark, [" F329, F41 ,", "", None], L.blank_list) == [["F329", "F41", ""], [], []]
    assert values(spark, ["F329,F41 R1", "", None], L.comma_or_blank_codes) == [["F329", "F41"], [], []]
    assert values(spark, ["F329; F41; ", "", None], L.semicolon_list) == [["F329", "F41"], [], []]
    assert values(spark, [["F1", "F2"], []], L.codes_json, "array<string>") == ['["F1", "F2"]', "[]"]
    assert values(spark, ['["F1", "F2"]', "[]", '["F1", "R2"]', '{"a": 1}', "[1]", "['F1']", None], L.is_code_json) == [True, True, False, False, False, False, False]
    assert values(spark, ["F10.20", "F32.9", "F00", "F99.1", "X"], L.category) == ["Substance Use", "Mood Disorders", "Cognitive Disorders", "Other", "Other"]
    assert values(spark, ["F10.20", "F45", "G1"], L.chapter) == ["F10-F19", "F40-F48", "neutral"]
    assert values(spark, ["F10.1", "F10.21", "F10.9", "F10.5", "F10"], L.severity) == ["Abuse", "Dependence", "Unspecified", "Other", "Other"]
    assert values(spark, ["F10.21", "F10.20", "F10.22", "F10.2"], L.remission) == ["In Remission", "Active", "Unknown", "Unknown"]
    assert values(spark, ["12", "0012", "a1", None], L.normal_id) == ["12", "12", "a1", None]


def loads(text, checked):
    """The response rules in plain Python, distinct mentions in order."""
    clean = re.sub(r"```\s*", "", re.sub(r"```json\s*", "", text))
    left, right = clean.find("["), clean.rfind("]")
    found = list(dict.fromkeys(re.findall(r"F\d{2}(?:\.\d+)?", text)))
    if left < 0 or right < 0:
        return found
    try:
        parsed = json.loads(clean[left : right + 1])
    except json.JSONDecodeError:
        return found
    out = []
    for x in parsed if isinstance(parsed, list) else []:
        if isinstance(x, str) and x.startswith("F"):
            out.append(x)
        elif isinstance(x, dict) and "code" in x and (not checked or isinstance(x["code"], str) and x["code"].startswith("F")):
            out.append(x["code"])
    return out


RESPONSES = [
    '["F32.9", "F17.210"]', '```json\n["F32.9"]\n```', "The codes are F32.9 and F41.9, F32.9.", '["F32.9", "F41', '["F1"] junk ["F2"]', '[{"code": "F20.0"}, "F29"]', '[{"code": "R20"}, "F29", 5, null]',
    "[]", '{"a": 1}', "['F32.9']", '["F32.9",]', 'text ["F05"] more', "] [", "", '["R1", "F2"]', '[["F1"]]', '["F10.10", {"name": "x"}]', "[1, 2]", '["F33"] ] F44',
]


@pytest.mark.parametrize("checked", [False, True])
def test_responses(spark, checked):
    assert values(spark, RESPONSES, lambda c: L.response_codes(c, checked)) == [loads(t, checked) for t in RESPONSES]


def test_checkpoint_responses(spark):
    items = ['["F32.9", "R1", {"code": "F20"}]', ' ```json ["F1"]```', 'x ["F32.9"]', "F01 F02 F03 F01 F04 F05 F06", '["F32.1234", ', "[]"]
    assert values(spark, items, L.checkpoint_codes) == [["F32.9", "F20"], ["F1"], ["F32.9"], ["F01", "F02", "F03", "F04", "F05"], ["F32.123"], []]
    assert values(spark, ["a<|start|>assistant b <|start|>assistant\n c ", "plain"], L.assistant_segment) == ["c", "plain"]


def loop_windows(n, size, overlap):
    if n <= size:
        return [(0, n)]
    out, at = [], 0
    while at < n:
        end = min(at + size, n)
        out.append((at, end))
        if end >= n:
            break
        at = end - overlap
    return out


def test_windows(spark):
    for size, overlap in ((2800, 200), (200, 20), (5, 0), (3, 2)):
        ns = sorted({0, 1, size - 1, size, size + 1, 2 * size - overlap, 2 * size - overlap + 1, 5 * size + 3})
        got = values(spark, ns, lambda c: X.window_spans(c, size, overlap), "int")  # noqa: B023
        for n, spans in zip(ns, got):
            assert [(s["start_token"], s["end_token"]) for s in spans] == loop_windows(n, size, overlap)
            assert [s["chunk_idx"] for s in spans] == list(range(len(spans))) and {s["total_chunks"] for s in spans} == {len(spans)}
    with pytest.raises(ValueError, match="overlap"):
        X.window_spans(F.lit(1), 5, 5)


def test_chunk_texts_cover_the_text(spark):
    text = " ".join(f"w{i}" for i in range(23))
    df = spark.createDataFrame([(1, text, ["F1"]), (2, "a  b", ["F2"]), (3, "", []), (4, None, None)], "id int, text string, codes array<string>")
    rows = chunk.chunk_texts(df, "text", 10, 3, ("id", "codes")).collect()
    own = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["chunk_info"]["chunk_idx"])
    assert [r["input"].split()[0] for r in own] == ["w0", "w7", "w14"] and own[-1]["input"].endswith("w22") and all(r["codes"] == ["F1"] for r in own)
    assert {r["id"]: r["input"] for r in rows if r["id"] > 1} == {2: "a  b", 3: "", 4: None}


def test_sentences_and_keywords(spark):
    text = "Dr. Who came. He has Anxiety!  Nothing else?\nOk."
    assert values(spark, [text], X.sentences) == [re.split(r"(?<=[.!?])\s+", text)]
    assert values(spark, [text.lower()], lambda c: X.sentences(c, lines=True)) == [re.split(r"(?<=[.!?])\s+|\n+", text.lower())]
    long = "Has anxiety and more words here. " * 5 + "Other."
    df = spark.createDataFrame([(1, text), (2, long), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r for r in keywords.extracted(df, "text", ["ANXIETY"]).collect()}
    assert got[1]["extraction_method"] == "full_text_fallback" and got[1]["extracted"] == text and got[1]["n_kept"] == 1
    assert got[2]["extraction_method"] == "psychiatric_extraction" and got[2]["extracted"] == ("Has anxiety and more words here. " * 5).strip()
    assert got[3]["extracted"] == "" and got[4]["extracted"] is None
    heads = "Social History:\nx\nPlan: now\n Medications:\nDischarge Diagnosis: \nAB:\n"
    assert values(spark, [heads], X.headers) == [["social history", "discharge diagnosis"]]
    assert values(spark, ["don't be the one, it's ok"], X.indicator_words) == [["don't", "one", "it's"]]


def test_enrichment_against_counter(spark):
    docs = ["a pain here. no pain there.\nfine day", "pain pain fever. other day", "fever day"]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    got = {r["word"]: r for r in keywords.enrichment(df, "text", ["fever"], least=1).collect()}
    assert got["pain"]["enrichment_ratio"] == pytest.approx((2 / 5) / (2 / 8)) and got["fever"]["enrichment_ratio"] == float("inf")
    assert set(got) == {"pain", "fever", "day"}
    floor = {r["word"]: r["enrichment_ratio"] for r in keywords.enrichment(df, "text", ["fever"], least=1, floor_one=True, exclude=["pain"]).collect()}
    assert set(floor) == {"fever", "day"} and floor["fever"] == pytest.approx((2 / 5) / (1 / 8))
    freq = {r["term"]: r["n_docs"] for r in keywords.term_document_frequency(df, "text", ["day", "pai", "fever"]).collect()}
    assert freq == {"day": 3, "pai": 0, "fever": 2}
    terms = ["day", "pai", "fever", "no pain", "pain pain fever", "other  day", "fine", "-x", "day."] + [f"t{i}" for i in range(40)]
    many = {r["term"]: r["n_docs"] for r in keywords.term_document_frequency(df, "text", terms).collect()}
    few = {}
    for i in range(0, len(terms), 20):
        few |= {r["term"]: r["n_docs"] for r in keywords.term_document_frequency(df, "text", terms[i : i + 20]).collect()}
    assert many == few and many["no pain"] == 1 and many["pain pain fever"] == 1


CODES = st.lists(st.sampled_from(["F1", "F2", "F3", "F4"]), max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(CODES, CODES), min_size=1, max_size=6))
def test_scores_against_sets(spark, pairs):
    df = spark.createDataFrame([("s", i, a, p) for i, (a, p) in enumerate(pairs)], "strategy string, sample_id int, actual_codes array<string>, predicted_codes array<string>")
    rows = score.scored(df).orderBy("sample_id").collect()
    for (a, p), r in zip(pairs, rows):
        a, p = set(a), set(p)
        assert (r["tp"], r["fp"], r["fn"]) == (len(a & p), len(p - a), len(a - p))
        assert r["f1"] == pytest.approx(1.0 if not a | p else 2 * len(a & p) / (len(a) + len(p)))
        assert r["perfect_match"] == int(a == p)
    codes = {r["f_code"]: r for r in score.per_code(df).collect()}
    for c in {x for a, p in pairs for x in a + p}:
        assert codes[c]["tp"] == sum(c in a and c in p for a, p in pairs) and codes[c]["fp"] == sum(c in p and c not in a for a, p in pairs)
    stream = {r["f_code"]: r for r in scoring.with_scores(scoring.running_code_counts(df)).collect()}
    assert {c: (r["tp"], r["fp"], r["fn"], r["f1"]) for c, r in stream.items()} == {c: (r["tp"], r["fp"], r["fn"], r["f1"]) for c, r in codes.items()}


def test_union_over_chunks(spark):
    df = spark.createDataFrame([(1, ["F2", "F1"]), (1, ["F2"]), (2, [])], "id int, codes array<string>")
    assert {r["id"]: (r["predicted_codes"], r["num_chunks"]) for r in score.union_over_chunks(df, "id").collect()} == {1: (["F1", "F2"], 2), 2: ([], 1)}


def test_small_values(spark):
    assert values(spark, [0.0001, 0.005, 0.03, 0.2], M.stars, "double") == ["***", "**", "*", "ns"]
    freq = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "f_code string, n long")
    covered = rank.coverage(freq).orderBy("rank").collect()
    assert [r["f_code"] for r in covered] == list("abcd") and [r["cum"] for r in covered] == [5, 8, 11, 12]
    s = rank.frequency_summary(freq).first()
    assert (s["mean_n"], s["upper_median"], s["n_singletons"]) == (3.0, 3, 1)
    multi = spark.createDataFrame([(["b", "x"],)], "c array<string>").select(score.multi_hot(F.col("c"), ["a", "b"]).alias("v")).first()[0]
    assert multi == [0, 1]


def test_split_with_a_stratum_too_small_for_two_parts(spark):
    """Three rows of a stratum leave one to val and test: train keeps its strata, the rest is halved without them."""
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(43)], "id int, cat string")
    rows = [(r["id"], r["cat"], r["split"]) for r in cohort.stratified_split(df, "id", "cat").collect()]
    assert sorted(r[0] for r in rows) == list(range(43))
    count = lambda split, cat="ab": sum(1 for r in rows if r[2] == split and r[1] in cat)
    assert (count("train", "a"), count("train", "b"), count("val"), count("test")) == (2, 28, 6, 7)
    assert cohort.stratified_split(df, "id", "cat").columns == ["id", "cat", "split"]


def test_strategies_with_other_samples(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("d", 3)]
    got = score.aligned_strategies(spark.createDataFrame(rows, "strategy string, sample_id int"), "a").collect()
    assert {r["strategy"]: r["aligned"] for r in got} == {"a": True, "b": True, "c": False, "d": False}
    assert not any(r["aligned"] for r in score.aligned_strategies(spark.createDataFrame(rows, "strategy string, sample_id int"), "z").collect())


def test_split_fallback_and_sample(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "id int, cat string")
    counts = {r["split"]: r["count"] for r in cohort.stratified_split(df, "id", "cat").groupBy("split").count().collect()}
    assert counts == {"train": 14, "val": 3, "test": 3}  # a stratum of one row: not stratified
    one = [r["id"] for r in cohort.fixed_sample(df, "id", 7).collect()]
    assert len(one) == 7 and one == [r["id"] for r in cohort.fixed_sample(df.repartition(5), "id", 7).collect()]
    assert cohort.hash_split(df, "id").select("split").distinct().count() <= 3
    assert cohort.stratified_split(df.limit(0), "id", "cat").count() == 0


def test_holm_against_loop(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, 1.0]
    got = {r["i"]: r["p_holm"] for r in resample.holm(spark.createDataFrame(list(enumerate(ps)), "i int, p_raw double"), tie=("i",)).collect()}
    run, want = 0.0, {}
    for k, i in enumerate(sorted(range(len(ps)), key=lambda i: (ps[i], i))):
        run = max(run, (len(ps) - k) * ps[i])
        want[i] = min(1.0, run)
    assert got == pytest.approx(want)


def test_positions_and_draws(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got, n = resample.positions(df, "k")
    assert n == 1000 and sorted(r["pos"] for r in got.collect()) == list(range(1000))
    sums = resample.bootstrap_sums(got.withColumn("one", F.lit(1)), n, ["one"], 5, 1).collect()
    assert [r["one"] for r in sorted(sums, key=lambda r: r["iter"])] == [1000] * 5
    total = [r["one"] for r in resample.poisson_bootstrap_sums(df.withColumn("one", F.lit(1)), "k", ["one"], 40, 1).collect()]
    assert abs(np.mean(total) - 1000) < 30 and 15 < np.std(total) < 60
    assert resample.positions(df.limit(0), "k")[1] == 0


def test_draws_are_the_same_in_numpy(spark):
    i, j = np.array([0, 1, 999, 2**31]), np.array([0, 5, 10**6, 2**33 + 7])
    want = resample.draws(42, i, j)
    pairs = [(a, b, int(i[a]), int(j[b])) for a in range(4) for b in range(4)]
    for r in resample.with_draw(spark.createDataFrame(pairs, "a int, b int, i long, j long"), 42, "i", "j", "x").collect():
        assert r["x"] == int(want[r["a"], r["b"]])
    many = resample.draws(1, np.arange(200), np.arange(500)).astype(np.float64) / 2**32
    assert abs(many.mean() - 0.5) < 0.005 and np.all(np.abs((many >= 0.5).mean(axis=1) - 0.5) < 0.12) and len(np.unique(many)) > 99_900


def test_large_samples_are_joined_with_the_same_sums(spark, monkeypatch):
    df, n = resample.positions(spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), "k")
    once = sorted(resample.bootstrap_sums(df, n, ["v"], 30, 5).collect())
    monkeypatch.setattr(resample, "BROADCAST_BYTES", 0)
    assert once == sorted(resample.bootstrap_sums(df, n, ["v"], 30, 5).collect()) and len(once) == 30


def test_blocks_of_a_large_sample_have_the_same_sums(spark):
    """Several blocks, several parts of an iteration's draws, and values that 53 bits can't sum: exact in all."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 1000), rng.integers(-(2**50), 2**50, 1000)])
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "pos long, a long, b long").repartition(3)
    got = {r["iter"]: (r["a"], r["b"]) for r in resample._block_sums(df, 1000, ["a", "b"], 40, 9, block=64, held=300).collect()}
    for i in range(40):
        at = resample.draws(9, np.array([i]), np.arange(1000))[0].astype(np.int64) * 1000 >> 32
        assert got.pop(i) == tuple(x[at].sum(axis=0).tolist())
    assert not got
    bits = resample.unary(np.array([0, 0, 0, 5, 6, 6]), 8)
    assert len(bits) == 2 and resample.from_unary(bits, 8).tolist() == [3, 0, 0, 0, 0, 1, 2, 0]


def test_a_large_sample_is_never_drawn_as_rows(spark, monkeypatch):
    df, n = resample.positions(spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")), "k")
    monkeypatch.setattr(resample, "BROADCAST_BYTES", 0)
    plan = resample.bootstrap_sums(df, n, ["v"], 30, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "_x" not in plan and "CoGroup" in plan


def test_coins_are_the_highest_bits_of_draws():
    i, j = np.arange(70), np.array([0, 1, 77, 2**31, 2**32 - 1, 2**33 + 7])
    assert (resample.coins(42, i, j) == resample.draws(42, i, j) >> 31).all()


def test_permutations_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (5000, 6))
    names = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    rows = [(i, *map(int, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pos long, " + ", ".join(f"{n} long" for n in names))
    want = {-1: [*x.sum(axis=0)]}
    for it in range(300):
        swap = (resample.draws(7, np.array([it]), np.arange(5000))[0] >> 31 == 1)[:, None]
        own = np.where(swap, x[:, [3, 4, 5, 0, 1, 2]], x)
        want[it] = [*own.sum(axis=0)]
    for parts in (1, 9):
        got = resample.permutation_sums(df.repartition(parts), [("a", "b")], 300, 7).collect()
        assert {r["iter"]: [r[f"{c}_a_b_{k}"] for k in (1, 2) for c in ("tp", "fp", "fn")] for r in got} == want
    assert resample.permutation_sums(df.limit(0), [("a", "b")], 5, 7).count() == 0
    odd = spark.createDataFrame([(0, None, 1, 1, 2, 0, 0)], df.schema)
    assert {r["tp_a_b_1"] + r["tp_a_b_2"] for r in resample.permutation_sums(odd, [("a", "b")], 5, 7).collect()} == {2}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 9001])
def test_numpy_swaps_are_the_stream_in_sequence(spark, n):
    x = np.random.default_rng(n).integers(0, 5, (n, 6))
    names = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "pos long, " + ", ".join(f"{v} long" for v in names)).repartition(3)
    stream, want = np.random.default_rng(42), {-1: [*x.sum(axis=0)]}
    for it in range(60):
        swap = stream.integers(0, 2, n).astype(bool)[:, None]
        want[it] = [*np.where(swap, x[:, [3, 4, 5, 0, 1, 2]], x).sum(axis=0)]
    sums = resample.permutation_sums(df, [("a", "b")], 60, 42, numpy_rows=n)
    assert {r["iter"]: [r[f"{c}_a_b_{k}"] for k in (1, 2) for c in ("tp", "fp", "fn")] for r in sums.collect()} == want
    p = resample.permutation_pvalues(sums, [("a", "b")], 60).first()["p_raw"]
    f = lambda v: 2 * v[0] / max(1, 2 * v[0] + v[1] + v[2])
    null = np.array([f(want[i][:3]) - f(want[i][3:]) for i in range(60)])
    assert p == pytest.approx((np.sum(np.abs(null) >= abs(f(want[-1][:3]) - f(want[-1][3:]))) + 1) / 61)


def test_numpy_draws(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(rng.integers(0, 4, (50, 3)))]
    df = spark.createDataFrame(rows, "strategy string, sample_id int, tp long, fp long, fn long").repartition(3)
    got = sorted((r["iter"], r["value"]) for r in resample.numpy_draws(df, "strategy", "sample_id", resample.micro_f1_bootstrap, 20).collect())
    x, own = np.array([r[2:] for r in rows]), np.random.default_rng(42)
    for _, v in got:
        at = own.integers(0, 50, 50)
        tp, fp, fn = x[at].sum(axis=0)
        assert v == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "bad")], "id int, text string")
    ids = hooks.token_ids(lambda t: [ord(c) for c in t])
    assert {r["id"]: r["x"] for r in df.select("id", ids(F.col("text")).alias("x")).collect()}[1] == [97, 98]

    def load():
        def model(t):
            if t == "bad":
                raise ValueError(t)
            return f"[{t}]"

        return model

    got = {r["id"]: (r["response"], r["success"]) for r in hooks.predict(df, "id", "text", load).collect()}
    assert got == {1: ("[ab]", True), 2: ("[None]", True), 3: (None, False)}


def test_stream(spark, tmp_path):
    schema = "strategy string, actual_codes array<string>, predicted_codes array<string>"
    spark.createDataFrame([("s", ["F1"], ["F1", "F2"]), ("s", ["F2"], [])], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = scoring.running_code_counts(stream).writeStream.outputMode("complete").format("memory").queryName("codes").start()
    q.processAllAvailable()
    q.stop()
    assert {r["f_code"]: (r["tp"], r["fp"], r["fn"]) for r in spark.table("codes").collect()} == {"F1": (1, 0, 0), "F2": (0, 1, 1)}


def test_first_patient_that_is_known(spark):
    """The first row's null patient doesn't hide the next row's."""
    rows = [(1, None, 1, "F10"), (1, 7, 2, "F20"), (1, 8, 3, "F30"), (2, None, 1, "F10")]
    dx = spark.createDataFrame(rows, "hadm_id long, subject_id long, seq_num int, icd_code string")
    got = {r["hadm_id"]: (r["subject_id"], r["f_codes_str"]) for r in cohort.grouped_codes(dx).collect()}
    assert got == {1: (7, "F10, F20, F30"), 2: (None, "F10")}


def test_multinomial_sums(spark):
    import numpy as np

    rows = [(k % 5, -(k % 3), 1) for k in range(3000)] + [(9, 4, 1)] * 1500 + [(k, 2 * k, 1) for k in range(2000)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "a long, b long, one long")
    values = ["a", "b", "one"]
    got = {r["iter"]: (r["a"], r["b"], r["one"]) for r in resample.multinomial_sums(df.repartition(7), values, 1500, 3, parts=8).collect()}
    assert set(got) == set(range(1500)) and {x[2] for x in got.values()} == {len(rows)}
    again = resample.multinomial_sums(df.coalesce(1), values, 1500, 3, parts=8).collect()
    assert got == {r["iter"]: (r["a"], r["b"], r["one"]) for r in again}
    other = resample.multinomial_sums(df, values, 1500, 4, parts=8).collect()
    assert got != {r["iter"]: (r["a"], r["b"], r["one"]) for r in other}
    x = np.array([[0 if v is None else v for v in r[:2]] for r in rows], dtype=float)
    sums = np.array([v[:2] for _, v in sorted(got.items())], dtype=float)
    spread = np.cov(x.T, bias=True) * len(rows)
    assert (np.abs(sums.mean(axis=0) - x.sum(axis=0)) < 5 * np.sqrt(np.diag(spread) / 1500)).all()
    assert np.allclose(np.cov(sums.T) / spread, 1, atol=0.2)


def test_multinomial_counts_are_those_of_plain_draws(spark):
    """Four rows of one draw each: all 4^4 outcomes by their exact probability."""
    from math import factorial

    df = spark.createDataFrame([(1,), (10,), (100,), (1000,)], "v long")
    found = [r["v"] for r in resample.multinomial_sums(df, ["v"], 40000, 11, parts=2).collect()]
    for counts in [(1, 1, 1, 1), (4, 0, 0, 0), (0, 0, 0, 4), (2, 2, 0, 0), (0, 1, 3, 0), (2, 0, 1, 1)]:
        p = factorial(4) / 4**4
        for c in counts:
            p /= factorial(c)
        share = found.count(sum(c * 10**k for k, c in enumerate(counts))) / 40000
        assert abs(share - p) < 5 * (p * (1 - p) / 40000) ** 0.5


def test_multinomial_sums_of_few_rows(spark):
    import pytest

    empty = spark.createDataFrame([], "a long")
    assert resample.multinomial_sums(empty, ["a"], 5, 1).collect() == []
    one = spark.createDataFrame([(7, "x")], "a long, v0 string")
    assert sorted(tuple(r) for r in resample.multinomial_sums(one, ["a"], 3, 1).collect()) == [(0, 7), (1, 7), (2, 7)]
    nulls = spark.createDataFrame([(None,)] * 3, "a long")
    assert {tuple(r) for r in resample.multinomial_sums(nulls, ["a"], 2, 1).collect()} == {(0, 0), (1, 0)}
    with pytest.raises(ValueError):
        resample.multinomial_sums(spark.createDataFrame([(1 << 62,), (1,)], "a long"), ["a"], 2, 1)
