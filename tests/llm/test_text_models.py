"""Language spans, near duplicates and the language model against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import _align, _words, op01_language, op07_order_minhash, op10_hidden_markov

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = "the quick brown fox " * 6000
    rows = [
        (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "12 34 -- ??", "en", "s", 1),
        (900004, long, "en", "s", 1), (900005, long + "x", "en", "s", 1), (None, "Привет мир", "xx", None, 1),
        (900006, "日本語", None, "s", 1), (900007, "a", "fr", "s", 1), (900007, "a", "fr", "s", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_hashes_and_spans():
    texts = ["Ab cd\tef", None, "", "  ", "cd", "é ef"]
    data, at = _words.text_bytes(pa.array(texts))
    s = _words.spans(data, at)
    assert np.diff(s.rows).tolist() == [3, 0, 0, 0, 1, 2]
    h = _words.hashes(data, s.starts, s.ends)
    assert h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 4
    low = _words.hashes(*_words.text_bytes(pa.array(["ab"]))[:1], np.array([0]), np.array([2]))
    assert _words.hashes(data, s.starts, s.ends, lower=True)[0] == low[0]


def test_hash_index():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    index = _words.HashIndex(keys)
    assert (index.find(keys) == np.arange(5000)).all()
    assert (index.find(keys + np.uint64(1)) == -1).all()
    assert (_words.HashIndex(np.zeros(0, np.uint64)).find(keys) == -1).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("quick", [-1, 3, 40])
def test_banded_distance(quick):
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 7)):
            at = int(rng.integers(0, len(b) + 1))
            b = np.concatenate([b[:at], rng.integers(0, 4, rng.integers(0, 3)).astype(np.uint64), b[at + int(rng.integers(0, 3)) :]])
        want = levenshtein(a.tolist(), b.tolist())
        for limit in (0, 2, 5, 30):
            assert _align.edit_distance(a, b, limit, quick) == (want if want <= limit else None)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        rows = np.concatenate([[0], np.cumsum(rng.integers(0, 7, 4))])
        scores = rng.normal(0, 3, (rows[-1], 3))
        got = op01_language.viterbi(scores, rows, 2.0)
        for lo, hi in zip(rows, rows[1:]):
            value = lambda p: sum(scores[lo + i, s] for i, s in enumerate(p)) - 2 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
            best = max((value(p) for p in product(range(3), repeat=hi - lo)), default=0)
            assert value(got[lo:hi]) == pytest.approx(best)


def test_viterbi_over_blocks():
    rng = np.random.default_rng(4)
    scores, rows = rng.normal(0, 2, (1500, 4)), np.array([0, 700, 700, 701, 1500])
    got = op01_language.viterbi(scores, rows, 3.0)
    for lo, hi in zip(rows, rows[1:]):
        best, back = np.zeros(4), []
        for t in range(lo, hi):
            move = best[:, None] - 3 * (1 - np.eye(4))
            back.append(move.argmax(0))
            best = move.max(0) + scores[t]
        path = [int(best.argmax())] if hi > lo else []
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        assert got[lo:hi].tolist() == path[::-1]


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = op01_language.held_out()
    model = op01_language.learn(docs.where(~held), "text", "lang", "doc_id")
    out = op01_language.label_languages(docs.withColumn("score", F.lit(1)).withColumn("held", held), model, ["doc_id", "lang", "held"]).collect()
    own = [r for r in out if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 0.98 * len(own)
    assert all(0 <= r["score"] <= 1 for r in out)
    by = {r["lang"]: r["text"] for r in docs.where(F.col("n_chars").between(800, 1500) & ~F.col("text").contains("|")).orderBy("doc_id").collect()}
    mixed = by["de"] + "\n" + by["es"]
    got = op01_language.label([mixed], model)
    spans_ = [(s, e, model.langs[x]) for s, e, x in zip(got["start"], got["end"], got["lang"])]
    cover = Counter()
    for s, e, x in spans_:
        cut_ = len(by["de"])
        cover["de" if x == "de" else "-", "first"] += max(0, min(e, cut_) - s)
        cover["es" if x == "es" else "-", "second"] += max(0, e - max(s, cut_))
    assert cover["de", "first"] > 0.8 * len(by["de"]) and cover["es", "second"] > 0.8 * len(by["es"])


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    train = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate([("the fox and the dog", "en"), ("привет большой мир", "ru"), ("le renard et le chien", "fr")] * 5)], SCHEMA)
    model = op01_language.learn(train, "text", "lang", "doc_id")
    got = {(r["doc_id"], r["text"]): r for r in op01_language.label_languages(docs, model, ["doc_id", "text"]).collect()}
    assert got[900001, None]["lang_pred"] == got[900002, ""]["lang_pred"] == got[900003, "12 34 -- ??"]["lang_pred"] == "und"
    assert got[None, "Привет мир"]["lang_pred"] == "ru" and got[900006, "日本語"]["lang_pred"] in model.langs
    assert got[900001, None]["score"] == 0 and got[900001, None]["spans"] == []
    none = op01_language.learn(spark.createDataFrame([], SCHEMA), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in op01_language.label_languages(docs, none, ["doc_id"]).collect()} == {"und"}
    assert op01_language.label_languages(spark.createDataFrame([], SCHEMA), model, ["doc_id"]).count() == 0


def near_words(text):
    return re.findall(r"[^\W_]+", text.lower()) if text else []


def kmers(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    seen, out = Counter(), set()
    for g in grams:
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def brute_classes(rows):
    """Connected components of equal texts and of pairs that fulfil the definition, from an index of all k-mers."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    texts = {}
    for i, (_, t) in enumerate(rows):
        if t is not None:
            parent[top(i)] = top(texts.setdefault(t, i))
    words = {i: near_words(rows[i][1]) for i in texts.values()}
    sets, index = {i: kmers(w) for i, w in words.items()}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    shared = Counter()
    for own in index.values():
        shared.update(combinations(own, 2))
    links = 0
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and levenshtein(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])):
            parent[top(i)] = top(j)
            links += 1
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    return groups, links


def test_near_duplicates_against_all_pairs(spark):
    """Copies with few to many edits, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(7)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in given.collect())
    for doc_id, text in [r for r in rows if 40 < len(r[1].split()) < 160][:120]:
        for copy in range(4):
            w = text.split()
            for _ in range(copy * len(w) // 60 + copy):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(0, 99)}"] * int(rng.integers(0, 2))
            rows.append((100_000 + doc_id * 10 + copy, " ".join(w) + "." * copy))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups, links = brute_classes(rows)
    want = {rows[i][0]: min(rows[j][0] for j in g) for g in groups.values() for i in g}
    got = op07_order_minhash.near_duplicates(docs.withColumn("kept", F.lit(1))).collect()
    assert links > 200 and len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    got = op07_order_minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    classes = defaultdict(list)
    for r in got:
        if r["doc_id"] is not None:
            classes[r["class_id"]].append(r["doc_id"])
    assert sorted(classes[900004]) == [900004, 900005] and classes[900007] == [900007, 900007]
    assert sum(r["kept"] for r in got if r["doc_id"] == 900007) == 1
    assert sum(r["kept"] for r in got) == len(got) - 2
    assert op07_order_minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.integers(0, 300, 2):
            w[at] = f"z{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{x}" for x in rng.integers(0, 10**6, 300)]), "en", "s", 1) for i in range(200)]
    got = op07_order_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 1000} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


def test_classes_after_more_links(spark):
    """Classes of links that come in rounds are those of all links at once."""
    rng = np.random.default_rng(21)
    for _ in range(3):
        rounds = [[(bytes([a]), bytes([b])) for a, b in rng.integers(0, 40, (12, 2)) if a != b] for _ in range(3)]
        frames = [spark.createDataFrame(r, "a binary, b binary") for r in rounds]
        labels = op07_order_minhash.components(frames[0])
        for f in frames[1:]:
            labels = op07_order_minhash.joined_classes(labels, f)
        every = op07_order_minhash.components(frames[0].unionByName(frames[1]).unionByName(frames[2]))
        both = [{bytes(r["node"]): bytes(r["label"]) for r in x.collect()} for x in (labels, every)]
        assert both[0] == both[1]
        parent = list(range(40))
        for a, b in [x for r in rounds for x in r]:
            a, b = parent[a[0]], parent[b[0]]
            parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert {k[0]: v[0] for k, v in both[0].items()} == {k: parent[k] for k in range(40) if bytes([k]) in both[0]}


def brute_forward(symbols, model):
    a = model.start * model.emit[symbols[0]]
    for s in symbols[1:]:
        a = (a @ model.move) * model.emit[s]
    return math.log(a.sum())


def test_forward_and_counts():
    rng = np.random.default_rng(6)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = op10_hidden_markov.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    rows = np.array([0, 4, 5, 12])
    symbols = rng.integers(0, 7, 12)
    got = op10_hidden_markov.forward(symbols, rows, model)
    assert got == pytest.approx([brute_forward(symbols[a:b], model) for a, b in zip(rows, rows[1:])])
    start, move, emit, total = op10_hidden_markov.expected(symbols, rows, model)
    assert total == pytest.approx(got.sum())
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))]
    for a, b in zip(rows, rows[1:]):
        seq, all_ = symbols[a:b], math.exp(brute_forward(symbols[a:b], model))
        for path in product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            want[0][path[0]] += p / all_
            for t, s in enumerate(path):
                want[2][seq[t], s] += p / all_
                if t:
                    want[1][path[t - 1], s] += p / all_
    for x, y in zip((start, move, emit), want):
        assert x == pytest.approx(y)
    better = op10_hidden_markov.Model(start / start.sum(), norm(move, 1), norm(emit, 0))
    assert op10_hidden_markov.forward(symbols, rows, better).sum() > total


def test_segments_change_nothing():
    rng = np.random.default_rng(16)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = op10_hidden_markov.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    rows = np.array([0, 40, 41, 47, 60, 63, 300])
    symbols = rng.integers(0, 7, 300)
    assert op10_hidden_markov.pieces(np.array([0, 5, 7]), 2)[0].tolist() == [0, 2, 4, 5, 7]
    whole = op10_hidden_markov.expected(symbols, rows, model, 1000)
    assert op10_hidden_markov.forward(symbols, rows, model, 1000) == pytest.approx([brute_forward(symbols[a:b], model) for a, b in zip(rows, rows[1:])])
    for most in (1, 2, 3, 6, 40, 100):
        assert op10_hidden_markov.forward(symbols, rows, model, most) == pytest.approx(op10_hidden_markov.forward(symbols, rows, model, 1000))
        for x, y in zip(op10_hidden_markov.expected(symbols, rows, model, most), whole):
            assert x == pytest.approx(y)


def lm_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.mark.parametrize("frequent", [1 << 18, 50])
def test_base_scores(spark, frequent, monkeypatch):
    monkeypatch.setattr(op10_hidden_markov, "FREQUENT", frequent)
    monkeypatch.setattr(op10_hidden_markov, "SYMBOLS", 40)
    docs = odd_docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = docs.collect()
    held = op10_hidden_markov.held_out()
    out = op10_hidden_markov.hmm_scores(docs.withColumn("score", F.lit(1)).withColumn("h", held), ~held, ["doc_id", "text", "h"], states=3, passes=1).collect()
    count = Counter()
    for r in rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            count.update([*lm_words(r["text"]), None])
    total, distinct = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        own = [*lm_words(r["text"]), None]
        assert r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own))
        assert r["score"] < 0
    own = [r for r in out if r["h"] and r["n_tokens"] > 30]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_model_is_a_distribution(spark):
    """Over all one-word texts the probabilities of what the model can say next sum to one."""
    docs = spark.createDataFrame([(i, f"a b{i % 5} c{i % 3} a", "en", "s", 1) for i in range(60)], SCHEMA)
    counts = op10_hidden_markov.token_counts(docs)
    words = op10_hidden_markov.vocabulary(counts)
    rows = op10_hidden_markov.symbol_rows(docs, F.lit(True), words, ["doc_id"], "text")
    model = op10_hidden_markov.train(rows, words, 2, 1, 1)
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1)
    assert words.total == 60 * 5 and words.distinct == 10


def test_least_frequent(spark):
    rng = np.random.default_rng(2)
    n = sorted(np.exp(rng.uniform(0, 14, 3000)).astype(int).tolist(), reverse=True)
    counts = spark.createDataFrame([(x,) for x in n], "n long")
    for room in (0, 1, 50, 2000, 3000, 9999):
        least = op10_hidden_markov.least_frequent(counts, room)
        assert sum(x >= least for x in n) <= room and (least == 1 or sum(x >= least - 1 for x in n) > room)
    assert op10_hidden_markov.least_frequent(counts.limit(0), 5) == 1


def test_empty_corpus(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op10_hidden_markov.hmm_scores(none, F.lit(True), ["doc_id"]).count() == 0
    docs = odd_docs(spark)
    out = op10_hidden_markov.hmm_scores(docs, F.lit(False), ["doc_id"]).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in out) and len(out) == 10


def test_chain_of_near_copies_is_one_class(spark):
    """Texts with one other word each: those with it at neighbouring places are near, the others only share buckets."""
    base = [f"w{i}" for i in range(60)]
    rows = [(100 * p + c, " ".join([*base[:p], f"x{p}y{c}", *base[p + 1 :]])) for p in range(5, 25) for c in range(3)]
    got = op07_order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()
    assert {r["class_id"] for r in got} == {500}
    assert [r["doc_id"] for r in got if r["kept"]] == [500]
