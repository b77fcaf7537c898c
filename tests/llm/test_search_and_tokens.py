"""Byte-level BPE, collocations and ranked search against the library, brute force and DuckDB's SQL."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import _words, op11_byte_bpe, op12_collocations, op13_lexical_search, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def raw():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(raw):
    return op11_byte_bpe.Vocabulary(raw, op11_byte_bpe.classes_of_code_points())


def same_as_library(vocabulary, library, texts):
    ids, ends, first = vocabulary.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        assert ids[own].tolist() == library.encode_ordinary(text or ""), text
        assert vocabulary.decode(ids[own]).tobytes() == (text or "").encode()
        assert np.diff(ends[own], prepend=0).tolist() == vocabulary.sizes[ids[own]].tolist()


SIGNS = [*"''sstrevldmaB12!#", " ", " ", " ", "\n", "\t", "\r", "²", "é", "ß", "漢", "字", " ", "　", "😀", "\x1c", "\x85", "Ᲊ", "٣", "́", "\x00"]


def test_tokens_of_random_texts(vocabulary, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(50))) for _ in range(6000)]
    same_as_library(vocabulary, library, [*texts, None, "", " ", "'", "'s", " 's", "x'll'll'l"])


def test_tokens_of_long_runs(vocabulary, library):
    same_as_library(vocabulary, library, [" " * 3000, "a" * 5000, "ab" * 300 + "'ll  " * 100, "\n" * 999 + "x", "漢字" * 700, "-=" * 2000, "x " * 20000])


def test_every_class_of_code_point(vocabulary, library):
    rng = random.Random(6)
    texts = [chr(a) + chr(rng.randrange(0x20, 0x3000)) + x for a in range(0, 0x110000, 23) if not 0xD800 <= a < 0xE000 for x in " '"]
    same_as_library(vocabulary, library, texts)


@pytest.mark.parametrize("block", [2, 3, 7, 64])
def test_boundaries_for_any_block(vocabulary, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(400)]
    data, offsets = op11_byte_bpe.text_bytes(pa.array(texts, pa.string()))
    got = op11_byte_bpe.boundaries(data, offsets, vocabulary.classes, block)
    assert got.tolist() == op11_byte_bpe.boundaries(data, offsets, vocabulary.classes).tolist()


def test_composition_is_associative():
    product = op11_byte_bpe.scan_tables().product
    n = len(product)
    assert all(product[product[a, b], c] == product[a, product[b, c]] for a in range(n) for b in range(n) for c in range(n))


def test_merges_with_odd_ranks():
    """Tokens that no merge makes, equal pairs, and pieces over the bound of the matrix, against the library."""
    rng = random.Random(9)
    made = list(dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))).encode() for _ in range(150)))
    order = [bytes([i]) for i in range(256)]
    rng.shuffle(order)
    tokens = order + made
    raw = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    own = op11_byte_bpe.Vocabulary(raw, op11_byte_bpe.classes_of_code_points())
    other = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    same_as_library(own, other, ["".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 8, 20, 60, 64, 65, 200]))) for _ in range(800)])


def test_cache_begins_anew(raw, library, monkeypatch):
    monkeypatch.setattr(op11_byte_bpe, "CACHED", 50)
    own = op11_byte_bpe.Vocabulary(raw, op11_byte_bpe.classes_of_code_points())
    rng = random.Random(3)
    for _ in range(6):
        same_as_library(own, library, [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(60)) for _ in range(9)])


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        op11_byte_bpe.Vocabulary(b"YQ== 0\nYg== 2", np.zeros(0x110000, np.uint8))


def test_bpe_query_and_round_trip(spark, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(rows[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_cache_is_bounded_in_bytes(vocabulary, monkeypatch):
    monkeypatch.setattr(op11_byte_bpe, "CACHED_BYTES", 1000)
    texts = ["".join(chr(97 + (i + k) % 26) for k in range(900)) for i in range(5)]
    for t in texts:
        want = vocabulary.merge_long(t.encode())
        assert (vocabulary.encode(pa.array([t]))[0] == want).all() and sum(map(len, vocabulary.slots)) <= 1900
    vocabulary.forget()


def test_decoding_takes_no_vocabulary_and_few_tokens_at_once(raw):
    own = op11_byte_bpe.TokenBytes(list(op11_byte_bpe._ranks_of(raw)))
    assert own.decode(np.array([0, len(own.sizes) - 1])).tobytes() and not hasattr(own, "pairs")
    lists = pa.array([[1, 2], [], [3], [4, 5, 6, 7], [], [8]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists], ["ids"]).slice(1)
    parts = list(op11_byte_bpe._list_slices(iter([batch]), 0, 2))
    assert [x for p in parts for x in p.column(0).to_pylist()] == lists.to_pylist()[1:] and [p.num_rows for p in parts] == [2, 1, 2]


def test_bpe_of_odd_rows(spark):
    bpe = op11_byte_bpe.ByteBpe(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "don't stop", "en", "s", 1), (3, "don't stop", "en", "s", 1), (None, "é" * 50_000, None, None, 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("ends", F.lit(1))
    enc = bpe.encode(docs, ["doc_id", "text"])
    got = bpe.decode(enc, ["doc_id", "text"]).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    cut = enc.where("doc_id = 3").select(op11_byte_bpe.token_text(F.col("text"), F.col("ends"), F.lit(1), F.lit(2)).alias("t")).first()
    assert bytes(cut["t"]).decode() == "'t stop"
    assert bpe.encode(docs.limit(0), ["doc_id"]).count() == 0


def test_bpe_digests_take_one_python_process_a_task(spark, monkeypatch):
    monkeypatch.setattr(op11_byte_bpe, "ENCODED_BYTES", 8)
    bpe = op11_byte_bpe.ByteBpe(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    rows = [(1, None), (2, ""), (3, "don't stop"), (3, "don't stop"), (None, "é" * 5_000), (4, "漢 \n x")]
    enc = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], decoded=True)
    got = Counter((r["doc_id"], bytes(r["decoded"])) for r in enc.collect())
    assert got == Counter((k, (t or "").encode()) for k, t in rows)
    assert got == Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(enc.drop("decoded"), ["doc_id"]).collect())
    plan = queries.QUERIES["op11_byte_bpe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


# ---- collocations


def brute_collocations(rows, least, top, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    out = defaultdict(list)
    for (lang, *words), a in candidates.items():
        held = any(
            lang == other and len(longer) > len(words) and b >= a and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, *longer), b in candidates.items()
        )
        if not held:
            cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]], n[lang]))
    return {
        (lang, i, p.decode(), -a, x, y, m, -s) for lang, found in out.items() for i, (s, a, p, x, y, m) in enumerate(sorted(found)[:top], 1)
    }


def odd_texts():
    rng = random.Random(4)
    words = ["the", "The", "cat", "sat", "on", "a", "mat", "new", "york", "é", "漢", "en", "es", "\x1c", "x-y", " ", "😀"]
    joins = [" ", " ", " ", " ", "\t", "  ", ", ", "\n", ".", " \x0b "]
    rows = [("".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "es", None])) for _ in range(300)]
    rows += [("new york city hall tonight", "en")] * 9 + [(None, "en"), ("", None), ("a a a a a a a a", "es"), ("new york " * 2_000, "xx")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard": 40}, {"most_bits": 12, "shard": 60}])
def test_collocations_against_brute_force(spark, settings, monkeypatch):
    if "most_bits" in settings:
        monkeypatch.setattr(op12_collocations, "LEAST_BITS", 4)
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate(rows)], SCHEMA).withColumn("phrase", F.lit(1)).withColumn("f", F.lit(2))
    got = op12_collocations.collocations(docs.repartition(3), min_count=8, top=25, **settings)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 8, 25)


def test_bounds_are_never_too_low(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    texts = op12_collocations.slim_texts(docs, "lang", "text")
    counts = op12_collocations.word_counts(texts)
    known = op12_collocations.Filter(op12_collocations.frequent_words(counts, 8), {})
    for bits in (6, 10, 20):  # overfull sketches let more through, never less
        known.runs[2] = op12_collocations.sketched(texts, known, range(2, 3), bits, 8)
        found = {(r["lang"], r["phrase"]) for r in op12_collocations.candidate_phrases(texts, known, 2, bits).collect()}
        f = Counter()
        for text, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").replace("T", "t")):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update((lang or "und", f"{x} {y}") for x, y in zip(w, w[1:]))
        assert {k for k, v in f.items() if v >= 8} <= found
    assert len(found) < len(f)


@pytest.mark.parametrize("slices", [1, 3])
def test_candidates_ask_each_sketch_once(slices, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d.", "e"]) for _ in range(rng.randrange(30))) for _ in range(20)]
    w = op12_collocations.words_of(pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array(texts)], names=["_lang", "_text"]))
    bits = lambda k: op12_collocations.Bits(8, [np.random.default_rng(k + r).integers(0, 256, 32, np.uint8) | 0x5A for r in (0, 1)])
    known = op12_collocations.Filter(bits(0), {k: bits(k) for k in range(2, 6)}, slices, slices - 1)
    piece = np.searchsorted(w.pieces, np.arange(len(w)), "right")
    own, ok, key = known.own(w.keys), known.words.may(w.keys), {}
    for k in range(2, 6):
        found, first = _words.windows(w.keys, w.pieces, k)
        key[k] = dict(zip(first.tolist(), _words.mix(found + np.uint64(k)), strict=True))
    may = lambda k, i: bool(known.runs[k].may(np.array([key[k][i]], np.uint64))[0])
    inner = lambda k, i: all(not own[i + j] or may(n, i + j) for n in range(2, k) for j in range(k - n + 1))
    want = {k: [i for i in range(len(w) - k + 1) if own[i] and piece[i] == piece[i + k - 1] and ok[i : i + k].all() and inner(k, i)] for k in range(2, 6)}
    asked = []
    real = op12_collocations.Bits.may
    monkeypatch.setattr(op12_collocations.Bits, "may", lambda self, keys: asked.append(self) or real(self, keys))
    got = {k: (at.tolist(), keys.tolist()) for k, keys, at in known.candidates(w, range(2, 6))}
    assert got == {k: (v, [int(key[k][i]) for i in v]) for k, v in want.items()} and want[3]
    assert asked == [known.words, *(known.runs[k] for k in (2, 3, 4))]


def test_automaton_keeps_to_pieces_and_words():
    batch = lambda *t: pa.RecordBatch.from_arrays([pa.array(["en"] * len(t)), pa.array(t)], names=["_lang", "_text"])
    machine = op12_collocations.Automaton(["en", "en", "de"], ["a b", "b a b", "a b"])
    words = op12_collocations.words_of(batch("a b a b, a\nb ab b a b", "b", "A  B"))
    assert machine.counts(words).tolist() == [4, 2, 0]


@pytest.mark.parametrize("name", ["op12_phrases", "op13_ranked_search"])
def test_query_against_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_small_shards_take_no_more_passes_over_the_texts(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate(rows)], SCHEMA).withColumn("text", F.udf(seen)("text"))
    passes, found = [], []
    for shard in (op12_collocations.SHARD, 5):
        before = read.value
        _, counted = op12_collocations.frequent_phrases(docs, 8, 5, "lang", "text", 28, shard)
        found.append({tuple(r) for r in counted.collect()})
        passes.append(read.value - before)
    assert passes[0] == passes[1] > 0 and found[0] == found[1]


def test_automaton_counts_what_a_piece_begins_with():
    batch = lambda *t: pa.RecordBatch.from_arrays([pa.array(["en"] * len(t)), pa.array(t)], names=["_lang", "_text"])
    machine = op12_collocations.Automaton(["en", "en", "de"], ["a b", "a b a b", "a b"])
    words = op12_collocations.words_of(batch("a \tb a b", "b a b", "x a b", "a b x a b"))
    assert machine.first_counts(words, np.array([3, 5, 7, 11])).tolist() == [14, 3, 0]


def test_collocations_of_no_rows(spark):
    assert op12_collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- ranked search


def brute_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in counted if c]
    n, every = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // every
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("settings", [{}, {"block": 12}, {"area": 5}])
def test_search_against_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(op13_lexical_search, "AREA", settings.pop("area", 1_000_000))
    rng = random.Random(8)
    words = ["Alpha", "alpha", "beta", "Gamma", "éa", "漢字", "x1", "no_t", "long-er", "zz"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    docs += [(500 + i, "beta beta gamma") for i in range(9)] + [(7, docs[7][1]), (None, "beta gamma"), (601, None), (602, ""), (603, "..."), (604, "alpha " * 50_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(25)] + [(90, None), (91, ""), (92, "unseen"), (93, "beta beta")]
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA).withColumn("score", F.lit("x")).withColumn("terms", F.lit(1))
    got = op13_lexical_search.search(frame.repartition(3), spark.createDataFrame(items, "item_id long, text string"), top=6, **settings)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 6)


def test_search_of_no_rows(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op13_lexical_search.search(none, items).count() == 0
    assert op13_lexical_search.search(none, items.limit(0)).count() == 0


def test_radix_order_and_sums():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**44, 5000, dtype=np.uint64)
    keys[::3] = keys[0]
    assert (keys[op13_lexical_search.radix_order(keys)] == np.sort(keys)).all()
    item, doc, impact = rng.integers(0, 40, 9000), rng.integers(0, 70_000, 9000) % 90, rng.integers(0, 99, 9000)
    want = Counter()
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
        want[i, d] += x
    got = op13_lexical_search.accumulated(item, doc, impact)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


def test_norms_beyond_64_bits():
    n = np.array([3, 10**9])
    assert op13_lexical_search.length_norm(n, 10**10, 10**13).tolist() == [50 + 50 * x * 10**10 // 10**13 for x in n.tolist()]
