"""Decontamination, line templates, license spans and co-training against brute force."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import _align, op02_cgk, op04_log_templates, op08_license_scan, op09_co_training

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def odd_rows():
    return [
        (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, " \n\n ", "en", "s", 1),
        (900004, "word " * 50_000, "en", "s", 1), (None, "a b", "xx", None, 1), (900007, "a\nb", "fr", "s", 1), (900007, "a\nb", "fr", "s", 1),
    ]


def fitting(item, text):
    """Least edits of the item to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
        w[at : at + (kind != 2)] = [] if kind == 1 else [f"q{rng.integers(0, 10**6)}"]
    return w


def test_fitting_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(0, 3, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 3, rng.integers(1, 15)).astype(np.uint64)
        d, a, b = op02_cgk.fitting_distance(item, text, 99)
        assert d == fitting(item.tolist(), text.tolist())
        assert _align.edit_distance(item, text[a:b], 99) == d


def test_embedding_keeps_equal_and_near_windows_close():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = words[:50].copy()
    near[20] = 7
    flat = np.concatenate([words, near])
    image = op02_cgk.embed(flat, np.array([0, 400, 200]), np.array([50, 50, 50]), 0)
    differ = [(image[0] != image[i]).mean() for i in (1, 2)]
    assert differ[0] < 0.3 < differ[1]


def test_decontamination(spark):
    """Planted items with 0 to the most allowed edits are found; the rest is what brute force says."""
    rng = np.random.default_rng(9)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r["item_id"]: words_of(r["text"]) for r in bench.collect()}
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows, planted = [], Counter()
    for k, (item, own) in enumerate(list(items.items()) * 4):
        host = words_of(texts[k % 60])[:150]
        edits = op02_cgk.allowed_edits(len(own)) * (k // len(items)) // 3
        rows.append((k, " ".join([*host[:70], *edited(own, edits, rng), *host[70:]]), "en", "s", 1))
        planted[k] = (item, edits)
    rows += [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + odd_rows(), SCHEMA)
    got = op02_cgk.contaminated(docs.withColumn("item_id", F.lit(1)), bench).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["doc_id"]][r["item_id"]] = r
    missed = [k for k, (item, _) in planted.items() if item not in by.get(k, ())]
    assert len(missed) <= 0.05 * len(planted) / 4 + 2 and not [k for k in missed if planted[k][1] == 0]
    text = {r[0]: r[1] for r in rows}
    for r in got:
        own = items[r["item_id"]]
        assert r["edits"] <= op02_cgk.allowed_edits(len(own))
        assert r["edits"] == fitting(own, words_of(text[r["doc_id"]]))
    for i in range(60):  # what exact search finds in the given texts is found
        for item, own in items.items():
            if f" {' '.join(own)} " in f" {' '.join(words_of(texts[i]))} ":
                assert item in by.get(1000 + i, ())
    left = op02_cgk.without_items(docs, bench).collect()
    assert Counter(r["doc_id"] for r in left) == Counter(r[0] for r in rows + odd_rows() if r[0] not in by)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    assert op02_cgk.contaminated(none, bench).count() == 0
    short = spark.createDataFrame([(1, "zz b"), (2, None), (None, ""), (3, "..")], "item_id long, text string")
    assert op02_cgk.contaminated(docs, short).count() == 0
    assert op02_cgk.without_items(docs, short.limit(0)).count() == len(odd_rows())


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op02_cgk, "BLOCK_WORDS", 300)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r["text"] for r in bench.orderBy("item_id").collect()]
    docs = spark.createDataFrame([(i, f"x y z {t} u v", "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in op02_cgk.contaminated(docs, bench).collect()}
    assert {(i, i) for i in range(len(texts))} <= got


def fits(item, text):
    """As fitting, a row of numbers at a time."""
    text, ramp = np.array(text, object), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        best = np.concatenate([[i], np.minimum(row[:-1] + (text != x), row[1:] + 1)])
        row = np.minimum.accumulate(best - ramp) + ramp
    return int(row.min())


def test_decontamination_against_all_windows(spark):
    """Every item against every text, also with items of one to four words, string ids and items with a common stem."""
    rng = np.random.default_rng(17)
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(40).collect()]
    items = {f"i{r['item_id']}": words_of(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").limit(20).collect()}
    stem = [f"stem{i}" for i in range(6)]
    items |= {f"s{i}": [*stem, *(f"t{x}" for x in rng.integers(0, 10**6, 4 + i))] for i in range(15)}
    items |= {"one": ["qzone"], "two": ["qztwo", "words"], "four": ["qzfour", "words", "in", "all"], "same": ["qzone"]}
    texts = []
    for k, t in enumerate(given):
        w = words_of(t)[:250]
        for item in list(items)[k % 13 :: 13]:
            own = items[item]
            n = op02_cgk.allowed_edits(len(own)) if len(own) >= 5 else 0
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = edited(own, int(rng.integers(0, n + 2)), rng) if len(own) > 4 or rng.integers(0, 2) else own[:-1] + ["no"]
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in op02_cgk.contaminated(docs, bench).orderBy(F.desc("edits")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for item, own in items.items():
            n = fits(own, words_of(t))
            if n <= (op02_cgk.allowed_edits(len(own)) if len(own) >= 5 else 0):
                want[d, item] = n
    assert not set(got) - set(want) and all(got[k] == want[k] for k in got)
    missed = [k for k in want if k not in got]
    assert len(want) > 60 and len(missed) <= 0.05 * len(want) and all(want[k] for k in missed)


def test_many_short_items_and_a_long_one_within_a_gigabyte():
    """100,000 items of 8 words that share a stem, one of 20,000 words, and a text that holds some of them."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
import pyarrow as pa
from tessella.llm import op02_cgk
rng = np.random.default_rng(1)
texts = [f"what is the {x} of {y} {z}" for x, y, z in rng.integers(0, 10**6, (100_000, 3)).tolist()]
long = " ".join(f"l{x}" for x in rng.integers(0, 10**6, 20_000))
words, rows = op02_cgk.words_of(pa.array([*texts, long]))
items = op02_cgk.Items(words, rows[:-1], np.diff(rows), [[i] for i in range(len(texts) + 1)], 0.2, 0.95)
text = " and ".join([*texts[:20], long.replace(" l1", " z1"), *texts[20:30]])
w, at = op02_cgk.words_of(pa.array([text]))
found = {x for _, x, _, _, _ in op02_cgk.matches(w, at, items, op02_cgk.Lookup(items))}
assert found >= {*range(30), 100_000}, len(found)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1e6, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr[-2000:]


def masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))


def brute_templates(lines, similarity):
    """Template of each masked line of a leaf: halves by the bits of the line's hash, merged from single lines upwards."""

    def node(own, bit):
        if not own:
            return []
        if len(own) == 1:
            return [(list(own[0][1]), [own[0][1]])]
        here, there = ([x for x in own if (x[0] ^ 1 << 63) >> bit & 1 == v] for v in (0, 1))
        one, other = node(here, bit - 1), node(there, bit - 1)
        scores = [[sum(0.5 if "<*>" in (a, b) else float(a == b) for a, b in zip(s, t)) for s, _ in one] for t, _ in other]
        alone = []
        for (t, mine), score in zip(other, scores):
            best = max(score, default=-1)
            if best >= similarity * len(t):
                s, own_lines = one[score.index(best)]
                s[:] = [a if a == b else "<*>" for a, b in zip(s, t)]
                own_lines += mine
            else:
                alone.append((t, mine))
        return one + alone

    return node([(k & (2**64 - 1), m) for k, m in lines], 63)


def brute_dropped(rows, min_docs, similarity):
    texts = pa.array([t for _, t in rows], pa.string())
    p = op04_log_templates.parse(texts)
    seen = defaultdict(set)
    line_of = {}
    for r, n, key in zip(p["row"], p["number"], p["line"].view(np.int64).tolist()):
        line = (rows[r][1] or "").split("\n")[n]
        seen[masked(line)].add(int(r))
        line_of[masked(line)] = key
    leaves = defaultdict(list)
    for m in seen:
        leaves[len(m), m[:3]].append((line_of[m], m))
    gone = set()
    for lines in leaves.values():
        for t, own in brute_templates(lines, similarity):
            docs = set().union(*(seen[m] for m in own))
            if len(docs) >= min_docs or len(t) >= op04_log_templates.LONG_TOKENS and len({rows[r][1] for r in docs}) >= 2:
                gone.update(own)
    return gone


def line_docs(spark):
    rng = np.random.default_rng(12)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(250).collect()
    rows = [(r["doc_id"], r["text"]) for r in given]
    for i in range(60):
        who = f"user{rng.integers(0, 999)}"
        name = f"n{'abcdefgh'[i % 8]}x"
        rows.append((5000 + i, f"Own line of {' '.join(''.join(rng.choice(list('abcdefgh'), 6)) for _ in range(9))}\nPosted by {who} on 2024-01-{i % 28 + 1:02d} at the forum\nRead more news about {name} on our page today"))
    return rows + [(r[0], r[1]) for r in odd_rows()]


def test_line_templates(spark, monkeypatch):
    rows = line_docs(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(1)).withColumn("leaf", F.lit("x"))
    gone = brute_dropped(rows, op04_log_templates.MIN_DOCS, op04_log_templates.SIMILARITY)
    want = Counter()
    for doc_id, text in rows:
        if text is None:
            want[doc_id, None, 0, 0] += 1
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not WORD.search(x) or masked(x) not in gone]
        want[doc_id, "\n".join(kept), sum(bool(WORD.search(x)) for x in lines), len(lines) - len(kept)] += 1
    for leaf_rows, parts in ((20_000, 4), (5, 37), (1, 3)):
        monkeypatch.setattr(op04_log_templates, "LEAF_ROWS", leaf_rows)
        got = op04_log_templates.dedup_lines(docs.repartition(parts)).collect()
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == want, leaf_rows
    text = {r["doc_id"]: r["text"] for r in got}
    assert all("Posted by" not in text[5000 + i] and "Read more" not in text[5000 + i] and "Own line" in text[5000 + i] for i in range(60))


def test_large_leaf_by_parts(spark, monkeypatch):
    """One leaf of many lines: parts merged level by level give what one place gives."""
    rng = np.random.default_rng(31)
    rows = [(i, "the one leaf " + " ".join(f"w{'abc'[x]}{'xyz'[x]}" for x in rng.integers(0, 3, 8))) for i in range(500)]
    gone = brute_dropped(rows, 3, 0.75)
    assert 0 < len(gone) < len({masked(t) for _, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for leaf_rows, size in ((20_000, before), (20_000, "500"), (2, before)):  # parts over several batches; eight bits, two levels of parts
        monkeypatch.setattr(op04_log_templates, "LEAF_ROWS", leaf_rows)
        spark.conf.set(name, size)
        got = {r["doc_id"]: r["n_dropped"] for r in op04_log_templates.dedup_lines(docs.repartition(5)).collect()}
        spark.conf.set(name, before)
        assert got == {i: int(masked(t) in gone) for i, t in rows}, (leaf_rows, size)


def test_index_of_templates_gives_what_comparing_all_gives(monkeypatch):
    rng = np.random.default_rng(5)
    wild = op04_log_templates.WILD_TOKEN
    indexed = joined = 0
    for _ in range(300):
        size, kinds = int(rng.integers(1, 26)), int(rng.choice([2, 8, 50]))
        one, other = (rng.integers(0, kinds, (int(rng.integers(1, 120)), size)).astype(np.int32) for _ in range(2))
        for j in np.flatnonzero(rng.random(len(other)) < 0.7):
            other[j] = one[rng.integers(len(one))]
            other[j, rng.integers(0, size, rng.integers(0, size // 3 + 1))] = rng.integers(0, kinds)
        share = rng.choice([0, 0.01, 0.1])
        for side in (one, other):
            side[:, :3] = 7
            side[rng.random(side.shape) < share] = wild
        if rng.random() < 0.2:  # a leaf with a variable field ahead
            one[:, 0] = other[:, 0] = wild
        need = 0.75 * size
        monkeypatch.setattr(op04_log_templates, "FEW_CELLS", 1 << 40)
        best, enough = op04_log_templates.nearest(one, other, need)
        monkeypatch.setattr(op04_log_templates, "FEW_CELLS", -1)
        monkeypatch.setattr(op04_log_templates, "CELLS", int(rng.choice([10, 1 << 20])))
        found, some = op04_log_templates.nearest(one, other, need)
        assert (enough == some).all() and (best[enough] == found[enough]).all()
        indexed += op04_log_templates._sharing(one, other, need) is not None
        joined += int(enough.sum())
    assert indexed > 50 and joined > 1000


def test_diverse_leaf_in_bounded_memory():
    """A leaf of lines that don't merge: no matrix of all templates."""
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 30_000, (40_000, 12)).astype(np.int32)
    tokens[:, :3] = 5
    ids = np.sort(rng.integers(-(2**63), 2**63 - 1, len(tokens)))
    tracemalloc.start()
    into, _ = op04_log_templates.grown(ids, tokens, 64, 0.75)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (into == np.arange(len(tokens))).all() and peak < 100 << 20


def test_long_lines_recur_from_two_texts_on(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"{long}\nfirst text"), (2, f"second text\n{long}"), (3, "copy " + long.replace("worda", "other")), (4, "copy " + long.replace("worda", "other"))]
    got = {r["doc_id"]: r["text"] for r in op04_log_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "first text", 2: "second text", 3: rows[2][1], 4: rows[3][1]}


def test_no_lines(spark):
    assert op04_log_templates.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_spans(spark):
    rng = np.random.default_rng(4)
    t = op08_license_scan.TEMPLATES
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows, want = [], {}
    for i, name in enumerate(sorted(t) * 3):
        notice = t[name]
        if i >= 2 * len(t) and len(notice.split()) > 20:  # a long notice with some words changed
            notice = " ".join("zzz" if k % 12 == 5 else w for k, w in enumerate(notice.split()))
        before = "Ünï " + filler(i % 7 * 10)
        rows.append((i, f"{before}\n{notice.upper() if i % 3 == 1 else notice} {filler(15)}", "en", "s", 1))
        want[i] = (name, len(before) + 1)
    clean = [(1000 + i, "you may use the license of the work " + filler(60) + " this is the public general version", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows + clean + odd_rows(), SCHEMA).withColumn("license", F.lit("x"))
    got = defaultdict(list)
    for r in op08_license_scan.scan(docs, ["doc_id"]).collect():
        got[r["doc_id"]].append(r)
    text = {r[0]: r[1] for r in rows}
    for i, (name, start) in want.items():
        mine = [r for r in got[i] if r["license"] == name]
        assert len(mine) == 1 and mine[0]["coverage"] >= 0.8, (name, got[i])
        assert abs(mine[0]["start"] - start) <= 4
        assert len(words_of(text[i][mine[0]["start"] : mine[0]["end"]])) >= mine[0]["matched_words"]
    assert not [d for d in got if d not in want]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {r["doc_id"]: sum(r["text"].count(x) for x in (t["Apache-2.0 line"], t["CC-BY-NC-4.0 line"], t["GPL-3.0 line"], t["MIT line"])) for r in given.collect()}
    found = Counter(r["doc_id"] for r in op08_license_scan.scan(given, ["doc_id"]).collect())
    assert all(found[d] >= n for d, n in lines.items() if n) and sum(found.values()) <= sum(lines.values()) * 1.2 + 3
    assert op08_license_scan.scan(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_look_alikes_are_named_rightly(spark):
    cases = {
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY 3.0": None,
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": None,
        "This work is licensed under the GNU General Public License, version 1.": None, "This work is licensed under the GNU General Public License, version 2.1": None,
        "This work is licensed under the GNU General Public License, version 2.0. It": "GPL-2.0", "This work is licensed under the GNU General Public License, version 2. 1. First": "GPL-2.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the Apache License, Version 1.1.": None,
        op08_license_scan.TEMPLATES["LGPL-2.1 notice"]: "LGPL-2.1", op08_license_scan.TEMPLATES["Unlicense"]: "Unlicense",
    }
    rows = [(i, f"some words before it here. {text}") for i, text in enumerate(cases)]
    got = defaultdict(set)
    for r in op08_license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect():
        got[r["doc_id"]].add(r["license"].split(" ")[0])
    assert [got.get(i) for i, _ in rows] == [None if x is None else {x} for x in cases.values()]
    assert "This library is free software" in op08_license_scan.TEMPLATES["LGPL-2.1 notice"]


def test_license_spans_against_every_alignment(spark):
    """Each template aligned to each whole text, without index and band."""
    rng = np.random.default_rng(14)
    t = op08_license_scan.TEMPLATES
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = []
    for i, name in enumerate(sorted(t)):
        w = t[name].split()
        for _ in range(len(w) // 8 * (i % 3)):  # some keep too little of the notice
            w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 99)}"
        rows.append((i, f"{filler(20)} {' '.join(w)} {filler(30)}"))
    index = op08_license_scan.Index(t)
    want = {}
    for i, text in rows:
        words, _ = op02_cgk.words_of(pa.array([text]))
        found = []
        for k, name in enumerate(index.names):
            own = index.of(k)
            got, _, _, b0, b1 = _align.local_alignment(own, words, 0, len(own) + len(words))
            if got >= op08_license_scan.COVERAGE * len(own):
                found.append((-got, -got / len(own), name, b0, b1))
        taken = []
        for got, _, name, b0, b1 in sorted(found):
            if all(b1 <= a or b0 >= b for _, _, a, b in taken):
                taken.append((name, -got, b0, b1))
        want[i] = sorted(x[:2] for x in taken)
    have = defaultdict(list)
    for r in op08_license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect():
        have[r["doc_id"]].append((r["license"], r["matched_words"]))
    assert {i: sorted(have.get(i, [])) for i in want} == want and sum(map(bool, want.values())) > len(rows) // 2


def test_local_alignment():
    a = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    b = np.array([9, 9, 1, 2, 7, 3, 4, 6, 9], np.uint64)
    got, a0, a1, b0, b1 = _align.local_alignment(a, b, 2, 4)
    assert (got, a0, a1, b0, b1) in [(5, 0, 6, 2, 8), (4, 0, 4, 2, 7)]
    assert _align.local_alignment(a, a, 0, 1) == (6, 0, 6, 0, 6)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_co_training_on_held_out_labels(spark):
    """Rounds make no held-out figure worse than the labels alone do."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 1"), {r["doc_id"]: r for r in labels.where("doc_id % 4 = 1").collect()}
    featured, found = op09_co_training.features(docs.withColumn("score", F.lit(1)), ["doc_id"]), {}
    for rounds in (0, 3):
        models = op09_co_training.fit(featured, train, ["quality", "toxic"], rounds=rounds)
        out = [r for r in op09_co_training.scored(featured, models, ["doc_id"]).collect() if r["doc_id"] in test]
        for t, least in (("quality", 0.99), ("toxic", 0.98)):
            score, y = np.array([r[f"{t}_score"] for r in out]), np.array([test[r["doc_id"]][t] for r in out])
            assert ((score >= 0) & (score <= 1)).all() and auc(score, y) >= least, t
            assert abs(score.mean() - y.mean()) < 0.03  # calibrated
            found[rounds, t] = auc(score, y), -np.mean((score - y) ** 2)
    for t in ("quality", "toxic"):
        assert all(after >= before - 1e-9 for before, after in zip(found[0, t], found[3, t], strict=True)), found


def two_views(rng, n=900):
    """Documents whose class shows in their words and, independently, in their source; few positives."""
    y = (rng.random(n) < 0.25).astype(int)
    word = lambda c: f"{'bad' if rng.random() < (0.3 if c else 0.1) else 'any'}{rng.integers(0, 60)}"
    rows = [(i, " ".join(word(c) for _ in range(12)), "en", f"s{(6 if rng.random() < (0.85 if c else 0.1) else 0) + rng.integers(0, 6)}") for i, c in enumerate(y)]
    return rows, y


def test_co_training_rounds_help_where_views_agree(spark, monkeypatch):
    rows, y = two_views(np.random.default_rng(0), 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(240)], "doc_id long, toxic int")
    added = defaultdict(list)
    plain = op09_co_training.CoTraining.add
    monkeypatch.setattr(op09_co_training.CoTraining, "add", lambda self, to, at, target: (added[to].extend(target), plain(self, to, at, target))[1])
    got = {}
    for rounds in (0, 3):
        models = op09_co_training.learn(docs, labels, ["toxic"], rounds=rounds, picks=150)
        score = {r["doc_id"]: r["toxic_score"] for r in op09_co_training.scores(docs, models, ["doc_id"]).collect()}
        got[rounds] = auc(np.array([score[i] for i in range(240, 3000)]), y[240:])
    assert got[3] >= got[0] - 0.005 and got[0] > 0.85
    for to in ("text", "meta"):  # both views pick both classes, in the labels' ratio
        if added[to]:
            assert abs(np.mean(added[to]) - y[:240].mean()) < 0.1
    assert added["text"] or added["meta"]


def test_co_training_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for labels in ([], [(900001, 1), (900002, 1)], [(None, 1), (5, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        models = op09_co_training.learn(docs, table, ["quality"])
        got = op09_co_training.scores(docs, models, ["doc_id"]).collect()
        assert len(got) == len(odd_rows()) and {r["quality_score"] for r in got} == {1.0 if (900001, 1) in labels else 0.5}
    models = op09_co_training.learn(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), ["quality"]
    )
    got = op09_co_training.scores(docs, models, ["doc_id"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert op09_co_training.scores(docs.limit(0), models, ["doc_id"]).count() == 0


def test_co_training_against_a_plain_loop(spark):
    """Rounds with their own choice, balance, gates and taking back, over all rows in one place, whatever the partitions."""
    m = op09_co_training
    rows, y = two_views(np.random.default_rng(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(200)], "doc_id long, toxic int")
    got = []
    for n in (3, 11):
        models = m.learn(docs.repartition(n), labels, ["toxic"], rounds=3, picks=60)
        got.append({r["doc_id"]: r["toxic_score"] for r in m.scores(docs, models, ["doc_id"]).collect()})
    b, meta, length = m.text_features(pa.array([r[1] for r in rows])), [(r[3], r[2]) for r in rows], None
    length = b.shapes[:, 7]
    known = sorted(range(200), key=str)
    held, first = known[::5], [i for k, i in enumerate(known) if k % 5]
    share, chance = y[:200].mean(), lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z, t: np.mean([-np.log(chance(v) if c else 1 - chance(v)) for v, c in zip(z, t, strict=True)])
    line = lambda w, x: w[0] + x @ w[1:]

    def halves(x, t, ridge):
        odd = np.zeros(len(t), bool)
        for c in (0, 1):
            odd[[i for i in range(len(t)) if t[i] == c][::2]] = True
        out = np.zeros(len(t))
        out[odd], out[~odd] = line(m._logistic(x[~odd], t[~odd], ridge), x[odd]), line(m._logistic(x[odd], t[odd], ridge), x[~odd])
        return out

    def trained(sets):
        at, target = (np.array([r[k] for r in sets["text"]]) for k in (0, 1))
        text = m.fit_text(m._take(b, at), target.astype(float))
        at, target = (np.array([r[k] for r in sets["meta"]]) for k in (0, 1))
        view = m.fit_meta([meta[i] for i in at], length[at], target.astype(float))
        z, t = [text.logit(b), view.logit(meta, length)], y[held].astype(float)
        platt = [m._logistic(v[held][:, None], t, 0.01) for v in z]
        useful = [loss(halves(v[held][:, None], t, 0.01), t) < 0.98 * loss(np.full(len(t), np.log(t.mean() / (1 - t.mean()))), t) for v in z]
        z = [line(w, v[:, None]) for w, v in zip(platt, z, strict=True)]
        both = np.column_stack([v * u for v, u in zip(z, useful, strict=True)])
        return z, useful, loss(halves(both[held], t, 0.1), t), chance(line(m._logistic(both[held], t, 0.1), both))

    sets = {to: [(i, y[i]) for i in first] for to in ("text", "meta")}
    now, gone, picked = trained(sets), set(range(200)), 0
    for _ in range(3):
        more, before = {to: list(rows_) for to, rows_ in sets.items()}, set(gone)
        for v, to in enumerate(("meta", "text")):
            if now[1][v]:
                p = np.round(chance(now[0][v]), 9)
                few = round(60 * share)
                found = []
                for c, most in ((0, 60 - few), (1, few)):
                    sure = p if c else 1 - p
                    found.append([i for i in sorted(range(len(rows)), key=lambda i: (-sure[i], i)) if i not in before and sure[i] >= 0.9][:most])  # noqa: B023
                found = [[i for i in own if i not in gone] for own in found]
                gone |= set(found[0]) | set(found[1])
                neg, pos = found[0][: round(len(found[1]) * (1 - share) / share)], found[1][: round(len(found[0]) * share / (1 - share))]
                more[to] += [(i, 0) for i in neg] + [(i, 1) for i in pos]
                picked += len(neg) + len(pos)
        then = trained(more)
        if then[2] > now[2] or all(len(more[to]) == len(sets[to]) for to in sets):
            break
        sets, now = more, then
    assert picked > 40
    for found in got:
        assert np.allclose([found[i] for i in range(len(rows))], now[3], atol=1e-6)


def test_co_training_learns_from_all_words_of_long_texts(spark):
    """Telling words count however many other words a labelled text has."""
    filler = " ".join(f"filler{i}" for i in range(1000))
    told = {y: " ".join(f"{y}{i}" for i in range(40)) for y in ("good", "bad")}
    docs = spark.createDataFrame([(i, f"{filler} {told['good' if i % 2 else 'bad']}", "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    odds = op09_co_training.learn(docs, labels, ["quality"])["quality"].text.odds
    good, bad = (op09_co_training.text_features(pa.array([told[y]])).buckets for y in ("good", "bad"))
    assert (odds[good] > 1).sum() >= 37 and (odds[bad] < -1).sum() >= 37  # but for a few that share a bucket with fillers
