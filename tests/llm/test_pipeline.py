"""The pipeline's stages against the operators that they call, each on its own input; the operators have brute force in the other files."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tessella.llm import op02_cgk, op05_budget_fit, op06_host_rules, op07_order_minhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"odd{i}" for i in range(30))
    rows = [(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, text, "en", None, 1), (900003, text, "en", None, 1), (None, text + " x", None, "s", 1), (900005, "w " * 30_000, "en", "s", 1)]
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def as_rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def test_stages_one_by_one(spark, docs):
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    kept = pipeline.quality_rules(spark, docs, sf)
    verdict = {(r["doc_id"], r["source"], r["text"]): r["kept"] for r in op06_host_rules.host_rules(docs, ["doc_id", "text"]).collect()}
    assert kept.columns == docs.columns
    assert as_rows(kept) == Counter({k: n for k, n in as_rows(docs).items() if verdict[k[0], k[3], k[1]]})

    one = pipeline.near_dedup(spark, docs, sf)
    classes = op07_order_minhash.near_duplicates(docs).collect()
    assert one.columns == docs.columns and not as_rows(one) - as_rows(docs)
    assert sum(as_rows(one).values()) == sum(r["kept"] for r in classes)
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(r["doc_id"] for r in classes if r["kept"])

    clean = pipeline.decontamination(spark, docs, sf)
    bad = {r["doc_id"] for r in op02_cgk.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert bad and as_rows(clean) == Counter({k: n for k, n in as_rows(docs).items() if k[0] not in bad})

    mixed = pipeline.source_mix(spark, docs, sf)
    took = Counter()
    for r in op05_budget_fit.mix(docs).collect():
        took[r["doc_id"], r["source"]] += r["taken"]
    got = Counter()
    for k, n in as_rows(mixed).items():
        got[k[0], k[3]] += n * len(WORD.findall(k[1] or ""))
        assert n <= 2 * as_rows_of(docs)[k]
    assert +got == +took

    placed = pipeline.sharding(spark, mixed, sf).collect()
    sizes = Counter(r["shard"] for r in placed)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in placed) == as_rows(mixed)
    assert max(sizes.values()) - min(sizes.values()) <= 1


_seen = {}


def as_rows_of(df):
    if id(df) not in _seen:
        _seen[id(df)] = as_rows(df)
    return _seen[id(df)]


def test_extra_columns_with_clashing_names(spark, docs):
    names = ["_text", "_id", "_key", "_c0", "_rows", "_n", "_row", "size", "kept", "copies", "shard", "item", "label"]
    more = docs.limit(60)
    for n in names:
        more = more.withColumn(n, F.lit(n))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
    assert pipeline.sharding(spark, more, "/root/testdata/sf0.001").count() == 60


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
