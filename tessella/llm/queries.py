"""The operators' queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op01_language,
    op02_cgk,
    op03_hilbert,
    op04_log_templates,
    op05_budget_fit,
    op06_host_rules,
    op07_order_minhash,
    op08_license_scan,
    op09_co_training,
    op10_hidden_markov,
    op11_byte_bpe,
    op12_collocations,
    op13_lexical_search,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = op01_language.held_out()
    model = op01_language.learn(docs.where(~held), "text", "lang", "doc_id")
    out = op01_language.label_languages(docs.withColumn("_held", held), model, ["doc_id", "_held"])
    return out.select("doc_id", F.col("_held").alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_cgk.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op03_hilbert.hilbert_shards(_docs(spark, sf_dir))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )


def op4_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_log_templates.dedup_lines(_docs(spark, sf_dir))


def op5_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_budget_fit.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_host_rules.host_rules(_docs(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("source").alias("host"), F.round("host_fail_rate", 6).alias("host_fail_rate"),
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_order_minhash.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op8_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_license_scan.scan(_docs(spark, sf_dir), ["doc_id"])


def op9_co_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = op09_co_training.co_trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality", "toxic"], ["doc_id"])
    return out.select(
        "doc_id", F.col("quality_score").alias("score"), "quality_text_view", "quality_meta_view", "toxic_score",
        ((F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)).alias("keep"),
    )


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = op10_hidden_markov.held_out()
    out = op10_hidden_markov.hmm_scores(docs.withColumn("held_out", held), ~held, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = op11_byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(_docs(spark, sf_dir), ["doc_id"], decoded=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_collocations.collocations(_docs(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_lexical_search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_cgk_decontam": op2_cgk_decontam,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_template_lines": op4_template_lines,
    "op5_budget_mix": op5_budget_mix,
    "op6_host_quality": op6_host_quality,
    "op7_order_minhash": op7_order_minhash,
    "op8_license_spans": op8_license_spans,
    "op9_co_trained": op9_co_trained,
    "op10_hmm_scores": op10_hmm_scores,
    "op11_byte_bpe": op11_byte_bpe_digests,
    "op12_phrases": op12_phrases,
    "op13_ranked_search": op13_ranked_search,
}

def _op6_sql() -> str:
    """Measures by lists of words, rates and priors by host, verdicts joined back."""
    o = op06_host_rules
    rules = {
        "base": f"n_words < {o.MIN_WORDS} OR 100 * n_repeat_words > {o.MAX_REPEAT_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {o.MAX_SYMBOL_PERCENT} * n_words",
        "dup_lines": f"100 * n_dup_lines > {o.MAX_DUP_LINE_PERCENT} * n_lines AND n_dup_lines >= {o.MIN_DUP_LINES}",
        "echo": f"100 * n_echo_words > {o.MAX_ECHO_PERCENT} * n_words",
    }
    moments, priors, rates, joined = [], [], [], []
    for k in rules:
        m, noise = f"mean_{k}", f"mean_{k} * (1 - mean_{k})"
        moments += [f"avg(fail_{k} / n_docs) AS mean_{k}", f"var_pop(fail_{k} / n_docs) AS var_{k}"]
        weight = f"greatest(2.0, {noise} / greatest(var_{k} - {noise} / greatest(1.0, size), {noise} / 1e6) - 1)"
        priors += [f"CASE WHEN {m} > 0 AND {m} < 1 THEN {m} * {weight} ELSE 0.5 + {m} END AS a_{k}", f"CASE WHEN {m} > 0 AND {m} < 1 THEN (1 - {m}) * {weight} ELSE 1.5 - {m} END AS b_{k}"]
        rates += [f"(fail_{k} + a_{k}) / (n_docs + a_{k} + b_{k}) AS rate_{k}"]
        joined += [f"(rate_{k} >= 0.01 AND bad_{k})"] if k != "base" else []
    low = "rate_base - 1.96 * sqrt(rate_base * (1 - rate_base) / (n_docs + a_base + b_base + 1))"
    return rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM w),
      runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
      rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM runs WHERE c > 1) GROUP BY 1),
      m AS (SELECT doc_id, source, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(ln) AS n_lines,
        (len(ln) - len(list_distinct(ln)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words FROM lines LEFT JOIN rep USING (doc_id)),
      b AS (SELECT *, {", ".join(f"({r}) AS bad_{k}" for k, r in rules.items())} FROM m),
      hosts AS (SELECT source, count(*)::double AS n_docs, {", ".join(f"count(*) FILTER (WHERE bad_{k})::double AS fail_{k}" for k in rules)} FROM b GROUP BY 1),
      moments AS (SELECT count(*) / sum(1 / n_docs) AS size, {", ".join(moments)} FROM hosts),
      rates AS (SELECT *, {", ".join(rates)} FROM hosts, (SELECT {", ".join(priors)} FROM moments))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad_base AS base_failed, NOT bad_base AND NOT ({low} > 0.5 OR {" OR ".join(joined)}) AS kept, b.source AS host, round(rate_base, 6) AS host_fail_rate
      FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source"""


def _op3_sql(dims: tuple[str, ...] = ("source", "lang"), bits: int = 5, shards: int = 8) -> str:
    """Bins by cut points, the curve by the steps of its definition, runs by row number; CRC-32 from its polynomial.

    Sizes and dimensions are cut at the values that stand at equal shares of all rows; a dimension with no more values
    than bins has a bin for each.
    """
    bins = 1 << bits
    step, k = ["cells AS (SELECT *, " + ", ".join(f"b{i} AS x{i}" for i in range(3)) + " FROM binned)"], "cells"
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(3):
            on, swap = f"((x{i} >> {b}) & 1) = 1", f"CASE WHEN ((x{i} >> {b}) & 1) = 1 THEN 0 ELSE xor(x0, x{i}) & {low} END"
            cols = [f"xor(x0, CASE WHEN {on} THEN {low} ELSE xor(x0, x{i}) & {low} END) AS x0"]
            cols += [f"xor(x{j}, {swap}) AS x{j}" if j == i else f"x{j}" for j in (1, 2)]
            name = f"s{b}_{i}"
            step.append(f"{name} AS (SELECT * EXCLUDE (x0, x1, x2), {', '.join(cols)} FROM {k})")
            k = name
    word = " + ".join(f"(((x{i} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    g = "g0"
    step.append(f"g0 AS (SELECT *, ({word})::bigint AS w FROM {k})")
    for s in (1, 2, 4, 8):
        step.append(f"g{s} AS (SELECT * EXCLUDE (w), xor(w, w >> {s}) AS w FROM {g})")
        g = f"g{s}"
    cut_by = lambda v, i: (
        f"v{i} AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS p, count(*) OVER () AS n FROM d WHERE {v} IS NOT NULL), "
        f"u{i} AS (SELECT count(DISTINCT v) AS k FROM v{i}), "
        f"q{i} AS (SELECT CASE WHEN k <= {bins} THEN (SELECT list_sort(list(DISTINCT v))[2:] FROM v{i}) ELSE (SELECT list(DISTINCT v) FROM v{i} "
        f"WHERE list_contains(list_transform(range(1, {bins}), lambda i: i * n // {bins}), p)) END AS cuts FROM u{i})"
    )
    cuts = ", ".join(cut_by(v, i) for i, v in enumerate([*dims, "size"]))
    own = [f"CASE WHEN text IS NULL THEN {d} ELSE first_value({d}) OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, {', '.join(f'{x} NULLS FIRST' for x in dims)}) END AS g{i}" for i, d in enumerate(dims)]
    counted = [f"coalesce(len(list_filter(q{i}.cuts, lambda c: c <= {v})), 0)::bigint AS b{i}" for i, v in enumerate([*(f"g{i}" for i in range(len(dims))), "size"])]
    return rf"""WITH poly(c0) AS (SELECT unnest(range(256))), t8 AS (SELECT c0, list_reduce(list_concat([c0], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM poly),
      tab AS (SELECT list(c ORDER BY c0) AS t FROM t8), h AS (SELECT doc_id, {", ".join(dims)}, text, hex(encode(text)) AS hx, {", ".join(own)} FROM documents),
      d AS (SELECT *, coalesce(length(hx) // 2, 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM h, tab),
      {cuts}, binned AS (SELECT d.doc_id, d.size, d.text_crc32, md5(d.text) AS m, {", ".join(counted)} FROM d, {", ".join(f"q{i}" for i in range(len(dims) + 1))}),
      {", ".join(step)}, placed AS (SELECT *, row_number() OVER (ORDER BY w, text_crc32 NULLS FIRST, m NULLS FIRST, doc_id NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM {g})
      SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'rows' AS law, (i * {shards} // n)::int AS shard, (i - ((i * {shards} // n) * n + {shards - 1}) // {shards})::bigint AS slot, NULL::int AS grown_shard, w::bigint AS curve_index FROM placed"""


def _op12_sql() -> str:
    """All runs of up to five words, grouped; cuts and scores in 128-bit whole numbers."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({lower}, '[.,;:!?\n-\r]')), '[^ \t]+') AS w FROM documents),
      runs AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS size))),
      counted AS (SELECT lang, size, phrase, count(*)::bigint AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
      totals AS (SELECT lang, sum(len(w))::bigint AS n FROM pieces GROUP BY 1),
      phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size >= 2),
      cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lhs, array_to_string(w[k + 1:], ' ') AS rhs FROM (SELECT *, unnest(range(1, size)) AS k FROM phrases)),
      scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint AS score, k FROM cuts c
        JOIN counted x ON x.lang = c.lang AND x.phrase = lhs JOIN counted y ON y.lang = c.lang AND y.phrase = rhs JOIN totals t ON t.lang = c.lang),
      lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      longer AS (SELECT lang, inner_phrase AS phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i:i + part - 1], ' ') AS inner_phrase
        FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM phrases, (SELECT unnest(range(2, 5)) AS part) WHERE part < size)) GROUP BY 1, 2),
      kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
      SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""


def _op13_sql() -> str:
    """Terms by a pattern, sums of impacts by item and document."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = rf"regexp_extract_all({lower}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {terms} AS w FROM documents WHERE text IS NOT NULL),
      totals AS (SELECT count(*) FILTER (WHERE len(w) > 0)::bigint AS documents, sum(len(w))::bigint AS terms FROM d),
      tf AS (SELECT row, term, count(*)::bigint AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY 1, 2),
      q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
      weights AS (SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * holding + 1)))::bigint AS w
        FROM (SELECT term, count(*)::bigint AS holding FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1), totals),
      norms AS (SELECT row, doc_id, 50 + (50 * len(w)::bigint * documents) // terms AS m FROM d, totals),
      scores AS (SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score
        FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (row) GROUP BY 1, 2, 3)
      SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
      WHERE rank <= 50"""


ORACLES: dict[str, str] = {"op3_hilbert_shards": _op3_sql(), "op6_host_quality": _op6_sql(), "op12_phrases": _op12_sql(), "op13_ranked_search": _op13_sql()}
