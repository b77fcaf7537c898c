"""Scoring of predicted label sets, comparison of strategies, and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, category
from ..functions.metrics import error_category, f1, precision, recall, sample_scores, set_counts


def scored(results: DataFrame) -> DataFrame:
    """``results`` (actual_codes, predicted_codes) with tp, fp, fn and the sample's scores."""
    tp, fp, fn = set_counts(F.col("actual_codes"), F.col("predicted_codes"))
    out = results.withColumns({"tp": tp, "fp": fp, "fn": fn})
    return out.withColumns(sample_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def union_over_chunks(chunks: DataFrame, key: str, codes: str = "codes") -> DataFrame:
    """Distinct codes of all chunks of a document, in order; chunks without codes keep their document."""
    return chunks.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(codes)))).alias("predicted_codes"), F.count(F.lit(1)).alias("num_chunks"))


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]


def _micro_scores() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"micro_p": precision(tp, fp), "micro_r": recall(tp, fn), "micro_f1": f1(tp, fp, fn)}


def micro(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of counts, one division for each ratio at the end."""
    return df.groupBy(*by).agg(*_sums()).withColumns(_micro_scores())


def per_code(results: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Counts and scores of each code that is actual or predicted somewhere."""
    a, p = F.array_distinct("actual_codes"), F.array_distinct("predicted_codes")
    rows = results.select(*by, a.alias("a"), p.alias("p"), F.explode(F.array_union("actual_codes", "predicted_codes")).alias("f_code"))
    in_a, in_p = F.array_contains("a", F.col("f_code")), F.array_contains("p", F.col("f_code"))
    out = rows.groupBy(*by, "f_code").agg(
        F.count_if(in_a).alias("occurrences"), F.count_if(in_a & in_p).alias("tp"), F.count_if(~in_a & in_p).alias("fp"), F.count_if(in_a & ~in_p).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def summary(scores: DataFrame, codes: DataFrame) -> DataFrame:
    """For each strategy micro, macro (all codes; codes that occur) and sample averages."""
    macro = codes.groupBy("strategy").agg(
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1_all"),
        F.avg(F.when(F.col("occurrences") > 0, F.col("f1"))).alias("macro_f1_occ"),
    )
    own = scores.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("f1").alias("sample_avg_f1"), F.avg("perfect_match").alias("perfect_rate"),
        F.sum("perfect_match").alias("n_perfect"), F.count_if((F.col("f1") > 0) & (F.col("f1") < 1)).alias("n_partial"), F.count_if(F.col("f1") == 0).alias("n_zero"),
        *_sums(),
    )
    return own.withColumns(_micro_scores()).drop("tp", "fp", "fn").join(macro, "strategy")


def compare(micro_scores: DataFrame, strategies: DataFrame) -> DataFrame:
    """Strategies ranked by F1, precision and recall, with the gain over the first that isn't fine-tuned.

    There are as many rows as strategies; the first in order wins ties.
    """
    df = micro_scores.join(F.broadcast(strategies), "strategy")
    one = Window.partitionBy(F.lit(0))
    base = F.min_by("micro_f1", F.when(~F.col("fine_tuned"), F.col("ord"))).over(one)
    rank = lambda c: F.row_number().over(one.orderBy(F.desc(c), "ord")).cast("long")
    return df.select(
        "strategy", "ord", "fine_tuned", "micro_f1", "micro_p", "micro_r", rank("micro_f1").alias("rank_f1"), rank("micro_p").alias("rank_p"),
        rank("micro_r").alias("rank_r"), (F.col("micro_f1") - base).alias("gain_over_base"), (rank("micro_f1") == 1).alias("best"),
    )


def comparison(summary: DataFrame, strategies: DataFrame, seconds: DataFrame) -> DataFrame:
    """A row for each strategy: scores, macro F1 of codes that occur, percent of perfect samples, minutes, samples.

    ``seconds``: (strategy, seconds) of the evaluations; one that is unknown took 0 minutes. There are as many rows as
    strategies.
    """
    own = summary.join(F.broadcast(strategies), "strategy").join(F.broadcast(seconds), "strategy", "left")
    base = F.min_by("micro_f1", F.when(~F.col("fine_tuned"), F.col("ord"))).over(Window.partitionBy(F.lit(0)))
    gain = F.col("micro_f1") - base
    return own.select(
        "strategy", "ord", F.when(F.col("fine_tuned"), "Yes").otherwise("No").alias("fine_tuned"), "micro_p", "micro_r", "micro_f1",
        F.coalesce("macro_f1_occ", F.lit(0.0)).alias("macro_f1"), F.round(F.col("perfect_rate") * 100, 1).alias("perfect_pct"),
        (F.coalesce("seconds", F.lit(0.0)) / 60).alias("minutes"), F.col("n_samples").alias("samples"),
        F.when(base > 0, gain / base * 100).otherwise(0.0).alias("gain_pct"),
    )


def aligned_strategies(scores: DataFrame, first: str) -> DataFrame:
    """For each strategy whether it has the same samples as ``first``; the others are to be left out of paired tests."""
    marked = scores.groupBy("sample_id").agg(F.collect_set("strategy").alias("s")).select(F.array_contains("s", first).alias("known"), F.explode("s").alias("strategy"))
    counts = marked.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("known").alias("n_shared"))
    # a row for each strategy, so that one window over them is small
    n = F.coalesce(F.max(F.when(F.col("strategy") == first, F.col("n_samples"))).over(Window.partitionBy(F.lit(0))), F.lit(0))
    return counts.withColumn("aligned", (F.col("n_samples") == n) & (F.col("n_shared") == n))


def sample_sets(scores: DataFrame) -> DataFrame:
    """strategy, n_samples and a fingerprint of its set of samples: sums of two 64-bit hashes, added up where the rows are.

    Equal sets have equal fingerprints; unequal ones of one size differ but for a chance of 2^-128. A sample that a
    strategy has twice counts twice.
    """
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20, 0)"))
    return scores.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_samples"), wide("sample_id").alias("mark_a"), wide(F.lit("second"), "sample_id").alias("mark_b"))


def aligned_pairs(scores: DataFrame) -> DataFrame:
    """Every pair of strategies, whether both have the same samples, and how many each has: a row of sums for each strategy is compared."""
    sets = sample_sets(scores)
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in sets.columns]) for x in ("1", "2"))
    same = (F.col("n_samples_1") == F.col("n_samples_2")) & (F.col("mark_a_1") == F.col("mark_a_2")) & (F.col("mark_b_1") == F.col("mark_b_2"))
    return a.join(F.broadcast(b), F.col("strategy_1") < F.col("strategy_2")).select(
        F.col("strategy_1").alias("strategy_a"), F.col("strategy_2").alias("strategy_b"), F.col("n_samples_1").alias("n_a"), F.col("n_samples_2").alias("n_b"), same.alias("aligned")
    )


def aligned_with(scores: DataFrame, first: str) -> list[str]:
    """The strategies that have the samples of ``first``, itself included; a paired test leaves the others out."""
    marks = {r["strategy"]: tuple(r)[1:] for r in sample_sets(scores).collect()}
    return [s for s, m in marks.items() if m == marks.get(first)]


def top_two(micro_scores: DataFrame, strategies: DataFrame) -> DataFrame:
    """The two best strategies by micro F1 (the first in order of several), side by side."""
    df = micro_scores.join(F.broadcast(strategies), "strategy")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("micro_f1"), "ord"))
    own = df.withColumn("rn", rank).where("rn <= 2")
    at = lambda i, c: F.max(F.when(F.col("rn") == i, F.col(c)))
    return own.agg(at(1, "strategy").alias("first"), at(2, "strategy").alias("second"), (at(1, "micro_f1") - at(2, "micro_f1")).alias("difference"))


def chunk_usage(runs: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Windows that a run used: total, mean, and documents with several."""
    multi = F.count_if(F.col("num_chunks") > 1)
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("num_chunks").cast("long").alias("total_chunks"), F.avg("num_chunks").alias("avg_chunks"), multi.alias("n_multi"),
        (multi * 100.0 / F.count(F.lit(1))).alias("multi_pct"),
    )


def arg_max(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row with the largest value, the first in order of several."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.max_by(whole, F.struct(F.col(value), -F.col(order))).alias("r")).select("r.*")


def by_category(results: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Counts and scores of each category of codes; categories without codes stay with zeros."""
    a, p = F.array_distinct("actual_codes"), F.array_distinct("predicted_codes")
    rows = results.select(*by, a.alias("a"), p.alias("p"), F.explode(F.array_union("actual_codes", "predicted_codes")).alias("c"))
    in_a, in_p = F.array_contains("a", F.col("c")), F.array_contains("p", F.col("c"))
    counts = rows.groupBy(*by, category(F.col("c")).alias("category")).agg(
        F.count_if(in_a & in_p).alias("tp"), F.count_if(~in_a & in_p).alias("fp"), F.count_if(in_a & ~in_p).alias("fn")
    )
    every = results.select(*by).distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])))
    out = every.join(counts, [*by, "category"], "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def tier_quartiles(codes: DataFrame, train_freq: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Quartiles of F1 for codes that occur, in tiers of training frequency: first 25 %, next 50 %, last 25 %."""
    own = codes.where("occurrences > 0").join(train_freq.select("f_code", F.col("n").alias("train_freq")), "f_code", "left").fillna(0, ["train_freq"])
    order = Window.partitionBy(*by).orderBy(F.desc("train_freq"), "f_code")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    own = own.withColumn("rn", F.row_number().over(order)).withColumn("n", n)
    tier = F.when(F.col("rn") <= F.floor(F.col("n") * 0.25), "frequent").when(F.col("rn") <= F.floor(F.col("n") * 0.75), "moderate").otherwise("rare")
    q = lambda x: F.percentile("f1", F.lit(x))
    return own.groupBy(*by, tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("n_codes"), F.count_if(F.col("f1") == 0).alias("n_zero"), F.min("train_freq").alias("freq_lo"), F.max("train_freq").alias("freq_hi"),
        F.min("f1").alias("min_f1"), q(0.25).alias("q1"), q(0.5).alias("median_f1"), q(0.75).alias("q3"), F.max("f1").alias("max_f1"),
    )


def frequency_tiers(codes: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Micro and mean scores of codes by their occurrences in the test set; empty tiers are left out."""
    c = F.col("occurrences")
    tier = F.when(c.between(1, 5), "1-5").when(c.between(6, 20), "6-20").when(c.between(21, 100), "21-100").when(c > 100, ">100")
    own = codes.withColumn("tier", tier).where(F.col("tier").isNotNull())
    sums = own.groupBy(*by, "tier").agg(
        F.count(F.lit(1)).alias("num_codes"), F.sum("occurrences").alias("total_occurrences"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") == 0).alias("num_zero_f1"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("f1") == 0, F.col("f_code")))), ",").alias("zero_f1_codes"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"micro_p": precision(tp, fp), "micro_r": recall(tp, fn), "micro_f1": f1(tp, fp, fn)}).drop("tp", "fp", "fn")


ERROR_CATEGORIES = ["perfect_match", "partial_match", "complete_miss", "false_positive_only"]


def error_categories(scores: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Samples of each error category; categories without samples stay."""
    kind = error_category(F.col("f1"), F.size("actual_codes"), F.size("predicted_codes"))
    counts = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(kind == c).alias(c) for c in ERROR_CATEGORIES])
    long = counts.unpivot([*by, "total"], ERROR_CATEGORIES, "category", "n")
    return long.select(*by, "category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def error_samples(scores: DataFrame, most: int = 50, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """The first ``most`` samples of each error category, lists rendered with '; '."""
    kind = error_category(F.col("f1"), F.size("actual_codes"), F.size("predicted_codes"))
    own = scores.withColumn("category", kind)
    rank = F.row_number().over(Window.partitionBy(*by, "category").orderBy("sample_id"))
    show = lambda c: F.array_join(F.array_sort(c), "; ").alias(c)
    return own.withColumn("rn", rank.cast("long")).where(F.col("rn") <= most).select(*by, "category", "rn", "sample_id", show("actual_codes"), show("predicted_codes"))


def wrong_codes(scores: DataFrame, missed: bool, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Counts of codes predicted wrongly (or missed), with their share of the samples."""
    pair = ("actual_codes", "predicted_codes") if missed else ("predicted_codes", "actual_codes")
    counts = scores.select(*by, F.explode(F.array_except(*pair)).alias("f_code")).groupBy(*by, "f_code").agg(F.count(F.lit(1)).alias("n"))
    total = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total), list(by)).select(*by, "f_code", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct_samples"))


def wrong_code_rows(scores: DataFrame, missed: bool, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """A row for each code predicted wrongly (or missed) in a sample, with the sample's lists rendered with '; '."""
    pair = ("actual_codes", "predicted_codes") if missed else ("predicted_codes", "actual_codes")
    show = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "; ").alias(c)
    return scores.select(*by, "sample_id", F.explode(F.array_except(*pair)).alias("f_code"), show("actual_codes"), show("predicted_codes"))


def confusion_pairs(scores: DataFrame, least: int = 2, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """(missed code, wrongly predicted code) of the same sample, at least ``least`` times."""
    wrong = scores.select(*by, F.array_except("actual_codes", "predicted_codes").alias("m"), F.array_except("predicted_codes", "actual_codes").alias("w"))
    pairs = wrong.select(*by, "w", F.explode("m").alias("actual")).select(*by, "actual", F.explode("w").alias("predicted_instead"))
    return pairs.groupBy(*by, "actual", "predicted_instead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def fp_cooccurrence(scores: DataFrame, top: int = 10, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """(actual, other, n) over the most frequent actual codes: hits on the diagonal, else false positives beside them."""
    actual = F.array_distinct("actual_codes")
    freq = scores.select(*by, F.explode(actual).alias("f_code")).groupBy(*by, "f_code").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "f_code"))
    tops = freq.withColumn("rn", rank).where(F.col("rn") <= top).groupBy(*by).agg(F.array_sort(F.collect_list("f_code")).alias("tops"))
    own = scores.join(F.broadcast(tops), list(by))
    false = F.array_intersect(F.array_except("predicted_codes", "actual_codes"), F.col("tops"))
    rows = own.select(*by, "predicted_codes", false.alias("false"), F.explode(F.array_intersect(actual, F.col("tops"))).alias("actual"))
    hit = F.when(F.array_contains("predicted_codes", F.col("actual")), F.array(F.col("actual"))).otherwise(F.array().cast("array<string>"))
    cells = rows.select(*by, "actual", F.explode(F.concat("false", hit)).alias("other"))
    return cells.groupBy(*by, "actual", "other").agg(F.count(F.lit(1)).alias("n"))


def disjoint_scores(scores: DataFrame) -> DataFrame:
    """For each strategy micro F1 over all samples, those of patients in training, and the others, with the gaps."""
    known = F.col("patient_in_train")
    parts = {"full": F.lit(True), "disjoint": ~known, "overlap": known}
    sums = scores.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~known).alias("n_disjoint"), F.count_if(known).alias("n_overlap"),
        *[F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).alias(f"{c}_{p}") for p, on in parts.items() for c in ("tp", "fp", "fn")],
        *[F.avg(F.when(on, F.col("perfect_match"))).alias(f"exact_{p}") for p, on in parts.items()],
    )
    out = sums.withColumns({f"f1_{p}": f1(F.col(f"tp_{p}"), F.col(f"fp_{p}"), F.col(f"fn_{p}")) for p in parts})
    return out.select(
        "strategy", "n_total", "n_disjoint", "n_overlap", "f1_full", "f1_disjoint", "f1_overlap", "exact_full", "exact_disjoint", "exact_overlap",
        (F.col("f1_overlap") - F.col("f1_disjoint")).alias("gap_overlap_minus_disjoint"), (F.col("f1_full") - F.col("f1_disjoint")).alias("gap_full_minus_disjoint"),
    )


def label_vocabulary(df: DataFrame, codes: Column) -> DataFrame:
    """Dense ids of the sorted distinct labels; the label space is small by nature."""
    labels = df.select(F.explode(codes).alias("f_code")).distinct()
    return labels.withColumn("label_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("f_code")).cast("long") - 1)


def multi_hot(codes: Column, vocabulary: list[str]) -> Column:
    """0/1 vector over the vocabulary; unknown labels are dropped."""
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(codes, v).cast("int"))


def vocabulary_scores(results: DataFrame, vocabulary: list[str], by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Micro scores and exact matches over the labels of the vocabulary only."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    own = results.withColumns({c: F.array_intersect(c, known) for c in ("actual_codes", "predicted_codes")})
    tp, fp, fn = set_counts(F.col("actual_codes"), F.col("predicted_codes"))
    own = own.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    match = F.avg(((F.col("fp") + F.col("fn")) == 0).cast("int")).alias("exact_match")
    return own.groupBy(*by).agg(*_sums(), match).withColumns(_micro_scores()).select(*by, "micro_p", "micro_r", "micro_f1", "exact_match")


def best_and_worst(codes: DataFrame, least: int = 5, k: int = 10, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """The k best and worst codes by F1 among those that occur often enough."""
    own = codes.where(F.col("occurrences") >= least)
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "f_code")).cast("long")
    down = F.row_number().over(Window.partitionBy(*by).orderBy("f1", "f_code")).cast("long")
    both = own.withColumns({"rank_best": up, "rank_worst": down})
    return both.where((F.col("rank_best") <= k) | (F.col("rank_worst") <= k)).select(*by, "f_code", "f1", "occurrences", "rank_best", "rank_worst")
