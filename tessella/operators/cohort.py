"""Cohorts: documents joined with ordered code lists, contradictions, splits and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import comma_list, format_code


def grouped_codes(dx: DataFrame, prefix: str = "F", order: tuple[str, ...] = ("seq_num",)) -> DataFrame:
    """One row for each hadm_id: the first subject_id that isn't null, codes in order as 'A, B', their count, least seq_num.

    Rows are ordered by ``order`` and then by code, so that ties don't depend on the partitioning. Null keys are left out.
    """
    rows = dx.where(F.col("icd_code").startswith(prefix) & F.col("hadm_id").isNotNull())
    entry = F.struct(*order, format_code(F.col("icd_code")).alias("code"))
    out = rows.groupBy("hadm_id").agg(
        F.min_by("subject_id", F.when(F.col("subject_id").isNotNull(), F.struct(*order, "icd_code"))).alias("subject_id"),
        F.array_sort(F.collect_list(entry)).alias("e"),
        F.count(F.lit(1)).alias("f_code_count"),
        F.min("seq_num").cast("long").alias("primary_seq"),
    )
    return out.select(
        "hadm_id", "subject_id", F.array_join(F.transform("e", lambda x: x["code"]), ", ").alias("f_codes_str"), "f_code_count", "primary_seq"
    )


def with_primary(df: DataFrame) -> DataFrame:
    first = F.btrim(F.split("f_codes_str", ",")[0])
    return df.withColumn("primary_f_code", first).withColumn("primary_category", F.substring(first, 1, 3))


def build_cohort(notes: DataFrame, dx: DataFrame, prefix: str = "F", order: tuple[str, ...] = ("seq_num",)) -> DataFrame:
    """Notes with codes: inner join on encounter and patient, with length and primary code."""
    joined = notes.join(grouped_codes(dx, prefix, order), ["hadm_id", "subject_id"], "inner")
    return with_primary(joined.withColumn("text_length", F.length("text").cast("long")))


def conflict_type(codes: Column) -> Column:
    """Contradictory families in one list; the first kind wins, null if there is none."""
    has = lambda p: F.exists(codes, lambda c: c.startswith(p))
    return F.when(has("F32") & has("F33"), "depression_temporal").when(has("F30") & has("F31"), "bipolar_temporal")


def conflicts(df: DataFrame) -> DataFrame:
    kind = conflict_type(comma_list(F.col("f_codes_str"), formatted=False))
    return df.withColumn("conflict_type", kind).where(F.col("conflict_type").isNotNull()).select("hadm_id", "conflict_type")


def without_conflicts(df: DataFrame) -> DataFrame:
    return df.where(conflict_type(comma_list(F.col("f_codes_str"), formatted=False)).isNull())


def _numbered(df: DataFrame, part: Column, order: tuple[str, ...]) -> DataFrame:
    """``df`` with _rank (from 1) and _all, the rows of its part, in the order of ``_h`` and ``order``.

    Ranks are exact, but no part is sorted in one piece: it is numbered in 256 buckets by the first byte of the hash,
    which are laid end to end by their counts.
    """
    own = df.withColumn("_part", part).withColumn("_b", F.substring("_h", 1, 2))
    counts = own.groupBy("_part", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_part")
    counts = counts.select(
        F.col("_part").alias("_p"), F.col("_b").alias("_c"), F.sum("_n").over(whole).alias("_all"),
        (F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    placed = own.join(counts, own["_part"].eqNullSafe(counts["_p"]) & own["_b"].eqNullSafe(counts["_c"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part", "_b").orderBy("_h", *order))
    return placed.withColumn("_rank", rank).drop("_part", "_b", "_p", "_c", "_before")


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int = 42, train: int = 70, val: int = 15) -> DataFrame:
    """``split`` by seeded hash order within each stratum: the first ``train`` % and the next ``val`` %, rounded down.

    If any stratum has fewer than two rows, the split isn't stratified. If one leaves fewer than two to val and test
    together, these two are split without strata.
    """
    left = F.col("count") - F.floor(F.col("count") * train / 100)
    least, least_left = df.groupBy(stratum).count().agg(F.min("count"), F.min(left)).first()
    by_stratum = least is not None and least >= 2
    upto = lambda share: F.floor(F.col("_all") * share / 100)
    own = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    own = _numbered(own, F.col(stratum) if by_stratum else F.lit(0), (key,))
    if not by_stratum or least_left >= 2:
        split = F.when(F.col("_rank") <= upto(train), "train").when(F.col("_rank") <= upto(train + val), "val").otherwise("test")
        return own.withColumn("split", split).drop("_h", "_rank", "_all")
    own = own.withColumn("_first", F.col("_rank") <= upto(train)).drop("_rank", "_all")
    own = _numbered(own, F.col("_first"), (key,))
    split = F.when(F.col("_first"), "train").when(F.col("_rank") <= F.floor(F.col("_all") * val / (100 - train)), "val").otherwise("test")
    return own.withColumn("split", split).drop("_h", "_first", "_rank", "_all")


def hash_split(df: DataFrame, key: str, seed: int = 42, train: int = 70, val: int = 15) -> DataFrame:
    """A split by the key's hash alone: no shuffle, sizes within sampling error."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(100))
    return df.withColumn("split", F.when(h < train, "train").when(h < train + val, "val").otherwise("test"))


def apportioned_split(df: DataFrame, key: str, stratum: str, seed: int = 42, train: int = 70, val: int = 15) -> DataFrame:
    """``split`` with exact totals: ``train`` % of all rows, then the share of ``val`` in the rest, each to the row.

    In each of the two steps a stratum gets its quota rounded down, and the rows that the total still lacks go to the
    strata with the largest remainders (ties in order of strata), one each. So a stratum is within one row of its quota
    in either step, those of a single row included. Which rows it gives is decided by seeded hash. Strata are ranked in
    one small table, a row for each; a null stratum is one of them.
    """

    def quota(strata: DataFrame, of: Column, percent: int, whole: int, name: str) -> DataFrame:
        one = Window.partitionBy(F.lit(0))
        strata = strata.withColumn("_of", of).withColumn("_low", F.expr(f"(_of * {percent}L) div {whole}L"))
        lacks = F.expr(f"(sum(_of) over () * {percent}L) div {whole}L") - F.sum("_low").over(one)
        rank = F.row_number().over(one.orderBy(F.desc(F.expr(f"(_of * {percent}L) % {whole}L")), F.asc_nulls_last("_s")))
        return strata.withColumn(name, F.col("_low") + (rank <= lacks).cast("long")).drop("_of", "_low")

    strata = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    strata = quota(strata, F.col("_n"), train, 100, "_train")
    strata = quota(strata, F.col("_n") - F.col("_train"), val, 100 - train, "_val").drop("_n")
    own = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    own = _numbered(own, F.col(stratum), (key,)).join(strata, F.col(stratum).eqNullSafe(F.col("_s")))
    split = F.when(F.col("_rank") <= F.col("_train"), "train").when(F.col("_rank") <= F.col("_train") + F.col("_val"), "val").otherwise("test")
    return own.withColumn("split", split).drop("_h", "_rank", "_all", "_s", "_train", "_val")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), those with the least seeded hash: the same for every run.

    Rows are counted by the first four digits of their hash, then those of the group in which the ``n``-th falls by the
    next four. What is below the eight digits found is taken by a filter, and only the rows that share them are ranked:
    no task sees ``n`` rows of every partition.
    """
    own = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    none = df.sparkSession.range(1).select(F.lit("").alias("_p"), F.lit(0).cast("long").alias("_before"))

    def refined(found: DataFrame, digits: int) -> DataFrame:
        """One row: the prefix, longer by four digits, in which the n-th hash falls, and the rows before it."""
        inner = own.select("_h").join(F.broadcast(found), F.substring("_h", 1, digits - 4) == F.col("_p"))
        counts = inner.groupBy(F.substring("_h", 1, digits).alias("_q"), "_before").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_q"))  # 65,536 rows at most
        counts = counts.select("_q", (upto - F.col("_n")).alias("_before"), upto.alias("_upto")).where(F.col("_upto") >= n)
        return counts.agg(F.min(F.struct("_q", "_before")).alias("x")).select(F.coalesce("x._q", F.lit("g")).alias("_p"), F.coalesce("x._before", F.lit(0)).alias("_before"))

    last = refined(refined(none, 4), 8)
    near = own.join(F.broadcast(last), F.substring("_h", 1, 8) <= F.col("_p"))
    at = F.substring("_h", 1, 8) == F.col("_p")
    rank = F.row_number().over(Window.partitionBy(F.when(at, F.lit("")).otherwise(F.col("_h"))).orderBy("_h", key))
    return near.withColumn("_rank", F.when(at, rank + F.col("_before"))).where(F.col("_rank").isNull() | (F.col("_rank") <= n)).select(*df.columns)


def split_quality(df: DataFrame, key_columns: tuple[str, ...] = ("hadm_id", "subject_id", "f_codes_str")) -> DataFrame:
    """For each split: rows, nulls in key columns, repeated encounters, badly formatted and empty code lists, share."""
    codes = F.filter(comma_list(F.col("f_codes_str"), formatted=False), lambda c: c != "")
    bad = F.exists(codes, lambda c: (F.length(c) > 3) & ~F.contains(c, F.lit(".")))
    out = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in key_columns), F.lit(0)).alias("n_null_keys"),
        (F.count("hadm_id") - F.countDistinct("hadm_id")).alias("n_dup_hadm"),
        F.count_if(bad).alias("n_bad_format"),
        F.count_if(F.size(codes) == 0).alias("n_empty"),
    )
    # a row for each split, so that one window over them is small
    return out.withColumn("pct", F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))


def split_overlap(df: DataFrame, key: str) -> DataFrame:
    """Keys that two splits share, for each pair of splits, from one pass over the keys."""
    flags = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    return flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}_{b}") for a, b in pairs])


def top_category_drift(df: DataFrame, category: str = "primary_category", k: int = 10) -> DataFrame:
    """The k most frequent categories of each split, in order of name, and whether train has the same."""
    counts = df.groupBy("split", category).count()
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("count"), category))
    tops = counts.withColumn("rn", rank).where(F.col("rn") <= k).groupBy("split").agg(F.array_join(F.array_sort(F.collect_list(category)), ",").alias("top"))
    first = tops.where("split = 'train'").select(F.col("top").alias("train_top"))
    return tops.join(F.broadcast(first), F.lit(True), "left").select("split", "top", (F.col("top") == F.col("train_top")).alias("same_as_train"))


def patient_overlap(df: DataFrame) -> DataFrame:
    """Patients shared between splits, test encounters of training patients, and encounters per patient: one row."""
    per = df.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    )
    both = lambda a, b: F.count_if((F.col(a) > 0) & (F.col(b) > 0))
    in_train = F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0))
    return per.agg(
        both("train", "val").alias("train_val"), both("train", "test").alias("train_test"), both("val", "test").alias("val_test"),
        in_train.alias("n_test_enc_in_train"), (in_train * 100.0 / F.sum("test")).alias("pct_test_enc_in_train"),
        F.count_if(F.col("n") > 1).alias("n_multi"), (F.count_if(F.col("n") > 1) * 100.0 / F.count(F.lit(1))).alias("pct_multi"),
        F.avg("n").alias("mean_enc"), F.percentile("n", F.lit(0.5)).alias("median_enc"), F.max("n").alias("max_enc"),
    )


def of_training_patients(df: DataFrame, train: DataFrame) -> DataFrame:
    """``df`` with patient_in_train."""
    known = train.select(F.col("subject_id").alias("_s")).where("_s is not null").distinct().withColumn("patient_in_train", F.lit(True))
    joined = df.join(known, df["subject_id"] == known["_s"], "left").drop("_s")
    return joined.withColumn("patient_in_train", F.coalesce("patient_in_train", F.lit(False)))


def cohort_stats(notes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Encounters, patients, codes and rates of the merge: one row."""
    kept = cohort.agg(
        F.count(F.lit(1)).alias("n_encounters"), F.countDistinct("subject_id").alias("n_patients"), F.countDistinct("primary_f_code").alias("n_primary_codes"),
        F.coalesce(F.sum("f_code_count"), F.lit(0)).alias("n_code_instances"), F.avg("f_code_count").alias("avg_codes"),
    )
    all_ = notes.agg(F.count(F.lit(1)).alias("n_notes"))
    return kept.join(F.broadcast(all_), F.lit(True)).withColumn("merge_pct", F.col("n_encounters") * 100.0 / F.col("n_notes"))
