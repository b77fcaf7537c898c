"""Label frequency, coverage, co-occurrence and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, SUBSTANCES, chapter, remission, severity, substance


def label_frequency(df: DataFrame, codes: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Instances of each code, repeats included."""
    return df.select(*by, F.explode(codes).alias("f_code")).groupBy(*by, "f_code").agg(F.count(F.lit(1)).alias("n"))


def coverage(freq: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank by count (then code), share of instances, and cumulative share. The label space is small by nature."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "f_code")
    whole = Window.partitionBy(*by)
    out = freq.withColumn("rank", F.row_number().over(order).cast("long"))
    out = out.withColumn("cum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    return out.withColumn("pct_of_instances", F.col("n") * 100.0 / F.col("total")).withColumn("cumulative_pct", F.col("cum") * 100.0 / F.col("total"))


def coverage_cutoff(covered: DataFrame, by: tuple[str, ...] = (), target: int = 90, at: int = 42) -> DataFrame:
    """Codes needed for ``target`` % of the instances (all if it isn't reached) and coverage at rank ``at`` or the last."""
    reached = F.min(F.when(F.col("cum") * 100 >= F.col("total") * target, F.col("rank")))
    return covered.groupBy(*by).agg(
        F.max("total").alias("n_instances"), F.count(F.lit(1)).alias("n_codes"), F.coalesce(reached, F.max("rank")).alias(f"rank_at_{target}"),
        F.max(F.when(F.col("rank") <= at, F.col("cumulative_pct"))).alias(f"coverage_at_{at}"),
    )


def covering_prefix(covered: DataFrame, target: int = 90) -> DataFrame:
    """The most frequent codes up to and with the one that reaches ``target`` %."""
    return covered.where((F.col("cum") - F.col("n")) * 100 < F.col("total") * target)


def coverage_at(covered: DataFrame, ranks: tuple[int, ...] = (3, 5, 10, 20, 50)) -> DataFrame:
    """Cumulative share at each rank; with fewer labels that of the last."""
    ks = covered.select(F.explode(F.array(*[F.lit(k).cast("long") for k in ranks])).alias("k"), "rank", "cumulative_pct")
    return ks.where("rank <= k").groupBy("k").agg(F.max("cumulative_pct").alias("cumulative_pct"))


def prefix_stability(covered: DataFrame, a: str, b: str, k: int = 42) -> DataFrame:
    """How many of the top k codes two splits share, and the codes that only one has."""
    tops = covered.where((F.col("rank") <= k) & F.col("split").isin(a, b)).groupBy("f_code").agg(
        F.max((F.col("split") == a).cast("int")).alias("a"), F.max((F.col("split") == b).cast("int")).alias("b")
    )
    only = lambda x, y: F.array_join(F.array_sort(F.collect_list(F.when((F.col(x) == 1) & (F.col(y) == 0), F.col("f_code")))), ",")
    return tops.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common"), only("a", "b").alias(f"only_{a}"), only("b", "a").alias(f"only_{b}"))


def list_overlap(found: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Case-folded overlap of a found list and a known one."""
    spark = found.sparkSession
    other = spark.createDataFrame([(t.lower(),) for t in sorted(set(known))], "t string").distinct()
    own = found.select(F.lower(column).alias("f")).distinct()
    both = own.join(other, own["f"] == other["t"], "full")
    return both.agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_common"), F.count("f").alias("n_found"), F.count("t").alias("n_known"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.col("f")))), ",").alias("only_found"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("f").isNull(), F.col("t")))), ",").alias("only_known"),
    )


def cooccurrence(df: DataFrame, codes: Column, top: list[str]) -> DataFrame:
    """(code_1, code_2, n): documents with both, for the given top codes; the diagonal is document frequency.

    Pairs are made within each row, so only counts are shuffled.
    """
    wanted = F.array(*[F.lit(t) for t in top])
    own = df.select(F.array_intersect(F.array_distinct(codes), wanted).alias("c"))
    pairs = own.select("c", F.explode("c").alias("code_1")).select("code_1", F.explode("c").alias("code_2"))
    return pairs.groupBy("code_1", "code_2").agg(F.count(F.lit(1)).alias("n"))


def top_codes(freq: DataFrame, k: int) -> list[str]:
    return [r["f_code"] for r in freq.orderBy(F.desc("n"), "f_code").limit(k).collect()]


def severity_rollup(freq: DataFrame, top: int = 5) -> DataFrame:
    """For each substance prefix its instances, and severity and remission of its ``top`` codes only."""
    own = freq.withColumn("prefix", F.substring("f_code", 1, 3)).where(F.col("prefix").isin(*SUBSTANCES))
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "f_code")
    own = own.withColumn("rn", F.row_number().over(order)).withColumn("sev", severity(F.col("f_code"))).withColumn("rem", remission(F.col("f_code")))
    part = lambda c, v: F.coalesce(F.sum(F.when((F.col("rn") <= top) & (F.col(c) == v), F.col("n"))), F.lit(0))
    return own.groupBy("prefix").agg(
        F.sum("n").alias("n_total"),
        *[part("sev", v).alias(f"n_{v.lower()}_top{top}") for v in ("Abuse", "Dependence", "Unspecified", "Other")],
        part("rem", "Active").alias(f"n_active_top{top}"), part("rem", "In Remission").alias(f"n_remission_top{top}"), part("rem", "Unknown").alias(f"n_unknown_top{top}"),
    ).withColumn("substance", substance(F.col("prefix")))


#: Buckets of label frequency; fixed values.
RARITY = [(1, 1, "Singleton (1)"), (2, 5, "Very rare (2-5)"), (6, 10, "Rare (6-10)"), (11, 50, "Uncommon (11-50)"), (51, 100, "Moderate (51-100)"), (101, None, "Common (>100)")]


def rarity_buckets(freq: DataFrame) -> DataFrame:
    """Codes in each frequency bucket; empty buckets stay."""
    spark = freq.sparkSession
    dim = spark.createDataFrame(RARITY, "lo long, hi long, bucket string")
    c = F.col("n")
    label = F.when(c == 1, RARITY[0][2])
    for lo, hi, name in RARITY[1:]:
        label = label.when(c >= lo if hi is None else c.between(lo, hi), name)
    counts = freq.groupBy(label.alias("b")).agg(F.count(F.lit(1)).alias("k"))
    out = dim.join(counts, dim["bucket"] == counts["b"], "left").select("bucket", "lo", "hi", F.coalesce("k", F.lit(0)).alias("n_codes"))
    return out.withColumn("pct_codes", F.col("n_codes") * 100.0 / F.sum("n_codes").over(Window.partitionBy(F.lit(0))))


def frequency_summary(freq: DataFrame) -> DataFrame:
    """Mean, upper median and singletons of label frequency."""
    ordered = F.array_sort(F.collect_list("n"))
    return freq.agg(
        F.count(F.lit(1)).alias("n_codes"), F.avg("n").alias("mean_n"), F.element_at(ordered, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("upper_median"),
        F.count_if(F.col("n") == 1).alias("n_singletons"),
    )


def chapter_rollup(freq: DataFrame) -> DataFrame:
    return freq.groupBy(chapter(F.col("f_code")).alias("chapter")).agg(F.count(F.lit(1)).alias("n_codes"), F.sum("n").alias("n_instances"))


def missing_labels(full: DataFrame, part: DataFrame) -> DataFrame:
    """Labels of ``full`` that ``part`` lacks, with their counts."""
    return full.join(part.select("f_code"), "f_code", "left_anti")


def category_order() -> list[str]:
    return list(CATEGORIES)
