"""Exact quantiles of groups of any size: no buffer of a group's values, no sort of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are counted in, at each step.
RANGES = 4096
STEPS = 2


def exact_quantiles(df: DataFrame, value: Column, shares: list[float], by: tuple[str, ...] = (), ranges: int = RANGES, steps: int = STEPS) -> DataFrame:
    """``by``, share and value: each group's quantiles with linear interpolation, as ``percentile`` gives them.

    Values are counted in equal ranges between a group's least and largest; the ranges that hold a wanted rank become the
    groups of the next step. What is left after ``steps`` of these is counted value by value, and ranks are read off the
    running sums. Every exchange carries counts, ``ranges`` rows for each group and task at most, and all groups and
    shares go in the same passes. The bounds are joined back as Spark sees fit by their size: a row for each group, then
    for each range that is wanted. Values that are null or no number don't count; a group without values has no rows.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    own = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.cast("double").alias("_v"))
    own = own.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", F.lit("")).withColumn("_v", F.col("_v") + F.lit(0.0))
    part = [*keys, "_b"]
    same = lambda a, b: [a[c].eqNullSafe(b[f"r{c}"]) for c in part]
    named = lambda t: t.select(*[F.col(c).alias(f"r{c}") for c in part], *[c for c in t.columns if c not in part])

    wanted = own.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    at = F.col("_share") * (F.col("_n") - 1)
    wanted = wanted.withColumn("_rank", F.explode(F.array(F.floor(at), F.ceil(at)))).select(*part, "_share", "_n", "_rank", F.col("_rank").alias("_in")).distinct()
    for _ in range(steps):
        ends = own.groupBy(*part).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        bounds = named(ends)
        own = own.join(bounds, same(own, bounds)).drop(*[f"r{c}" for c in part])
        width = F.col("_hi") / ranges - F.col("_lo") / ranges
        nth = F.when(width > 0, F.least(F.lit(ranges - 1), F.floor(F.col("_v") / width - F.col("_lo") / width))).otherwise(0)
        own = own.withColumn("_c", F.greatest(nth, F.lit(0)).cast("long"))
        counts = own.groupBy(*part, "_c").agg(F.count(F.lit(1)).alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*part).orderBy("_c"))
        counts = named(counts.withColumn("_upto", upto))
        near = wanted.join(counts, [*same(wanted, counts), (F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_m"))])
        deeper = F.concat("_b", F.lit("/"), F.col("_c").cast("string"))
        wanted = near.select(*keys, deeper.alias("_b"), "_share", "_n", "_rank", (F.col("_in") - F.col("_upto") + F.col("_m")).alias("_in"))
        held = named(wanted.select(*part).distinct())
        own = own.withColumn("_b", deeper).select(*part, "_v")
        own = own.join(held, same(own, held), "left_semi")
    counts = own.groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_m"))
    counts = named(counts.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*part).orderBy("_v"))))
    found = wanted.join(counts, [*same(wanted, counts), (F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_m"))])
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    over = F.col("_share") * (F.first("_n") - 1) - F.min("_rank")
    out = found.groupBy(*keys, "_share").agg(low.alias("_low"), high.alias("_high"), over.alias("_over"))
    mixed = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - F.col("_over")) * F.col("_low") + F.col("_over") * F.col("_high"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("_share").alias("share"), mixed.alias("value"))
