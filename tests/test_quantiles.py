"""Exact quantiles against Spark's percentile and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.025, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize(("ranges", "steps"), [(4, 1), (8, 2), (4096, 2)])
def test_against_percentile(spark, ranges, steps):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=400)] + [("b", float(x)) for x in rng.integers(0, 4, 300)] + [("c", 5.0)] * 50
    rows += [(None, float(x)) for x in rng.exponential(size=200) ** 6] + [("d", 1.0), ("e", None), ("f", float("nan")), ("g", -0.0), ("g", 0.0), ("h", -1e300), ("h", 1e300), ("h", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r["k"], r["share"]): r["value"] for r in exact_quantiles(df, F.col("v"), SHARES, ("k",), ranges, steps).collect()}
    some = df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.percentile("v", SHARES).alias("q")).collect()
    want = {(r["k"], s): v for r in some for s, v in zip(SHARES, r["q"], strict=True)}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-12, abs=1e-12) for x in want)


def test_without_groups_and_of_no_rows(spark):
    df = spark.range(1001).select(F.col("id").alias("_v"))
    assert {r["share"]: r["value"] for r in exact_quantiles(df, F.col("_v"), [0.1, 0.333]).collect()} == {0.1: 100.0, 0.333: pytest.approx(333.0)}
    assert exact_quantiles(df.limit(0), F.col("_v"), [0.5]).count() == 0
