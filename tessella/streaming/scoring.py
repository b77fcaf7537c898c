"""Incremental scores: counts are sums, so they can be kept while sample results arrive.

The studies this engine is for are batch jobs; this only runs their per-code counts as a stream, in update mode. State
is one row for each strategy and code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import f1, precision, recall


def running_code_counts(results: DataFrame) -> DataFrame:
    """strategy, f_code, occurrences, tp, fp, fn over all results so far; ``results`` may be a stream."""
    rows = results.select(
        "strategy", F.array_distinct("actual_codes").alias("a"), F.array_distinct("predicted_codes").alias("p"), F.explode(F.array_union("actual_codes", "predicted_codes")).alias("f_code")
    )
    in_a, in_p = F.array_contains("a", F.col("f_code")), F.array_contains("p", F.col("f_code"))
    return rows.groupBy("strategy", "f_code").agg(
        F.count_if(in_a).alias("occurrences"), F.count_if(in_a & in_p).alias("tp"), F.count_if(~in_a & in_p).alias("fp"), F.count_if(in_a & ~in_p).alias("fn")
    )


def with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})
