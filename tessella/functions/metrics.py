"""Set-based multi-label metrics. Counts stay whole numbers; each ratio is one division at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def set_counts(actual: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) of two arrays taken as sets."""
    both, a, p = F.size(F.array_intersect(actual, predicted)), F.size(F.array_distinct(actual)), F.size(F.array_distinct(predicted))
    return both.cast("long"), (p - both).cast("long"), (a - both).cast("long")


def sample_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Scores of one sample; without actual and predicted labels all are 1."""
    none = (tp + fp + fn) == 0
    return {
        "precision": F.when(none, 1.0).otherwise(precision(tp, fp)),
        "recall": F.when(none, 1.0).otherwise(recall(tp, fn)),
        "f1": F.when(none, 1.0).otherwise(f1(tp, fp, fn)),
        "perfect_match": ((fp + fn) == 0).cast("int"),
    }


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def error_category(f1_: Column, n_actual: Column, n_predicted: Column) -> Column:
    return (
        F.when(f1_ == 1.0, "perfect_match").when(f1_ > 0, "partial_match")
        .when((n_actual == 0) & (n_predicted > 0), "false_positive_only").otherwise("complete_miss")
    )
