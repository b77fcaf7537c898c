"""A gapless global index and running sums in sort order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut

_ROW_BITS = 33


def _placed(df: DataFrame, keys: list[str], weight: str | None) -> tuple[DataFrame, int]:
    """``df`` sorted by ``keys`` and written, with _at, _part and _first (the weight of all partitions before), and the whole weight."""
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("long"))
    total = F.sum(weight) if weight else F.count(F.lit(1))
    before, firsts = 0, []
    for r in sorted(placed.groupBy("_part").agg(total.alias("n")).collect(), key=lambda r: r["_part"]):
        firsts.append((r["_part"], before))
        before += r["n"]
    first = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    return placed.join(F.broadcast(first), "_part"), before


def indexed(df: DataFrame, keys: list[str], name: str = "_idx") -> tuple[DataFrame, int]:
    """``df`` sorted by ``keys`` with its 0-based rank, and the number of rows.

    Rows are range-partitioned by the keys, sorted within partitions, and written to the shared folder, so that ranks
    don't change if a partition is read again. A partition's first rank is the number of rows before it; these counts,
    one for each partition, are all that the driver sees.
    """
    placed, n = _placed(df, keys, None)
    index = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, index).drop("_part", "_first", "_at"), n


def weighed(df: DataFrame, keys: list[str], weight: str, name: str = "_before") -> tuple[DataFrame, int]:
    """``df`` with the sum of ``weight`` over the rows before it in the order of ``keys``, and over all rows."""
    placed, total = _placed(df, keys, weight)
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col("_first") + F.coalesce(F.sum(weight).over(own), F.lit(0))).drop("_part", "_first", "_at"), total
