"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to ``2^bits`` bins, the bins' cell is looked up in the table of the curve, rows are sorted
by curve index and the order is cut into runs of equal row counts. Rows near in all dimensions share a shard, so that
a reader who filters on any of them can skip most files by their minima and maxima.

Dimensions are cut at the values that stand at equal shares of all rows in the order of values (strings: of code
points): exactly, from the counts of the values. A dimension with no more values than bins has a bin for each.

Equal texts are kept together: all rows of a text have the cell of the one with the least id, and rows of one cell are
ordered by the text's checksum and MD5 and then by id. Only the cuts between shards can part them.

Defined results: null dimensions go to bin 0; a null text has size 1 and a null checksum, and null texts keep cells of
their own; a null id comes after all others where the least is sought; repeated rows get slots of their own; of a very
long text only size and checksums are used; an empty table gives an empty result. Columns that aren't named by the
caller aren't looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import indexed, weighed
from ._store import cut

#: A group of equal texts with two sets of dimensions is a row of some 100 bytes: 10 MB at most.
BROADCAST_GROUPS = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (n x dims, values under 2^bits).

    Gray-code form of the curve: from the top bit down, each dimension's bit either flips or swaps the lower bits of
    the first dimension; the interleaved bits are then decoded from Gray code.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for xi in x:
            on = (xi >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ xi) & low)
            x[0] ^= np.where(on, low, swap)
            if xi is not x[0]:
                xi ^= swap
    word = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for xi in x:
            word = word << 1 | (xi >> b & 1)
    shift = 1
    while shift < 64:
        word ^= word >> shift
        shift *= 2
    return word


def _cuts(df: DataFrame, name: str, bins: int) -> list:
    """At most ``bins - 1`` rising cut points; a value's bin is the number of cut points that aren't over it."""
    values = cut(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n")), dealt=True)
    first = values.limit(bins + 1).collect()
    if len(first) <= bins:
        return sorted(r["v"] for r in first)[1:]
    before, total = weighed(values, ["v"], "n")
    here = [(F.col("_before") <= p) & (F.lit(p) < F.col("_before") + F.col("n")) for p in (i * total // bins for i in range(1, bins))]
    return sorted(r["v"] for r in before.where(reduce(or_, here)).select("v").collect())


def _bin(name: str, cuts: list) -> Column:
    return sum((F.coalesce((F.col(name) >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def hilbert_order(df: DataFrame, dims: list[str], bits: int = 5, name: str = "_curve", counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the curve index of its quantised dimensions; the curve's table has 2^(bits * dims) <= 2^15 rows.

    ``counted``: a table with the dimensions of all rows that the cut points come from, if that is cheaper to read.
    """
    if not 1 <= bits * len(dims) <= 15:
        raise ValueError("bits * dimensions must be from 1 to 15")
    cell = F.lit(0)
    for d in dims:
        cell = cell * F.lit(1 << bits) + _bin(d, _cuts(df if counted is None else counted, d, 1 << bits))
    n = 1 << bits * len(dims)
    cells = np.stack([np.arange(n) >> bits * (len(dims) - 1 - i) & ((1 << bits) - 1) for i in range(len(dims))], 1)
    rows = list(enumerate(hilbert_index(cells, bits).tolist()))
    curve = df.sparkSession.createDataFrame(rows, f"_cell int, {name} long")
    return df.withColumn("_cell", cell).join(F.broadcast(curve), "_cell").drop("_cell")


def _as_one(df: DataFrame, dims: list[str], narrow: DataFrame) -> DataFrame:
    """``df`` with the dimensions ``_g0``, ...: each row's own, but those of the least id where texts are equal.

    ``narrow`` has _md5, _id and the dimensions of all rows. Only texts whose rows differ in them are joined.
    """
    own = F.struct(*dims)
    groups = narrow.where("_md5 is not null").groupBy("_md5").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", own.alias("d"))).alias("l"), F.min(own).alias("lo"), F.max(own).alias("hi")
    )
    groups = cut(groups.where("not (lo <=> hi)").select(F.col("_md5").alias("_of"), F.col("l.d").alias("_d")), dealt=True)
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = df.join(F.broadcast(groups) if small else groups, df["_md5"] == groups["_of"], "left")
    return joined.withColumns({f"_g{i}": F.when(F.col("_of").isNull(), F.col(d)).otherwise(F.col("_d")[d]) for i, d in enumerate(dims)}).drop("_of", "_d")


def shard_runs(df: DataFrame, keys: list[str], n_shards: int) -> DataFrame:
    """``df`` with shard and slot: runs of the order by ``keys`` whose row counts differ by one at most."""
    out, n = indexed(df, keys)
    shard = F.expr(f"(_idx * {n_shards}) div {max(1, n)}")
    out = out.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as long) * {n} + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", F.col("_idx") - first).drop("_idx")


def hilbert_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"),
    n_shards: int = 8, bits: int = 5, keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, shard, slot, curve_index, the dimensions and ``keep``.

    The dimensions and the size span the curve.
    """
    names = [*(f"_d{i}" for i in range(len(dims))), *(f"_k{i}" for i in range(len(keep)))]
    own = names[: len(dims)]
    slim = df.select(
        F.col(id_col).alias("_id"),
        *[F.col(d).alias(n) for d, n in zip([*dims, *keep], names, strict=True)],
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_md5"),
    )
    # texts are read once for the cut points and once more only if they are carried along
    narrow = cut(slim.drop(*names[len(dims) :]), narrow=True)
    rows = _as_one(slim if keep else narrow, own, narrow).withColumn("_tie", F.monotonically_increasing_id())
    cells = [f"_g{i}" for i in range(len(dims))]
    counted = narrow.select(*[F.col(n).alias(c) for n, c in zip(own, cells, strict=True)], "size")
    placed = shard_runs(hilbert_order(rows, [*cells, "size"], bits, counted=counted), ["_curve", "text_crc32", "_md5", "_id", "_tie"], n_shards)
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot", F.col("_curve").alias("curve_index"),
        *[F.col(n).alias(d) for n, d in zip(names, [*dims, *keep], strict=True)],
    )
