"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact token length.
2. Target weights share the budget among sources; a source's target stops at ``max_repeats`` times its size and the
   excess is shared again by weight. Sources are a table of their own: they are numbered in order, and each round of
   sharing is one sum over them.
3. A source takes all its documents as often as its target allows whole passes. What is left is fitted on the length
   counts: a like share of each length's documents, then a bounded-knapsack dynamic program over lengths for the rest.
4. Of each length the documents with the least seeded hash (of id, length and text) are taken. Ranges of the hash keep a
   length that holds most rows of a source out of one task; rows that are equal in all of this are counted, not ranked.

Defined results: a null text has size 0; null sources are one source, last in order; documents of size 0 are taken
with the whole passes and their like share; repeated rows are documents of their own (which of several equal rows is
taken does not show); null ids are told apart by their texts; of a very long text only its length and hash are used (the
dynamic program holds four bytes and a few bits for each sum up to five times the longest document, or 1.3 million); an empty table gives an empty result. Columns that aren't
named by the caller are carried by ``mixed`` and ignored by ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._order import indexed
from ._store import cut

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
#: Ranges of the hash, of about so many rows each (of all sources and lengths together) and 256 at least.
RANGE_ROWS = 1 << 20
#: Bits of the dynamic program's table (four times the longest document, if that is more); a larger rest is first
#: brought down with the longest documents left.
TABLE_BITS = 1 << 20
#: A row of a source has a name and two numbers: some 10 MB at most.
BROADCAST_SOURCES = 100_000


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """``sources`` (_source, _source_size) with _target: shares of the budget by weight in the order of names, null last.

    Each round finds what a weight of 1 gets if the sources that had too much in the round before stop at their most;
    it can only rise, so the rounds end when no more sources stop.
    """
    named = sources.withColumn("_none", F.col("_source").isNull())
    own, _ = indexed(named, ["_none", "_source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_idx") % len(weights) + 1).cast("int"))
    own = cut(own.select("_source", "_source_size", weight.alias("_weight"), (F.col("_source_size") * max_repeats).alias("_most")), dealt=True)
    total = own.agg(F.sum("_source_size").alias("s"), F.sum("_weight").alias("w")).first()
    per = share * total["s"] / total["w"] if total["w"] else 0.0
    while True:
        over = F.col("_weight") * per > F.col("_most")
        r = own.agg(F.sum(F.when(over, F.col("_most"))).alias("s"), F.sum(F.when(~over, F.col("_weight"))).alias("w")).first()
        new = (share * total["s"] - (r["s"] or 0)) / r["w"] if r["w"] else per
        if new == per:
            return own.select("_source", "_source_size", F.when(over, F.col("_most").cast("double")).otherwise(F.col("_weight") * per).alias("_target"))
        per = new


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take: of all sums that can be made, the one nearest to ``budget`` (the lower of two).

    ``reach`` has bit s set if the sum s can be made; sums beyond budget + longest length can't be nearest. Counts are
    split into powers of two, so that an item is either taken or not. Each sum keeps the step that first made it: what
    that step added to was made by earlier ones, so that these lead back from the best sum to the items. It ends early
    once the budget itself can be met.
    """
    taken, most = [0] * len(lengths), budget + max(lengths, default=0)
    reach, mask = 1, (1 << most + 1) - 1
    steps: list[tuple[int, int]] = []
    made_by = np.full(most + 1, -1, np.int32)
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        part, left = 1, min(count, most // length) if length > 0 else 0
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            more = reach | reach << part * length & mask
            if more != reach:
                made_by[_set_bits(more ^ reach)] = len(steps)
                steps.append((i, part))
                reach = more
            left -= part
            part *= 2
        if reach >> budget & 1:
            break
    at, above = (reach & (1 << budget + 1) - 1).bit_length() - 1, reach >> budget + 1
    if above and (above & -above).bit_length() < budget - at:
        at = budget + (above & -above).bit_length()
    while at:
        i, part = steps[made_by[at]]
        taken[i] += part
        at -= part * lengths[i]
    return taken


def _set_bits(number: int) -> np.ndarray:
    """The places of a number's bits that are set."""
    octets = np.frombuffer(number.to_bytes(number.bit_length() + 7 >> 3, "little"), np.uint8)
    full = np.flatnonzero(octets)
    of, bit = np.nonzero(np.unpackbits(octets[full, None], axis=1, bitorder="little"))
    return full[of] * 8 + bit


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length come nearest to ``budget`` words in all."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:  # only by rounding
        return list(counts)
    out = [c * budget // total for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, out, strict=True))
    by_length = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])
    room = max(TABLE_BITS, 4 * max(lengths))
    for i in by_length:
        if rest < room:
            break
        more = min(counts[i] - out[i], (rest - room // 2) // lengths[i])
        out[i] += max(0, more)
        rest -= max(0, more) * lengths[i]
    for i, k in zip(by_length, knapsack([lengths[i] for i in by_length], [counts[i] - out[i] for i in by_length], rest), strict=True):
        out[i] += k
    return out


def token_sizes(docs: DataFrame, text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each document: id, source, ``keep``, size, source_size, target, copies, taken (copies * size)."""
    names = [f"_k{i}" for i in range(len(keep))]
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        token_sizes(docs, text_col).alias("_size"),
        F.xxhash64(text_col).alias("_text"),
        F.spark_partition_id().alias("_p"),
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
    )
    slim = cut(slim.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id").cast("string"), "_size", "_text")).drop("_text"), narrow=True)
    # a range has the rows with the same first bits of the hash, so that how many ranges there are doesn't change the order
    bits = max(8, (slim.count() // RANGE_ROWS).bit_length())
    slim = slim.withColumn("_b", F.shiftright("_h", 64 - bits).cast("int"))
    own = ["_source", "_size", "_b", "_h", "_id", *names, "_p"]
    equal = cut(slim.groupBy(*own).agg(F.count(F.lit(1)).alias("_m")), dealt=True)
    per_bucket = cut(equal.groupBy("_source", "_size", "_b").agg(F.sum("_m").alias("_n")), dealt=True)
    lengths = per_bucket.groupBy("_source", "_size").agg(F.sum("_n").alias("_n"))
    sources = cut(lengths.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size")), dealt=True)
    plan = with_targets(sources, weights, share, max_repeats)
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_size")
        size, target = int(part["_source_size"].iloc[0]), float(part["_target"].iloc[0])
        passes = int(target // size) if size else 0
        taken = fit(part["_size"].tolist(), part["_n"].tolist(), round(target) - passes * size)
        return part.assign(_passes=passes, _quota=taken)[["_source", "_size", "_source_size", "_target", "_passes", "_quota"]]

    plan = plan.withColumnRenamed("_source", "_of")
    with_plan = lengths.join(F.broadcast(plan) if few else plan, lengths["_source"].eqNullSafe(F.col("_of"))).drop("_of")
    kind = slim.schema["_source"].dataType.simpleString()
    quota = with_plan.groupBy("_source").applyInPandas(
        quotas, f"_source {kind}, _size long, _source_size long, _target double, _passes long, _quota long"
    )
    quota = quota.select(F.col("_source").alias("_qs"), F.col("_size").alias("_qz"), "_source_size", "_target", "_passes", "_quota")
    order = Window.partitionBy("_source", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    share_in = before.join(quota, before["_source"].eqNullSafe(quota["_qs"]) & (before["_size"] == quota["_qz"])).select(
        F.col("_source").alias("_qs"), F.col("_size").alias("_qz"), F.col("_b").alias("_qb"), "_source_size", "_target", "_passes",
        F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_quota") - F.col("_before"))).alias("_here"),
    )
    first = Window.partitionBy("_source", "_size", "_b").orderBy("_h", "_id", *names, "_p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("_first", F.coalesce(F.sum("_m").over(first), F.lit(0)))
    out = ranked.join(
        share_in,
        ranked["_source"].eqNullSafe(share_in["_qs"]) & (ranked["_size"] == share_in["_qz"]) & (ranked["_b"] == share_in["_qb"]),
    )
    # equal rows of one input partition come back as so many rows
    out = out.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_m")))
    copies = F.col("_passes") + (F.col("_first") + F.col("_nth") <= F.col("_here")).cast("long")
    return out.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with their columns, as often as the mix takes them (0 to max_repeats times).

    Copies are summed by id, source and text and dealt out to the rows that have these, so that repeated rows get as
    many copies together as the mix gave them.
    """
    names = docs.columns
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    took = mix(docs.withColumn("_key", key), id_col, source_col, text_col, keep=["_key"], **how)
    took = took.groupBy(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), F.col("_key").alias("_md5")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("_row"))
    own, src, text = (F.col(f"_c{names.index(c)}") for c in (id_col, source_col, text_col))
    slim = slim.withColumn("_k", F.md5(F.coalesce(text, F.lit("")).cast("binary"))).withColumn("_own", own).withColumn("_of", src)
    joined = slim.join(took, slim["_own"].eqNullSafe(took["_id"]) & slim["_of"].eqNullSafe(took["_src"]) & (slim["_k"] == took["_md5"]))
    # rows that share id, source and text are told apart only where there are several: numbered by input partition first
    single = joined.where("_rows = 1").withColumn("_n", F.col("_copies"))
    several = joined.where("_rows > 1").withColumn("_p", F.shiftright("_row", 33))
    key = ["_own", "_of", "_k"]
    parts = several.groupBy(*key, "_p").agg(F.count(F.lit(1)).alias("_in"))
    earlier = F.sum("_in").over(Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"_j{c}") for c in (*key, "_p")], F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    several = several.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_p").orderBy("_row")))
    several = several.join(parts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in (*key, "_p")]))
    several = several.withColumn("_n", F.expr("_copies div _rows + if(_earlier + _nth <= _copies % _rows, 1, 0)"))
    cols = [f"_c{i}" for i in range(len(names))]
    times = single.select(*cols, "_n").unionByName(several.select(*cols, "_n")).where("_n > 0")
    times = times.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return times.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
