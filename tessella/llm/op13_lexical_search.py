"""Ranked lexical search by sort-based accumulation: the best documents of all for each item of a query set.

1. One pass over the documents finds the items' terms in them (64-bit hashes, then byte for byte) and keeps, of each
   document, its length and the terms with their occurrences. That table is written to the shared folder.
2. Its sums give the number of documents, of terms and of documents for each term: the weights.
3. Each task joins its documents' terms with the items that hold them to arrays of (item, document, impact), in slices
   of bounded size, sorts the packed keys digit by digit (radix), and adds the impacts of equal keys (``reduceat``).
   A heap for each item keeps the best so far; what is below its least is passed over.
4. The tasks' best, some for each item, are range-partitioned by item and by a salt; heaps select again within the
   ranges, and what is left, a few rows for each item and range, is ranked.

Documents stay where they are: no pair of item and document is shuffled unless it is among a task's best. Items come in
blocks of about ``BLOCK_TERMS`` terms, one block on the driver at a time, each with a pass of its own.

Defined results: null and empty texts, of documents or items, have no terms and no rows; a very long text is one row of
its matched terms (its words are worked on whole, some tens of bytes of memory for each of its bytes). Equal scores go by
ascending id, a null id last; rows that repeat are ranked each. Items that repeat are ranked each. An empty table gives
an empty result. Ids of documents are integers. Only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._store import cut, in_batches
from ._words import NOT_WORD, HashIndex, hashes, lowered, row_slices, runs, same_bytes, spans, text_bytes

#: Terms of the items that are on the driver, and in a task, at once.
BLOCK_TERMS = 1_000_000
#: (item, document, impact) entries that are sorted at once; one document may have more, up to a block's terms.
AREA = 1_000_000
SALTS = 64

# fixed values of the score
FREQUENCY_SCALE, TERM_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50


@dataclass
class Items:
    """A block of items: distinct terms as bytes, and for each term the items that hold it, in the order of ``ids``."""

    ids: list
    bytes: np.ndarray
    firsts: np.ndarray
    ends: np.ndarray
    item_first: np.ndarray  # term t is in items[item_first[t]:item_first[t + 1]]
    items: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return hashes(self.bytes, self.firsts, self.ends, lower=True)


def _block(ids: list, texts: list[str]) -> Items | None:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = spans(data, offsets, NOT_WORD)
    low = lowered(data)
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(low[a:b].tobytes(), len(number)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)], np.int64)
    if not len(of):
        return None
    term, item = np.divmod(np.unique(of * len(ids) + words.row_of()), len(ids))
    sizes = np.array([len(t) for t in number])
    return Items(ids, np.frombuffer(b"".join(number), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes), np.searchsorted(term, np.arange(len(number) + 1)), item)


def item_blocks(queries: DataFrame, item_id: str, item_text: str, block: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items in blocks of bounded size. No block has over 65,535 items, so that a key has 16 bits for them."""
    ids: list = []
    texts: list[str] = []
    room = block
    for r in queries.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        room -= len(r["t"]) // 2 + 1
        if room <= 0 or len(ids) == (1 << 16) - 1:
            if got := _block(ids, texts):
                yield got
            ids, texts, room = [], [], block
    if texts and (got := _block(ids, texts)):
        yield got


def postings(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """_id, n (terms of the document, with repeats), terms (numbers of the items' terms in it) and tf."""
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n_terms = HashIndex(items.keys), len(items.firsts)
        for b in row_slices(batches, "_text"):
            data, offsets = text_bytes(b.column("_text"))
            words = spans(data, offsets, NOT_WORD)
            term = index.find(hashes(data, words.starts, words.ends, lower=True))
            hit = np.flatnonzero(term >= 0)
            t = term[hit]
            true = same_bytes(lowered(data), words.starts[hit], words.ends[hit], items.bytes, items.firsts[t], items.ends[t])
            key, tf = np.unique(words.row_of()[hit[true]] * n_terms + t[true], return_counts=True)
            row, t = np.divmod(key, n_terms)
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (t, tf)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(np.diff(words.rows), pa.int64()), *lists], names=["_id", "n", "terms", "tf"])

    return in_batches(slim, run, "_id long, n long, terms array<int>, tf array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms; whole numbers of any size where the product passes 64 bits."""
    if len(n) and LENGTH_SHARE * int(n.max()) * documents >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * documents // terms for x in n.tolist()], np.int64)
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // max(terms, 1)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of unsigned keys by stable passes over their 16-bit digits (numpy sorts those by radix); idle digits are skipped."""
    order, top, shift = np.arange(len(keys)), int(keys.max()) if len(keys) else 0, 0
    while top >> shift:
        digit = (keys >> np.uint64(shift)).astype(np.uint16)[order]
        if shift or (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, sum of impacts) of each pair that occurs, by item and document."""
    keys = item.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(impact[order], first) if len(first) else impact


class Best:
    """The ``top`` best (score, id) of each item, as heaps; equal scores by ascending id, null (``None``) last."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)

    def offer(self, item: np.ndarray, ids: np.ndarray, missing: np.ndarray, score: np.ndarray) -> None:
        """``ids``: integers, at ``missing`` of no meaning."""
        on = np.flatnonzero((score > 0) & (score >= self.least[item]))
        if not len(on):
            return
        on = on[np.lexsort((ids[on], missing[on], -score[on], item[on]))]
        of = item[on]
        on = on[np.arange(len(on)) - np.searchsorted(of, of) < self.top]  # no more of an item can stay
        for i, d, none, s in zip(item[on].tolist(), ids[on].tolist(), missing[on].tolist(), score[on].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, 0 if none else 1, 0 if none else -d)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        every = [(i, -d if there else None, s) for i, heap in enumerate(self.heaps) for s, there, d in heap]
        return tuple(list(x) for x in zip(*every, strict=True)) if every else ([], [], [])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def best_of_tasks(found: DataFrame, items: Items, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    """_item, _id and score: of each task's documents the best for each item."""
    held = np.diff(items.item_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), top)
        for b in batches:
            ids, missing = _ids(b.column("_id"))
            lists = b.column("terms")
            at = lists.offsets.to_numpy().astype(np.int64)
            at, term, tf = at - at[0], lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy().astype(np.int64)
            if not len(term):
                continue
            m = length_norm(b.column("n").to_numpy(), documents, terms)
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            impact = weights[term] * (FREQUENCY_SCALE * tf // (TERM_SCALE * tf + LENGTH_SCALE * m[doc]))
            before = np.concatenate([[0], np.cumsum(held[term])])[at]  # entries before each document
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + AREA, "right")) - 1)
                mine = slice(at[lo], at[hi])
                t = term[mine]
                of = items.items[runs(items.item_first[t], held[t])]
                i, d, score = accumulated(of, np.repeat(doc[mine], held[t]), np.repeat(impact[mine], held[t]))
                best.offer(i, ids[d], missing[d], score)
                lo = hi
        item, ids, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["_item", "_id", "score"])

    return in_batches(found, run, "_item long, _id long, score long")


def best_of_ranges(found: DataFrame, items: int, top: int) -> DataFrame:
    """The rows of ``found`` that can be among the best of their item, selected within ranges of (item, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for b in batches:
            best.offer(b.column("_item").to_numpy(), *_ids(b.column("_id")), b.column("score").to_numpy())
        item, ids, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["_item", "_id", "score"])

    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_id", "score"), F.lit(SALTS)))
    return in_batches(salted.repartitionByRange("_item", "_salt").select("_item", "_id", "score"), run, "_item long, _id long, score long")


def search(
    docs: DataFrame, queries: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    block: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank (from 1), the document's id and its score: the ``top`` best documents of each item with a score above 0."""
    kind, spark, out = queries.schema[item_id].dataType, docs.sparkSession, None
    for items in item_blocks(queries, item_id, item_text, block):
        found = cut(postings(docs, items, id_col, text_col), narrow=True)
        totals = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        holding = np.zeros(len(items.firsts), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the block at most
            holding[r["term"]] = r["count"]
        weights = np.array([weight(totals["documents"], h) for h in holding.tolist()], np.int64)
        tasks = cut(best_of_tasks(found.where(F.size("terms") > 0), items, weights, totals["documents"], totals["terms"], top))
        ranked = best_of_ranges(tasks, len(items.ids), top)
        order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(pa.table({"_item": pa.array(range(len(items.ids)), pa.int64()), "_name": pa.array(items.ids, to_arrow_type(kind))}))
        ranked = ranked.join(F.broadcast(names), "_item")  # 65,535 rows at most
        ranked = ranked.select(F.col("_name").cast(kind).alias(item_id), "rank", F.col("_id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, {id_col} long, score long")
    return out
