"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

1. Items and texts become sequences of normalised words (lower-cased runs of letters and digits).
2. Windows of the items' sizes are taken from every text wherever they can hold an item within the allowed edits: with
   at most e edits on n words, one of e + 1 pieces is left whole, so item and window share a run of ``SEED`` words
   (allowed edits are kept low enough for that). Windows without such a run can't match and aren't embedded.
3. The random walk of Chakraborty, Goldenberg and Koucky copies a symbol in each of 3n steps and advances on a random
   bit of (step, symbol); sequences at small edit distance mostly run in step and differ in few places.
4. LSH samples ``BITS`` places for each table. How many tables reach ``target_recall`` at the largest allowed distance
   is measured on each block's items, for each octave of sizes, with seeded random edits; if ``MOST_TABLES`` don't, that
   is an error.
5. Windows that share a table's key with an item are verified: the least edit distance of the item to any run of words
   round the window, exactly.

Benchmarks are taken in blocks of about ``BLOCK_WORDS`` words, a pass over the texts for each, so that what a task
holds has a bound. Embeddings are made for so many windows at once as have ``AREA`` steps together.

Defined results: null and empty texts have no matches; items of fewer than ``MIN_WORDS`` words allow no edit and are
found word for word; items without words match nothing; equal items are all reported, a null item id as null; ids may
be of any type; repeated rows are reported each; empty tables give no rows. Very long texts are read whole, one at a
time; a very long item takes memory in proportion to its length. Extra columns, whatever their names, are carried by
``without_items`` and ignored by ``contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._store import in_batches
from ._words import NOT_WORD, HashIndex, hashes, mix, row_slices, spans, text_bytes, windows

SEED = 3
MIN_WORDS = 5
BITS = 4
WALKS = 4
#: Tables that are measured first, and the most that are tried.
TABLES, MOST_TABLES = 96, 1536
EDIT_RATE = 0.2
BLOCK_WORDS = 500_000
#: Windows that are looked up at once, and steps of embeddings and seed hits that are held at once.
CHUNK, AREA = 4096, 2_000_000

_GEN = np.random.Generator(np.random.PCG64(1234))
_WALK = _GEN.integers(0, 2**63, WALKS, dtype=np.uint64)
_TABLE_PLACES = _GEN.random((MOST_TABLES, BITS))
_PAD = np.uint64(0x5041440000000001)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pc.utf8_lower(column))
    s = spans(data, offsets, NOT_WORD)
    return hashes(data, s.starts, s.ends), s.rows


def allowed_edits(n: int, rate: float = EDIT_RATE) -> int:
    """At most ``rate`` of the words, and few enough that a run of SEED words stays whole."""
    return max(0, min(int(n * rate + 1e-9), n // SEED - 1))


def embed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of the windows (sizes falling): window x step."""
    steps = 3 * int(sizes[0])
    out = np.full((len(starts), steps), _PAD, np.uint64)
    at = np.zeros(len(starts), np.int64)
    salt = _WALK[walk] + np.arange(steps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(steps):
        m = int(np.searchsorted(-sizes, -(j / 3), "left"))  # windows whose 3n steps aren't over
        inside = at[:m] < sizes[:m]
        symbol = np.where(inside, words[np.minimum(starts[:m] + at[:m], len(words) - 1)], _PAD)
        out[:m, j] = symbol
        at[:m] += (mix(symbol ^ salt[j]) & np.uint64(1)).astype(np.int64)
    return out


def _areas(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of the falling ``sizes`` whose embeddings have about AREA steps at most, or are one window's."""
    lo = 0
    while lo < len(sizes):
        hi = min(len(sizes), lo + max(1, AREA // (3 * int(sizes[lo]))))
        yield lo, hi
        lo = hi


def table_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tables: int) -> np.ndarray:
    """window x table: hash of the sampled places of the embedding, of the window's size and of the table."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros((len(starts), tables), np.uint64)
    for lo, hi in _areas(sizes[order]):
        mine = order[lo:hi]
        begin, size = starts[mine], sizes[mine]
        for walk in range(min(WALKS, tables)):
            image = embed(words, begin, size, walk)
            for t in range(walk, tables, WALKS):
                key = size.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t)
                for u in _TABLE_PLACES[t]:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + image[np.arange(len(mine)), (u * 3 * size).astype(np.int64)])
                out[mine, t] = key
    return out


def tables_for(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rate: float, target_recall: float, trials: int = 400) -> int:
    """Tables that let a window at the largest allowed distance share a key with its item with ``target_recall``."""
    rng = np.random.Generator(np.random.PCG64(99))
    flat, begin, size, of = [], [], [], []
    at = 0
    for x in rng.integers(0, len(starts), max(20, min(trials, AREA // (3 * int(sizes.max()))))):
        n = int(sizes[x])
        w = words[starts[x] : starts[x] + n].tolist()
        for _ in range(allowed_edits(n, rate)):
            place, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[place : place + (kind != 2)] = [] if kind == 1 else [int(rng.integers(0, 2**63))]
        w = np.array([*w, *rng.integers(0, 2**63, n).tolist()][:n], np.uint64)
        flat.append(w)
        begin.append(at)
        size.append(n)
        of.append(x)
        at += n
    most = TABLES
    while most <= MOST_TABLES:
        edited = table_keys(np.concatenate(flat), np.array(begin), np.array(size), most)
        items = table_keys(words, starts[of], sizes[of], most)
        share = (np.cumsum(edited == items, axis=1) > 0).mean(axis=0)
        enough = np.flatnonzero(share >= target_recall)
        if len(enough):
            return int(enough[0]) + 1
        most *= 2
    raise ValueError(f"{MOST_TABLES} tables find {share[-1]:.3f} of the items, not {target_recall}")


@dataclass
class Items:
    """Distinct items of a block: their words, the ids behind each, their runs of SEED words and their LSH keys."""

    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ids: list[list]
    rate: float
    target_recall: float

    def __post_init__(self) -> None:
        octave = np.where(self.sizes >= MIN_WORDS, np.frexp(self.sizes)[1], 0)  # 0: found word for word
        self.octaves: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}  # items, tables, their keys
        self.seed_keys, self.seed_first = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.seed_at = self.seed_size = np.zeros(0, np.int64)
        for o in sorted(set(octave.tolist()) - {0}):
            mine = np.flatnonzero(octave == o)
            tables = tables_for(self.words, self.starts[mine], self.sizes[mine], self.rate, self.target_recall)
            self.octaves[o] = mine, tables, table_keys(self.words, self.starts[mine], self.sizes[mine], tables)
        if self.octaves:
            keys, at = windows(self.words, np.append(self.starts, len(self.words)), SEED)
            item = np.searchsorted(self.starts, at, "right") - 1
            keys, at, item = (x[self.sizes[item] >= MIN_WORDS] for x in (keys, at, item))
            # where a seed stands and in items of which size is all that windows need
            at, size = at - self.starts[item], self.sizes[item]
            order = np.lexsort((size, at, keys))
            keys, at, size = keys[order], at[order], size[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1]) | (size[1:] != size[:-1]))
            keys, self.seed_at, self.seed_size = keys[new], at[new], size[new]
            self.seed_keys, first = np.unique(keys, return_index=True)
            self.seed_first = np.append(first, len(keys))
        self.edits = np.array([allowed_edits(n, self.rate) if n >= MIN_WORDS else 0 for n in range(int(self.sizes.max()) + 1)])


class Lookup:
    """The tables of a block in a task: seeds, keys of each LSH table, and short items by their words' hash."""

    def __init__(self, items: Items):
        self.seeds = HashIndex(items.seed_keys)
        self.tables = {o: [_postings(keys[:, t], mine) for t in range(tables)] for o, (mine, tables, keys) in items.octaves.items()}
        self.short = {}
        for n in range(1, MIN_WORDS):
            own = np.flatnonzero(items.sizes == n)
            if len(own):
                flat = np.concatenate([items.words[items.starts[x] : items.starts[x] + n] for x in own])
                keys, _ = windows(flat, np.arange(len(own) + 1) * n, n)
                self.short[n] = _postings(keys, own)


def _postings(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct keys in order, where each one's values begin, the values)."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return own, np.append(first, len(order)), values[order]


def _find(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in the rising ``own``, -1 where there is none."""
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[at] == keys, at, -1)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float, target_recall: float) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; one block at a time is on the driver."""
    slim = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ids: list = []
    texts: list[str] = []
    room = BLOCK_WORDS

    def block() -> Items | None:
        words, rows = words_of(pa.array(texts, pa.string()))
        found: dict[bytes, list] = {}
        for i, lo, hi in zip(ids, rows[:-1], rows[1:], strict=True):
            if hi > lo:
                found.setdefault(words[lo:hi].tobytes(), []).append(i)
        if not found:
            return None
        flat = np.frombuffer(b"".join(found), np.uint64)
        sizes = np.array([len(k) // 8 for k in found])
        return Items(flat, np.cumsum(sizes) - sizes, sizes, [sorted(x, key=lambda v: (v is None, v)) for x in found.values()], rate, target_recall)

    for r in slim.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        room -= len(r["t"]) // 2 + 1
        if room <= 0:
            if got := block():
                yield got
            ids, texts, room = [], [], BLOCK_WORDS
    if texts and (got := block()):
        yield got


def fitting_distance(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the run of ``text`` that is nearest to ``item``, or None if all need over ``limit``."""
    m = len(text)
    ramp = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, np.int64), ramp.copy()
    for x in item:
        diag = cost[:-1] + (text != x)
        up = cost[1:] + 1
        now = np.concatenate([[cost[0] + 1], np.minimum(diag, up)])
        first = np.concatenate([[begin[0]], np.where(diag <= up, begin[:-1], begin[1:])])
        lead = np.minimum.accumulate(now - ramp)
        source = np.maximum.accumulate(np.where(now - ramp == lead, ramp, 0))
        cost, begin = lead + ramp, first[source]
        if cost.min() > limit:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def seed_windows(words: np.ndarray, rows: np.ndarray, items: Items, seeds: HashIndex) -> np.ndarray:
    """(start, size, row) of the windows in which a seed stands where it does in an item of this size."""
    grams, at = windows(words, rows, SEED)
    place = seeds.find(grams)
    hit = np.flatnonzero(place >= 0)
    ends = np.cumsum(items.seed_first[place[hit] + 1] - items.seed_first[place[hit]])
    found, lo = [np.zeros((0, 3), np.int64)], 0
    while lo < len(hit):  # a seed that many items share is followed in pieces
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AREA, "right")))
        mine = hit[lo:hi]
        first = items.seed_first[place[mine]]
        count = items.seed_first[place[mine] + 1] - first
        flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        size, start = items.seed_size[flat], np.repeat(at[mine], count) - items.seed_at[flat]
        row = np.searchsorted(rows, np.repeat(at[mine], count), "right") - 1
        start = np.clip(start, rows[row], np.maximum(rows[row], rows[row + 1] - size))
        fits = rows[row + 1] - rows[row] >= size - items.edits[size]
        found.append(np.unique(np.stack([start[fits], size[fits], row[fits]], 1), axis=0))
        lo = hi
    return np.unique(np.concatenate(found), axis=0) if len(found) > 2 else found[-1]


def _sharing(own: np.ndarray, size: int, near: np.ndarray, items: Items) -> list[int]:
    """Of the items ``own``, all of ``size`` words, those that can fit: all words but the allowed edits occur in ``near``."""
    if len(own) < 8:
        return own.tolist()
    step, near, out = max(1, AREA // size), np.unique(near), []
    for lo in range(0, len(own), step):
        mine = own[lo : lo + step]
        flat = items.words[items.starts[mine][:, None] + np.arange(size)]
        there = near[np.minimum(np.searchsorted(near, flat), len(near) - 1)] == flat
        out += mine[there.sum(axis=1) >= size - items.edits[size]].tolist()
    return out


def matches(words: np.ndarray, rows: np.ndarray, items: Items, lookup: Lookup) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, end word, edits) of all matches in these texts."""
    exact = []
    for n, (known, first, own) in lookup.short.items():
        keys, at = windows(words, rows, n)
        x = _find(known, keys)
        for y in np.flatnonzero(x >= 0).tolist():
            r = int(np.searchsorted(rows, at[y], "right")) - 1
            for z in own[first[x[y]] : first[x[y] + 1]].tolist():
                if (words[at[y] : at[y] + n] == items.words[items.starts[z] : items.starts[z] + n]).all():
                    exact.append((r, z, int(at[y] - rows[r]), int(at[y] - rows[r]) + n, 0))
    edits = items.edits
    pairs = seed_windows(words, rows, items, lookup.seeds)
    found: set[tuple[int, int, int]] = set()
    padded = np.append(words, np.full(int(items.sizes.max()) + 1, _PAD, np.uint64)) if len(pairs) else words
    octave = np.frexp(pairs[:, 1])[1]
    pieces = [(o, mine[lo : lo + CHUNK]) for o in lookup.tables for mine in [pairs[octave == o]] for lo in range(0, len(mine), CHUNK)]
    for o, piece in pieces:
        begin, n, of = piece.T
        got = table_keys(padded, begin, n, len(lookup.tables[o]))
        for t, (known, first, own) in enumerate(lookup.tables[o]):
            x = _find(known, got[:, t])
            for y in np.flatnonzero(x >= 0).tolist():
                r, lo_, size = int(of[y]), int(begin[y]), int(n[y])
                near = words[max(int(rows[r]), lo_ - int(edits[size])) : min(int(rows[r + 1]), lo_ + size + int(edits[size]))]
                found.update((r, z, lo_) for z in _sharing(own[first[x[y]] : first[x[y] + 1]], size, near, items))
    out, last = [], (-1, -1, -1)
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for r, x, begin in sorted(found):
        n, e = int(items.sizes[x]), int(edits[items.sizes[x]])
        if (r, x) == last[:2] and begin - last[2] <= e:
            last = (r, x, begin)  # the window before looked at this run as well
            best[r, x][-1] = (best[r, x][-1][0], begin, n)
        else:
            best.setdefault((r, x), []).append((begin, begin, n))
            last = (r, x, begin)
    for (r, x), groups in best.items():
        e = int(edits[items.sizes[x]])
        for lo, hi, n in groups:
            a, b = max(int(rows[r]), lo - e), min(int(rows[r + 1]), hi + n + e)
            own = items.words[items.starts[x] : items.starts[x] + n]
            if fit := fitting_distance(own, words[a:b], e):
                out.append((r, x, a + fit[1] - int(rows[r]), a + fit[2] - int(rows[r]), fit[0]))
    return sorted({*out, *exact})


def scan(docs: DataFrame, items: Items, carry: list[str], text_col: str, kind: T.DataType) -> DataFrame:
    """``carry`` and ``matches``, an array of (item, first word, end word, edits), for one block of items with ids of ``kind``."""
    names = [*carry, *([] if text_col in carry else [text_col])]
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    text = f"_c{names.index(text_col)}"
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))] + [f"matches array<struct<item:{kind.simpleString()},first:long,end:long,edits:long>>"])
    of = pa.list_(pa.struct([("item", to_arrow_type(kind)), *((n, pa.int64()) for n in ("first", "end", "edits"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(items)
        for b in row_slices(batches, text):
            words, rows = words_of(b.column(text))
            lists: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for r, x, lo, hi, d in matches(words, rows, items, lookup):
                lists[r] += [{"item": i, "first": lo, "end": hi, "edits": d} for i in items.ids[x]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(lists, of)], names=[*(f"_c{i}" for i in range(len(carry))), "matches"])

    return in_batches(slim, run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "matches")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, target_recall: float = 0.95,
) -> DataFrame:
    """One row for each match: id, item_id, first_word, end_word (of the normalised words), edits."""
    kind = benchmark.schema[item_id].dataType
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {kind.simpleString()}, first_word long, end_word long, edits long"
    out = None
    for items in item_blocks(benchmark, item_id, item_text, rate, target_recall):
        rows = scan(docs, items, [id_col], text_col, kind).select(id_col, F.explode("matches").alias("m"))
        rows = rows.select(
            id_col, F.col("m.item").alias("item_id"), F.col("m.first").alias("first_word"), F.col("m.end").alias("end_word"), F.col("m.edits").alias("edits")
        )
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_items(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, target_recall: float = 0.95,
) -> DataFrame:
    """The rows of ``docs``, with their columns, whose texts hold no item: a pass for each block, no shuffle."""
    names = docs.columns
    for items in item_blocks(benchmark, item_id, item_text, rate, target_recall):
        docs = scan(docs, items, names, text_col, benchmark.schema[item_id].dataType).where(F.size("matches") == 0).select(*names)
    return docs
