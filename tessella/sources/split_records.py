"""Records of CSV files with line feeds in fields, and elements of JSON arrays, read from any number of splits of a file.

Where a record begins depends on all that stands before it: whether a quote is open, how many brackets are. Files are
therefore read in three steps, each in Spark's own splits of its text source (so any store that Spark reads will do):

1. Each split says what it does to that state, whatever the state is at its begin: whether its quotes are odd in
   number, and by how much brackets deepen if it begins outside and inside of a string. A row for each split.
2. A window over a file's splits composes these to the state at the begin of each; it goes back to the splits' rows by a
   broadcast (a row for each split, ``MOST_SPLITS`` at most).
3. With its state, a split cuts its own bytes into records. What a record begun in one split lacks stands at the
   begin of the next ones: these pieces, two for each split at most, are put together by a small shuffle.

Bytes are looked at as whole arrays; a task holds a batch and one record. The splits are read three times, the third time
for the pieces only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_SPLITS = 1_000_000
WHOLE, GOES_ON, BEGINS, BEGINS_HEADER = 0, 1, 2, 3
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
_KEY_ROOM = 1024  # bytes before an opening bracket in which its key is looked for


@dataclass(frozen=True)
class State:
    """What is open where a split begins: a quote, so many brackets, the array whose elements are wanted."""

    inside: bool
    depth: int
    wanted: bool


class Csv:
    """Records end at line feeds outside of quotes. Quotes within a field are doubled, and only quoted fields have any."""

    separator = b"\n"

    def summary(self, data: np.ndarray) -> tuple[int, list[int], list[dict[int, bool]]]:
        return int((data == 0x22).sum() & 1), [0, 0], [{}, {}]

    def cut(self, data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        inside = (np.cumsum(data == 0x22) + state.inside) & 1 == 1
        ends = np.flatnonzero((data == 0x0A) & ~inside) + 1
        starts = ends if state.inside else np.append(0, ends)  # the first end closes what is open
        return starts[starts < len(data)], ends, State(bool(inside[-1]), 0, True)


class Json:
    """Elements are the objects of an array: the file's own, or that under ``key`` of the file's object."""

    separator = b"}"

    def __init__(self, key: str | None = None):
        self.key, self.level = key, 1 if key is None else 2

    def _brackets(self, data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """(positions of brackets outside of strings, depth after each from 0, whether a string is open at the end)."""
        quote = np.flatnonzero(data == 0x22)
        if len(quote):
            plain = np.where(data == 0x5C, -1, np.arange(len(data)))
            before = np.append(-1, np.maximum.accumulate(plain))[quote]  # last byte before that is no backslash
            quote = quote[(quote - 1 - before) % 2 == 0]
        at = np.flatnonzero((data == 0x7B) | (data == 0x5B) | (data == 0x7D) | (data == 0x5D))
        at = at[(np.searchsorted(quote, at) + inside) % 2 == 0]
        return at, np.cumsum(np.where((data[at] == 0x7B) | (data[at] == 0x5B), 1, -1)), bool((len(quote) + inside) & 1)

    def _is_wanted(self, data: np.ndarray, at: int) -> bool:
        """Whether the bracket opens the wanted array, if it stands at the right depth."""
        if data[at] != 0x5B or self.key is None:
            return bool(data[at] == 0x5B)
        found = _KEY.search(data[max(0, at - _KEY_ROOM) : at].tobytes())
        return bool(found) and found[1].decode(errors="replace") == self.key

    def summary(self, data: np.ndarray) -> tuple[int, list[int], list[dict[int, bool]]]:
        """Oddness of quotes; by the state at the begin: change of depth; by relative depth whether what opened there last is wanted."""
        deltas, opened, odd = [], [], 0
        for inside in (False, True):
            at, depth, end = self._brackets(data, inside)
            odd = int(end ^ inside)
            deltas.append(int(depth[-1]) if len(depth) else 0)
            on = np.flatnonzero((data[at] == 0x7B) | (data[at] == 0x5B))[::-1]
            level, first = np.unique(depth[on] - 1, return_index=True)
            opened.append({int(x): self._is_wanted(data, int(at[on[i]])) for x, i in zip(level, first, strict=True)})
        return odd, deltas, opened

    def cut(self, data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        at, depth, inside = self._brackets(data, state.inside)
        depth = depth + state.depth
        opens = (data[at] == 0x7B) | (data[at] == 0x5B)
        outer = np.flatnonzero(opens & (depth == self.level))  # containers of the right depth
        wanted = np.array([state.wanted, *(self._is_wanted(data, int(x)) for x in at[outer])])
        own = wanted[np.searchsorted(outer, np.arange(len(at)), "right")]
        starts = at[own & (data[at] == 0x7B) & (depth == self.level + 1)]
        ends = at[own & (data[at] == 0x7D) & (depth == self.level)] + 1
        return starts, ends, State(inside, int(depth[-1]) if len(depth) else state.depth, bool(wanted[-1]))


def _of_splits(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[tuple, dict, np.ndarray]]:
    """(file and block, first row of its other columns, bytes) of each run of a batch that is of one split."""
    for b in batches:
        if not b.num_rows:
            continue
        block, file = b.column("_block").to_numpy(), b.column("_file").to_numpy()
        new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], strict=True):
            own = b.slice(lo, hi - lo)
            data = separator.join([*own.column("value").to_pylist(), b""])
            yield (int(file[lo]), int(block[lo])), {c: own.column(c)[0].as_py() for c in own.schema.names if c not in ("value", "_file", "_block")}, np.frombuffer(data, np.uint8)


def _summaries(pieces: DataFrame, kind: Csv | Json) -> DataFrame:
    """For each split: oddness of quotes, change of depth, and what opened last at each relative depth, for both states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, delta, opened = None, 0, [0, 0], [{}, {}]

        def done() -> pa.RecordBatch:
            maps = [pa.array([list(o.items())], pa.map_(pa.int64(), pa.bool_())) for o in opened]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*now, odd, *delta)] + maps, names=["_file", "_block", "odd", "d0", "d1", "o0", "o1"])

        for of, _, data in _of_splits(batches, kind.separator):
            if of != now:
                if now is not None:
                    yield done()
                now, odd, delta, opened = of, 0, [0, 0], [{}, {}]
            more = kind.summary(data)
            for h in (0, 1):
                then = h ^ odd
                opened[h] |= {delta[h] + k: v for k, v in more[2][then].items()}
                delta[h] += more[1][then]
            odd ^= more[0]
        if now is not None:
            yield done()

    return pieces.mapInArrow(run, "_file long, _block long, odd long, d0 long, d1 long, o0 map<long,boolean>, o1 map<long,boolean>")


def _states(summaries: DataFrame, level: int) -> DataFrame:
    """The state at each split's begin, by running sums over the splits of its file."""
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    out = summaries.withColumn("_inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1)
    out = out.withColumn("_by", F.when(F.col("_inside"), F.col("d1")).otherwise(F.col("d0")))
    out = out.withColumn("_depth", F.coalesce(F.sum("_by").over(before), F.lit(0)))
    opened = F.element_at(F.when(F.col("_inside"), F.col("o1")).otherwise(F.col("o0")), F.lit(level - 1).cast("long") - F.col("_depth"))
    out = out.withColumn("_opened", opened)
    return out.select("_file", "_block", "_inside", "_depth", F.coalesce(F.last("_opened", ignorenulls=True).over(before), F.lit(False)).alias("_wanted"))


def _cut(pieces: DataFrame, kind: Csv | Json, whole: bool, header: bool) -> DataFrame:
    """The splits' records (``whole``), or the pieces of records that other splits have a part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, held_kind = None, None, [], WHOLE

        def rows(values: list[bytes], what: int) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()), pa.array([what] * n, pa.int32()), pa.array(values, pa.binary())], names=["_file", "_block", "kind", "value"])

        def rest() -> Iterator[pa.RecordBatch]:
            if held and not whole:
                yield rows([b"".join(held)], held_kind)

        for of, begin, data in _of_splits(batches, kind.separator):
            if of != now:
                yield from rest()
                now, state = of, State(begin["_inside"], begin["_depth"], begin["_wanted"])
                inner = state.inside if isinstance(kind, Csv) else state.wanted and state.depth > kind.level
                held, held_kind, top = [], GOES_ON if inner else WHOLE, header and of[1] == 0
            was_open = held_kind != WHOLE
            starts, ends, state = kind.cut(data, state)
            raw, first = data.tobytes(), 0
            if was_open:
                held.append(raw[: ends[0]] if len(ends) else raw)
                if len(ends):
                    first = 1
                    if held_kind == GOES_ON and not whole:
                        yield rows([b"".join(held)], GOES_ON)
                    elif held_kind == BEGINS and whole:
                        yield rows([b"".join(held)], WHOLE)
                    top = top and held_kind != BEGINS_HEADER
                    held, held_kind = [], WHOLE
            found = [raw[a:b] for a, b in zip(starts.tolist(), ends[first:].tolist(), strict=False)]
            if found and top:
                found, top = found[1:], False
            if found and whole:
                yield rows(found, WHOLE)
            if len(starts) > len(ends) - first:
                held, held_kind = [raw[starts[-1] :]], BEGINS_HEADER if top else BEGINS
        if now is not None:
            yield from rest()

    return pieces.mapInArrow(run, "_file long, _block long, kind int, value binary")


def _joined(parts: DataFrame) -> DataFrame:
    """Records put together from their pieces; headers are left out."""
    order = Window.partitionBy("_file").orderBy("_block", "kind")
    own = parts.withColumn("_nth", F.sum((F.col("kind") >= BEGINS).cast("int")).over(order))
    own = own.groupBy("_file", "_nth").agg(F.array_sort(F.collect_list(F.struct("_block", "kind", "value"))).alias("p"), F.max("kind").alias("kind"))
    return own.where(F.col("kind") != BEGINS_HEADER).select(F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["value"])).alias("value"))


def records(spark: SparkSession, path: str, kind: Csv | Json, header: bool = False) -> DataFrame:
    """``value``: the text of each record of all files of ``path``, without its order; the first of a file isn't given if ``header``."""
    text = spark.read.text(path, lineSep=kind.separator.decode())
    pieces = text.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    if (n := text.rdd.getNumPartitions()) > MOST_SPLITS:
        raise ValueError(f"{n} splits: raise spark.sql.files.maxPartitionBytes, {MOST_SPLITS} is the most")
    states = _states(_summaries(pieces, kind), getattr(kind, "level", 1))
    placed = pieces.join(F.broadcast(states), ["_file", "_block"])
    whole, parts = (_cut(placed, kind, x, header) for x in (True, False))
    return whole.select("value").unionByName(_joined(parts)).select(F.col("value").cast("string").alias("value"))


def csv_fields(value: Column, schema: str, **options: str) -> Column:
    """The fields of a record as Spark's own CSV reader sees them."""
    line = F.regexp_replace(value, "\r?\n\\z", "")
    return F.from_csv(line, schema, {"quote": '"', "escape": '"', "multiLine": "true", **options})
