"""Line dedup with a log-template tree.

Lines (between line feeds, with at least one word) go down a tree of fixed depth: the number of tokens, then the
``DEPTH`` leading tokens; tokens with a digit count as the variable field ``<*>``. In a leaf, templates are grown by
merging: two halves of the leaf's distinct lines (by the bits of the line's hash, down to single lines) each have their
templates; one of the second half joins the one of the first half that it agrees with best (the first of several), if
they agree in ``similarity`` of the places, where a variable field counts half; places that differ become variable
fields. A template that agrees with none stays on its own. So what comes out depends on the leaf's lines alone, not on
how they are dealt. Templates that occur in at least ``min_docs`` documents are recurring, and so are those of
``LONG_TOKENS`` tokens or more that occur in two different texts; their lines are dropped from all documents.

How it is spread: every task first merges its equal lines, so that a line that is everywhere is one row for each slice
of texts. Rows are dealt by leaf; of a leaf with many rows by leaf and the first bits of the line's hash, and these
parts' templates (never lines) are merged level by level, ``FAN`` bits at a time, by the very same steps. Templates meet by
an index over blocks of places, not in a matrix of all; the last step holds all templates of its leaf, at some 200 bytes
each (for twelve tokens), and its time grows with those that share a block. Leaves whose lines can't recur aren't grown. Exact document counts then come from joins on line hashes.

Defined results: null and empty texts have no lines and stay as they are; lines without words always stay; a document
all of whose lines are dropped becomes an empty text; repeated rows and equal texts are documents of their own, so
that what repeats in them recurs (but long templates need two texts that differ); lines shorter than DEPTH tokens are
keyed by all their tokens. Very long texts are read whole, one at a time; a very long line is one row. An empty table
gives an empty result. Columns other than id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, in_batches
from ._words import NEWLINE, SPACE, hashes, mix, row_slices, spans, text_bytes

DEPTH = 3
SIMILARITY = 0.75
MIN_DOCS = 3
#: Templates of so many tokens recur from two different texts on.
LONG_TOKENS = 50
#: A leaf with more rows is dealt to several tasks; this changes no result.
LEAF_ROWS = 20_000
#: Bits of the line's hash that one merge step takes back.
FAN = 4
#: Token places that are compared at once.
CELLS = 4_000_000
#: Up to so many token places templates are compared without an index; this changes no result.
FEW_CELLS = 500_000
WILD = np.uint64(0x2A2A2A2A2A2A2A2A)
WILD_TOKEN = np.int32(WILD.astype(np.uint32).view(np.int32))

_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def parse(column: pa.Array) -> dict:
    """The lines with words: row, number among the row's line-feed parts, span, masked tokens, leaf and line hash."""
    data, offsets = text_bytes(column)
    lines = spans(data, offsets, NEWLINE)
    words = spans(data, offsets, SPACE)
    first, end = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    full = end > first
    first, end = first[full], end[full]
    token = hashes(data, words.starts, words.ends)
    token[row_digits(data, words) > 0] = WILD
    size = end - first
    leaf = mix(size.astype(np.uint64) + _STEP)
    for j in range(DEPTH):
        leaf = np.where(size > j, mix(leaf * _STEP + token[np.minimum(first + j, max(0, len(token) - 1))]), leaf) if len(token) else leaf
    place = np.arange(len(token)) - np.repeat(first, size) if len(token) else np.zeros(0, np.int64)
    salted = mix(token + mix(place.astype(np.uint64)))
    line = mix(np.add.reduceat(salted, first) + leaf) if len(first) else np.zeros(0, np.uint64)
    row = lines.row_of()[full]
    feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
    number = feeds[lines.starts[full]] - feeds[offsets[row]]
    return {"row": row, "number": number, "start": lines.starts[full], "end": lines.ends[full], "first": first, "size": size, "token": token, "leaf": leaf, "line": line}


def row_digits(data: np.ndarray, words) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    return total[words.ends] - total[words.starts]


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    return first, count


def distinct_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """leaf, line, docs (documents of this task's slice that have the line) and its masked tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text"):
            p = parse(b.column("_text"))
            once, _ = _first_of(p["line"] ^ mix(p["row"].astype(np.uint64) + np.uint64(1)))
            at, count = _first_of(p["line"][once])
            at = once[at]
            size = p["size"][at]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(p["first"][at] - ends[:-1], size) + np.arange(ends[-1])
            # 32 bits of each token are kept: equal tokens stay equal
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p["token"][flat].astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["leaf"][at].view(np.int64)), pa.array(p["line"][at].view(np.int64)), pa.array(count.astype(np.int32)), tokens],
                names=["leaf", "line", "docs", "tokens"],
            )

    return in_batches(docs.select(F.col(text_col).alias("_text")), run, "leaf long, line long, docs int, tokens array<int>")


def _agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places (the last axis) with equal tokens, and half of those where either has a variable field."""
    free = (one == WILD_TOKEN) | (other == WILD_TOKEN)
    return ((one == other) & ~free).sum(axis=-1) + 0.5 * free.sum(axis=-1)


def nearest(one: np.ndarray, other: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """For each template of ``other``: the first of those of ``one`` that it agrees with best, and whether that is enough.

    Which is the first is only told where it is enough. Few templates are compared with each other, many by an index.
    """
    pairs = None if one.size * len(other) <= FEW_CELLS else _sharing(one, other, need)
    best, most = np.zeros(len(other), np.int64), np.full(len(other), -1.0)
    if pairs is None:
        step = max(1, CELLS // max(1, one.size))
        for lo in range(0, len(other), step):
            alike = _agreement(one[None], other[lo : lo + step, None])
            best[lo : lo + step], most[lo : lo + step] = alike.argmax(axis=1), alike.max(axis=1)
        return best, most >= need
    for left, right, begin, count in pairs:
        ends = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(right):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CELLS // one.shape[1], "right")) - 1)
            x = left[np.arange(ends[hi] - ends[lo]) + np.repeat(begin[lo:hi] - (ends[lo:hi] - ends[lo]), count[lo:hi])]
            y = np.repeat(right[lo:hi], count[lo:hi])
            alike = _agreement(one[x], other[y])
            order = np.lexsort((x, -alike, y))
            order = order[np.append(True, y[order][1:] != y[order][:-1])[: len(order)]]
            x, y, alike = x[order], y[order], alike[order]
            more = (alike > most[y]) | ((alike == most[y]) & (x < best[y]))
            best[y[more]], most[y[more]] = x[more], alike[more]
            lo = hi
    return best, most >= need


def _sharing(one: np.ndarray, other: np.ndarray, need: float) -> list[tuple] | None:
    """An index of the pairs that may agree in ``need`` places, or None if it would name as many as there are.

    A place that differs costs 1 and a variable field 1/2, of what may be lost. The places in which not all templates
    have the same token are dealt to one block more than whole places may differ, so that no place of some block
    differs: a pair has equal tokens there but for the variable fields of either. Templates are looked up by block and
    by where they have variable fields. Given are (places in ``one``, places in ``other``, and for each of the latter
    where its partners begin and how many there are).
    """
    size = one.shape[1]
    same = (one == one[0]).all(axis=0) & (other == one[0]).all(axis=0)
    lost = size - need + 1e-9 - 0.5 * (one[0][same] == WILD_TOKEN).sum()
    places, blocks = np.flatnonzero(~same), int(np.floor(lost)) + 1
    if blocks <= 0:
        return []
    if blocks > len(places):
        return None
    # those with most different tokens are dealt first, each to its own block
    kinds = np.array([len(np.unique(one[:, p])) + len(np.unique(other[:, p])) for p in places])
    places = places[np.argsort(-kinds, kind="stable")]
    salt = mix(np.arange(size, dtype=np.uint64) + _STEP) | np.uint64(1)
    found, named, every = [], 0, len(one) * len(other)
    for b in range(blocks):
        cols = places[b::blocks]
        sides = []
        for side in (one, other):
            wild = side[:, cols] == WILD_TOKEN
            _, first, at = np.unique((wild * salt[cols]).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
            token = side[:, cols].astype(np.uint32).astype(np.uint64) * salt[cols]
            sides.append([(wild[f], np.flatnonzero(at == i), token) for i, f in enumerate(first)])
        named += len(sides[0]) * len(sides[1]) * 64
        if named > every:
            return None
        for (wild, left, mine), (free, right, theirs) in product(*sides):
            use = ~(wild | free)
            key, want = mix(mine[left][:, use].sum(axis=1, dtype=np.uint64)), mix(theirs[right][:, use].sum(axis=1, dtype=np.uint64))
            order = np.argsort(key, kind="stable")
            begin = np.searchsorted(key[order], want, "left")
            count = np.searchsorted(key[order], want, "right") - begin
            named += int(count.sum())
            if named > every:
                return None
            some = np.flatnonzero(count)
            found.append((left[order], right[some], begin[some], count[some]))
    return found


def grown(ids: np.ndarray, tokens: np.ndarray, bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(the item that each item's template goes by, templates at these places), of items of one leaf.

    ``ids``: line hashes, rising; ``tokens``: item x place. Items whose ids agree in the first ``bits`` bits are
    templates that have been grown together; with all 64 bits every item is a line.
    """
    key = ids.view(np.uint64) ^ np.uint64(1 << 63)
    templates, into = tokens.copy(), np.arange(len(ids))
    need = similarity * tokens.shape[1]

    def node(lo: int, hi: int) -> np.ndarray:
        differ = int(key[lo] ^ key[hi - 1])
        if differ.bit_length() <= 64 - bits:
            return np.arange(lo, hi)
        bit = np.uint64(differ.bit_length() - 1)
        mid = int(np.searchsorted(key[lo:hi], key[hi - 1] >> bit << bit)) + lo
        one, other = node(lo, mid), node(mid, hi)
        best, joins = nearest(templates[one], templates[other], need)
        for x, y in zip(one[best[joins]].tolist(), other[joins].tolist(), strict=True):
            templates[x][templates[x] != templates[y]] = WILD_TOKEN
            into[y] = x
        return np.concatenate([one, other[~joins]])

    if len(ids):
        node(0, len(ids))
    for i in range(len(into)):  # what an item joined comes before it
        into[i] = into[into[i]]
    return into, templates


def grow(rows: DataFrame, bits: str, similarity: float, least: int | None) -> DataFrame:
    """leaf, line, template (the line it goes by), its docs and tokens, for ``rows`` (leaf, part, line, docs, tokens, bits).

    Rows are dealt by leaf and part and sorted, so that a task holds the distinct lines of one part at a time; equal
    lines are one. ``bits`` is the column with the bits in which lines of one template list agree. ``least``: templates of
    fewer documents are left out, and leaves of fewer aren't grown (for long ones, two documents are enough).
    """
    ordered = rows.select("leaf", "part", "line", "docs", F.col(bits).cast("int").alias("bits"), "tokens")
    ordered = ordered.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
    names = ["leaf", "line", "template", "docs", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(b: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
            leaf, line, docs = (b.column(c).to_numpy() for c in ("leaf", "line", "docs"))
            at, flat = b.column("tokens").offsets.to_numpy(), b.column("tokens").values.to_numpy()
            total = np.add.reduceat(docs.astype(np.int64), begin)
            size = (at[1:] - at[:-1])[begin]
            want = np.zeros(len(begin), np.int64) if least is None else np.where(size >= LONG_TOKENS, min(2, least), least)
            found: list[tuple] = []
            for g in np.flatnonzero(total >= want).tolist():
                lo = int(begin[g])
                hi = int(begin[g + 1]) if g + 1 < len(begin) else len(leaf)
                first = lo + np.flatnonzero(np.append(True, line[lo + 1 : hi] != line[lo : hi - 1]))
                own = line[first]
                n = np.add.reduceat(docs[lo:hi].astype(np.int64), first - lo)
                tokens = flat[at[first][:, None] + np.arange(size[g])]
                into, templates = grown(own, tokens, int(b.column("bits")[lo].as_py()), similarity)
                sums = np.bincount(into, weights=n, minlength=len(own)).astype(np.int64)
                keep = np.flatnonzero(sums[into] >= want[g])
                found.append((np.full(len(keep), leaf[lo]), own[keep], own[into[keep]], sums[into[keep]], templates[into[keep]] if least is None else templates[:0]))
            if found:
                lists = pa.array([t for f in found for t in f[4]], pa.list_(pa.int32())) if least is None else pa.nulls(sum(len(f[0]) for f in found), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([f[i] for f in found])) for i in range(4)), lists], names=names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            begin = _begins(whole)
            held = [_one_row_a_line(whole.slice(begin[-1]))]  # the last part may go on
            if len(begin) > 1:
                yield from pieces(whole.slice(0, begin[-1]), begin[:-1])
        for b in held:
            yield from pieces(b, np.zeros(1, np.int64))

    return in_batches(ordered, run, "leaf long, line long, template long, docs long, tokens array<int>")


def _begins(b: pa.RecordBatch) -> np.ndarray:
    leaf, part = b.column("leaf").to_numpy(), b.column("part").to_numpy()
    return np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])))


def _one_row_a_line(b: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of one part with equal lines summed, so that a line that is everywhere isn't held for each slice."""
    line = b.column("line").to_numpy()
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    if len(first) == len(line):
        return b
    docs = pa.array(np.add.reduceat(b.column("docs").to_numpy(), first))
    kept = b.take(pa.array(first))
    return pa.RecordBatch.from_arrays([docs if n == "docs" else kept.column(n) for n in b.schema.names], schema=b.schema)


def line_templates(docs: DataFrame, text_col: str, min_docs: int, similarity: float) -> DataFrame:
    """line -> template, for templates that may recur."""
    lines = distinct_lines(docs, text_col).withColumn("docs", F.col("docs").cast("long"))
    # large leaves are dealt by the first d bits of the hash; which these are changes the work's places, not its result
    sizes = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF_ROWS)
    depth = F.least(F.lit(24), F.ceil(F.log2(F.col("n") / LEAF_ROWS) / FAN) * FAN).cast("int")
    sizes = cut(sizes.select("leaf", depth.alias("d")), dealt=True)
    lines = lines.withColumn("bits", F.lit(64))
    deepest = sizes.agg(F.max("d")).first()[0] or 0
    if not deepest:
        return grow(lines.withColumn("part", F.lit(0).cast("long")), "bits", similarity, min_docs).select("line", "template")
    prefix = "shiftrightunsigned(line ^ (-9223372036854775807L - 1L), 64 - {})"
    joined = lines.join(sizes, "leaf", "left").withColumn("part", F.coalesce(F.expr(prefix.format("d")), F.lit(0).cast("long")))
    small = grow(joined.where("d is null"), "bits", similarity, min_docs).select("line", "template")
    # every template of a part goes on, however rare: what is rare in a part can recur in the leaf
    found = cut(grow(joined.where("d is not null"), "bits", similarity, None))
    lists = found.where("line = template").join(sizes, "leaf").select("leaf", "line", "docs", "tokens", "d")
    known = found.select("leaf", "line", "template")
    for level in range(deepest, 0, -FAN):
        mine, rest = lists.where(F.col("d") == level), lists.where(F.col("d") < level)
        last = F.expr(prefix.format(f"{level - FAN}")) if level > FAN else F.lit(0).cast("long")
        step = cut(grow(mine.withColumn("bits", F.lit(level)).withColumn("part", last), "bits", similarity, None))
        moved = step.select(F.col("leaf").alias("_leaf"), F.col("line").alias("_old"), F.col("template").alias("_new"))
        known = known.join(moved.hint("merge"), (known["leaf"] == moved["_leaf"]) & (known["template"] == moved["_old"]), "left")
        known = cut(known.select("leaf", "line", F.coalesce("_new", "template").alias("template")), dealt=True)
        up = step.where("line = template").select("leaf", "line", "docs", "tokens", F.lit(level - FAN).alias("d"))
        lists = cut(up.unionByName(rest), dealt=True)
    enough = F.col("docs") >= F.when(F.size("tokens") >= LONG_TOKENS, min(2, min_docs)).otherwise(min_docs)
    kept = lists.where(enough).select(F.col("leaf").alias("_leaf"), F.col("line").alias("_id"))
    large = known.join(kept.hint("merge"), (known["leaf"] == kept["_leaf"]) & (known["template"] == kept["_id"])).select("line", "template")
    return small.unionByName(large)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """_id, _key (MD5 of the text) and _drop: numbers of the line-feed parts of the text that belong to recurring templates."""
    slim = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_key"), F.col(text_col).alias("_text"))
    slim = slim.withColumn("_row", F.monotonically_increasing_id())
    templates = line_templates(docs, text_col, min_docs, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text"):
            p = parse(b.column("_text"))
            at = pa.array(p["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id").take(at), b.column("_key").take(at), b.column("_row").take(at), pa.array(p["number"], pa.int32()),
                    pa.array(p["line"].view(np.int64)), pa.array(p["size"] >= LONG_TOKENS),
                ],
                names=["_id", "_key", "_row", "number", "line", "long"],
            )

    kind = slim.schema["_id"].dataType.simpleString()
    lines = in_batches(slim, run, f"_id {kind}, _key binary, _row long, number int, line long, long boolean")
    lines = cut(lines.join(templates, "line").drop("line"))
    once = lines.select("template", "_key", "_row", "long").distinct().groupBy("template", "_key", "long").agg(F.count(F.lit(1)).alias("n"))
    recurring = once.groupBy("template", "long").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    recurring = recurring.where((F.col("n") >= min_docs) | (F.col("long") & (F.col("texts") >= 2)))
    recurring = cut(recurring.select("template"))  # else the join keeps its partitioning, and a template that is everywhere can't be split
    mine = lines.join(recurring, "template")
    return mine.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("number")).alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, text without the lines of recurring templates, n_lines (with words), n_dropped."""
    drop = dropped_lines(docs, id_col, text_col, min_docs, similarity)
    slim = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_md5"))
    joined = slim.join(drop, slim["_own"].eqNullSafe(drop["_id"]) & (slim["_md5"] == drop["_key"]), "left")
    parts = F.split("_text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_drop", i)), "\n")
    some = F.filter(parts, lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return joined.select(
        F.col("_own").alias(id_col),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept).alias(text_col),
        F.coalesce(F.size(some), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_drop").isNotNull(), F.size("_drop")), F.lit(0)).cast("long").alias("n_dropped"),
    )
