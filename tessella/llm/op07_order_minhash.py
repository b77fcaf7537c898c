"""Near duplicates by Order MinHash.

1. Equal texts are one node (grouped by MD5; the group's least row stands for it).
2. Of each text's ``K``-word k-mers, labelled with their occurrence number, each of ``BANDS`` sketches takes the
   ``TAKEN`` least under its own hash and keeps them in text order. Texts that agree in a sketch are candidates. At
   Jaccard similarity 0.8 a sketch agrees with probability of about 0.5, so one of 16 does in all but about 10^-5.
3. A bucket's texts are candidates of its hubs, not of each other: pairs grow with the members, and no bucket is
   collected. First the hubs are the bucket's most central text and a random one. Then, for ``ROUNDS`` rounds or until
   one finds no link, buckets whose texts aren't all in one class draw ``HUBS`` hubs anew, for texts of smaller classes.
   Hubs only make classes large early. What they leave is then compared in full: in buckets whose texts still aren't in
   one class, every pair of texts of different classes, in cells of two blocks of ``BLOCK`` members.
4. Candidates are verified: multiset Jaccard similarity of the k-mers of 0.8 or more, then banded alignment of the
   words with edits of at most 20 % of the longer text. Words are lower-cased runs of letters and digits.
5. Verified links join nodes to classes (label propagation with pointer jumping, on distributed tables).

Defined results: null texts are classes of their own; equal texts, also empty ones, share a class; texts of fewer than
``K`` words are near only if their words are the same; texts without words only if equal; class_id is the least id in
the class (null if all are null); of repeated rows exactly one is kept. Very long texts are read whole: a pair's
alignment takes memory by its edits, a cell's blocks are cut by k-mers as well as by texts. An empty table gives an
empty result. Other columns, whatever their names, are ignored (``keep_one_of_each`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._align import edit_distance
from ._store import cut, in_batches
from ._words import NOT_WORD, SLICE_BYTES, hashes, mix, row_slices, spans, text_bytes, windows

K = 5
BANDS = 16
TAKEN = 3
SIMILARITY = 0.8
#: Hubs of a bucket in each further round.
HUBS = 4
#: Further rounds at most.
ROUNDS = 1
#: About so many members of a bucket make a block; a cell has two blocks at most.
BLOCK = 256
#: Of long texts, so many k-mers make a block.
BLOCK_KMERS = 1 << 20
#: K-mers that are compared at once in a cell.
COLUMNS = 4096

_ODD = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, (BANDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each normalised word, offsets of the texts)."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    words = spans(data, offsets, NOT_WORD)
    return hashes(data, words.starts, words.ends), words.rows


def labelled_kmers(words: np.ndarray, rows: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer hashes with their occurrence number mixed in, in text order; offsets). A shorter text is one k-mer."""
    keys, at = windows(words, rows, k)
    count = np.diff(rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        row = np.repeat(np.arange(len(count)), count)[at]
        whole = np.array([int(mix(np.array([sum(int(w) * int(_STEP) ** j for j, w in enumerate(words[rows[r] : rows[r + 1]])) & (2**64 - 1)], np.uint64))[0]) for r in short], np.uint64)
        keys, row = np.concatenate([keys, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
    else:
        row = np.repeat(np.arange(len(count)), count)[at]
    sort_key = keys ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(sort_key, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = sort_key[order][1:] != sort_key[order][:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    occurrence = np.empty(len(keys), np.uint64)
    occurrence[order] = nth.astype(np.uint64)
    return mix(keys + occurrence * _STEP), np.searchsorted(row, np.arange(len(count) + 1))


def order_sketches(kmers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(texts with k-mers) x BANDS: a hash of the least k-mers in text order."""
    counts = np.diff(rows)
    full = np.flatnonzero(counts)
    out = np.zeros((len(full), BANDS), np.uint64)
    if not len(full):
        return out
    begin, count = rows[:-1][full], counts[full]
    owner = np.repeat(np.arange(len(full)), count)
    for band in range(BANDS):
        rank = kmers * _ODD[band, 0]
        rank ^= rank >> np.uint64(31)
        rank *= _ODD[band, 1]
        place = np.full((len(full), TAKEN), -1, np.int64)
        for j in range(TAKEN):
            least = np.minimum.reduceat(rank, begin)
            hit = np.flatnonzero(rank == least[owner])
            hit = hit[rank[hit] != _TOP]
            place[owner[hit], j] = hit
            rank[hit] = _TOP
        place.sort(axis=1)
        key = np.full(len(full), band + 1, np.uint64)
        for j in range(TAKEN):
            key = key * _STEP + np.where(place[:, j] >= 0, kmers[np.maximum(place[:, j], 0)], np.uint64(j))
        out[:, band] = mix(key)
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (MD5 of the text), _bands and _size (k-mers) of each row."""
    slim = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_key"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text"):
            kmers, rows = labelled_kmers(*word_hashes(b.column("_text")))
            keys = order_sketches(kmers, rows)
            ends = np.concatenate([[0], np.cumsum(np.diff(rows) > 0)]) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(np.diff(rows), pa.int64())], names=["_id", "_key", "_bands", "_size"])

    return in_batches(slim, run, f"_id {slim.schema['_id'].dataType.simpleString()}, _key binary, _bands array<long>, _size long")


def kmer_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of labelled k-mers."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def alike(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, similarity: float) -> bool:
    """Verification of one candidate from word hashes and labelled k-mers of both texts."""
    if min(len(ka), len(kb)) < similarity * max(len(ka), len(kb)) or kmer_similarity(ka, kb) < similarity:
        return False
    return edit_distance(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) is not None


def verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(row_slices(batches, "text_a"), "text_b"):
            wa, ra = word_hashes(b.column(2))
            wb, rb = word_hashes(b.column(3))
            (ka, sa), (kb, sb) = labelled_kmers(wa, ra), labelled_kmers(wb, rb)
            same = [
                alike(wa[ra[i] : ra[i + 1]], wb[rb[i] : rb[i + 1]], ka[sa[i] : sa[i + 1]], kb[sb[i] : sb[i + 1]], similarity)
                for i in range(b.num_rows)
            ]
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    # the exchange of the few links makes their files few
    return in_batches(pairs.select("a", "b", "text_a", "text_b"), run, "a binary, b binary").distinct()


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, k, size, n, blocks) of the texts in buckets of several texts.

    size: a text's k-mers; n: how many texts the bucket has; blocks: in how many parts of about ``BLOCK`` texts and at
    most about ``BLOCK_KMERS`` k-mers they are compared.
    """
    member = nodes.select(F.explode("_bands").alias("bucket"), F.col("_key").alias("k"), F.col("_size").alias("size"))
    several = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).where("n > 1")
    several = several.select("bucket", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_KMERS)).alias("blocks"))
    # written, so that the join deals both sides anew and can split a bucket that many texts share
    return cut(member.join(cut(several, dealt=True), "bucket"))


def similar_sizes(a: Column, b: Column, similarity: float) -> Column:
    """Whether texts of so many k-mers can be as similar: what isn't so needn't be read."""
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


def first_pairs(member: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct candidates (a, b): each bucket's texts with its most central one and with one by random priority.

    A text is central if it shares its buckets with many: the one that a group's copies were made from agrees with most
    of them. Both hubs are mostly the same in all buckets of a group, so that few pairs find most of its links.
    """
    central = member.groupBy("k").agg(F.sum("n").alias("c"))
    own = member.select("bucket", "k", "size").join(central.hint("merge"), "k").withColumn("p", F.xxhash64("k"))
    hubs = own.groupBy("bucket").agg(F.max(F.struct("c", "p", "k", "size")).alias("lo"), F.min(F.struct("p", "k", "size")).alias("hi"))
    hubs = cut(hubs.select("bucket", F.array(*[F.struct(f"{x}.k", f"{x}.size") for x in ("lo", "hi")]).alias("hubs")), dealt=True)
    found = member.join(hubs, "bucket").select("k", "size", F.explode("hubs").alias("h")).where(F.col("k") != F.col("h.k"))
    found = found.where(similar_sizes(F.col("size"), F.col("h.size"), similarity))
    return found.select(F.least("k", "h.k").alias("a"), F.greatest("k", "h.k").alias("b")).distinct()


def more_pairs(member: DataFrame, labels: DataFrame, tested: DataFrame, turn: int, similarity: float = SIMILARITY) -> DataFrame:
    """Candidates for buckets whose texts aren't all in one class: texts with hubs drawn anew, of larger classes only.

    So a large class, whose texts are together already, costs nothing, and each text outside it has a few pairs.
    """
    sizes = cut(labels.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("z")), dealt=True)
    sized = labels.join(sizes.hint("merge"), labels["label"] == sizes["l"]).select("node", F.struct("z", F.col("label").alias("c")).alias("of"))
    alone = F.struct(F.lit(1).cast("long").alias("z"), F.col("k").alias("c"))
    own = member.join(sized.hint("merge"), member["k"] == sized["node"], "left").select("bucket", "k", "size", F.coalesce("of", alone).alias("of"))
    drawn = [F.min(F.struct(F.xxhash64("k", "bucket", F.lit(turn * HUBS + i)).alias("p"), "k", "of", "size")).alias(f"h{i}") for i in range(HUBS)]
    hubs = own.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), *drawn).where("lo <> hi")
    hubs = cut(hubs.select("bucket", F.array_distinct(F.array(*[F.struct(f"h{i}.k", f"h{i}.of", f"h{i}.size") for i in range(HUBS)])).alias("hubs")), dealt=True)
    found = own.join(hubs.hint("merge"), "bucket").select("k", "of", "size", F.explode("hubs").alias("h")).where(F.col("of") < F.col("h.of"))
    found = found.where(similar_sizes(F.col("size"), F.col("h.size"), similarity))
    pairs = found.select(F.least("k", "h.k").alias("a"), F.greatest("k", "h.k").alias("b")).distinct()
    return pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")


def left_cells(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, x, z, side, k, of): the members of buckets whose texts aren't all in one class, in each cell (x, z) of
    their block ``side``, so that any two members of a bucket meet in a cell; of: a text's class."""
    # the one pair of a bucket of two is settled: it was tested with its hub, or its sizes rule it out
    member = member.where("n > 2")
    own = member.join(labels.hint("merge"), member["k"] == labels["node"], "left").select("bucket", "k", "blocks", F.coalesce("label", "k").alias("of"))
    mixed = own.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi")
    own = own.join(cut(mixed.select("bucket"), dealt=True).hint("merge"), "bucket")
    own = own.withColumn("side", F.pmod(F.xxhash64("k"), "blocks"))
    own = own.select("bucket", "k", "of", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return own.select("bucket", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("z"), "side", "k", "of")


def shared_counts(kmers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many labelled k-mers each two texts of a cell share."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(kmers, return_inverse=True, return_counts=True)
    several = count > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        some = np.zeros((n, int(column[hi - 1]) - first + 1), np.float32)
        some[row[lo:hi], column[lo:hi] - first] = 1
        out += some @ some.T
    return out.astype(np.float64)


def left_links(cells: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of all alike texts of a cell; texts: _key and _text."""
    cells = cells.join(texts.hint("merge"), cells["k"] == texts["_key"]).select("bucket", "x", "z", "side", "k", "of", "_text")
    cells = cells.repartition("bucket", "x", "z").sortWithinPartitions("bucket", "x", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[bytes, bytes] = {}  # classes that links of this task have joined

        def root(c: bytes) -> bytes:
            while c in above:
                c = above[c]
            return c

        def linked(b: pa.RecordBatch, begin: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
            words, at = word_hashes(b.column("_text"))
            kmers, rows = labelled_kmers(words, at)
            side, corner = b.column("side").to_numpy(), b.column("x").to_numpy() != b.column("z").to_numpy()
            code, of, key = b.column("of").dictionary_encode().indices.to_numpy(), b.column("of"), b.column("k")
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                if (code[lo:hi] == code[lo]).all():
                    continue
                sizes = np.diff(rows[lo : hi + 1])
                both = shared_counts(kmers[rows[lo] : rows[hi]], sizes)
                near = both >= (similarity - 1e-9) * (sizes[:, None] + sizes - both)
                near &= code[lo:hi, None] != code[lo:hi]
                if corner[lo]:
                    near &= side[lo:hi, None] != side[lo:hi]
                for i, j in (np.argwhere(np.triu(near, 1)) + lo).tolist():
                    one, other = root(of[i].as_py()), root(of[j].as_py())
                    if one != other and alike(words[at[i] : at[i + 1]], words[at[j] : at[j + 1]], kmers[rows[i] : rows[i + 1]], kmers[rows[j] : rows[j + 1]], similarity):
                        above[max(one, other)] = min(one, other)
                        yield key[i].as_py(), key[j].as_py()

        def pieces() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            """Whole cells, several at once as long as their texts have at most SLICE_BYTES, and where each begins."""
            held: list[pa.RecordBatch] = []
            for b in chain((b for b in batches if b.num_rows), [None]):
                if b is not None:
                    held.append(b)
                elif not held:
                    return
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cell = np.stack([whole.column(c).to_numpy() for c in ("bucket", "x", "z")])
                begin = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
                if b is None:
                    begin, held = np.append(begin, whole.num_rows), []
                else:
                    held = [whole.slice(begin[-1])]
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(whole.column("_text")).to_numpy().astype(np.int64))])
                first = 0
                while first < len(begin) - 1:
                    to = max(first + 1, int(np.searchsorted(ends[begin], ends[begin[first]] + SLICE_BYTES, "right")) - 1)
                    yield whole.slice(begin[first], begin[to] - begin[first]), begin[first : to + 1] - begin[first]
                    first = to

        for piece, begin in pieces():
            links = list(linked(piece, begin))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return in_batches(cells, run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for all nodes of links (a, b).

    Joins are merge joins however small a table is: a loop of broadcasts would fill the driver.
    """
    links = links.select("a", "b")
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), dealt=True)
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), dealt=True)
    while True:
        near = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        # the jump reads the written labels, not the new ones: both sides are dealt for it, so that a large component,
        # in which all have one next, can be split
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = cut(step.join(jump.hint("merge"), step["next"] == jump["via"]).select("node", F.least("next", "far").alias("next"), "label"), dealt=True)
        more = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not more:
            return labels


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after some more links: only the classes that these join are looked at."""
    name = {}
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(f"n{side}"), F.col("label").alias(f"l{side}"))
        links = links.join(own.hint("merge"), F.col(side) == F.col(f"n{side}"), "left")
        name[side] = F.coalesce(f"l{side}", side)
    moved = components(links.select(name["a"].alias("a"), name["b"].alias("b")).distinct())
    moved = moved.select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(moved.hint("merge"), labels["label"] == moved["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = moved.join(labels.hint("merge"), moved["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return cut(known.unionByName(alone), dealt=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: id, text_key (MD5), class_id, class_size (rows), kept (one row of each class)."""
    rows = cut(sketched(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), narrow=True)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    # a null text is a node of its own
    rows = rows.withColumn("_key", F.coalesce("_key", F.concat(F.lit("row "), F.col("_row").cast("string")).cast("binary")))
    nodes = cut(rows.groupBy("_key").agg(F.min(place).alias("_least"), F.count(F.lit(1)).alias("_n"), F.any_value("_bands").alias("_bands"), F.any_value("_size").alias("_size")), dealt=True)
    member = shared_buckets(nodes)
    pairs = cut(first_pairs(member, similarity), dealt=True)
    wanted = pairs.select(F.col("a").alias("_key")).union(pairs.select(F.col("b").alias("_key"))).distinct()
    wanted = wanted.join(nodes.select("_key", F.col("_least.id").alias("_want")), "_key")
    texts = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_k"), F.col(text_col).alias("_text"))
    texts = texts.join(wanted, texts["_id"].eqNullSafe(wanted["_want"]) & (texts["_k"] == wanted["_key"])).select("_key", "_text").dropDuplicates(["_key"])
    texts = cut(texts)
    right = texts.select(F.col("_key").alias("b"), F.col("_text").alias("text_b"))
    left = texts.select(F.col("_key").alias("a"), F.col("_text").alias("text_a"))
    labels, tested = components(cut(verified(pairs.join(right, "b").join(left, "a"), similarity), dealt=True)), pairs
    for turn in range(rounds):
        fresh = cut(more_pairs(member, labels, tested, turn, similarity), dealt=True)
        links = cut(verified(fresh.join(right, "b").join(left, "a"), similarity), dealt=True)
        if links.isEmpty():
            break
        tested = tested.unionByName(fresh)
        labels = joined_classes(labels, links)
    links = cut(left_links(left_cells(member, labels), texts, similarity), dealt=True)
    if not links.isEmpty():
        labels = joined_classes(labels, links)
    joined = cut(nodes.select("_key", "_least", "_n").join(labels, nodes["_key"] == labels["node"], "left").drop("node"), dealt=True)
    # only classes of several texts are summed up; a text without links is its own class, and keys spread it
    classes = joined.where("label is not null").groupBy(F.col("label").alias("_class")).agg(F.min("_least").alias("_lead"), F.sum("_n").alias("_rows"))
    classes = cut(classes, dealt=True)
    of = joined.withColumn("_own", F.coalesce("label", "_key")).join(classes, F.col("_own") == F.col("_class"), "left")
    of = of.select("_key", F.coalesce("_lead", "_least").alias("_first"), F.coalesce("_rows", "_n").alias("class_size"))
    out = rows.drop("_bands", "_size").join(of, "_key")
    return out.select(
        F.col("_id").alias(id_col), F.hex("_key").alias("text_key"), F.col("_first.id").alias("class_id"), "class_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs``, with their columns, of which each class has one: the least id. Null texts all stay."""
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, similarity, rounds).where("kept").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"))
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    own, text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    some = slim.where(text.isNotNull()).withColumn("_md5", F.upper(F.md5(text.cast("binary")))).withColumn("_own", own)
    joined = some.join(found, some["_own"].eqNullSafe(found["_id"]) & (some["_md5"] == found["_key"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_own", "_md5").orderBy("_own"))  # equal rows with one id
    one = joined.withColumn("_nth", nth).where("_nth = 1").select(*slim.columns)
    out = one.unionByName(slim.where(text.isNull()))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
