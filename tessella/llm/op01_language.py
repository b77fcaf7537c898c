"""Language identification with spans of mixed text.

Words are runs of letters. The script of a word (a table of code point ranges) narrows its candidates to the languages
that were learned with this script; a word's score in a candidate is the sum of log-probabilities of its letter
trigrams (hashed, word edges included). Viterbi over the words, with a penalty for each change of language, labels
spans. A text's language is the one with most letters on the best path.

Learning: counts of trigrams from at most about ``docs_per_lang`` labelled documents for each language, taken by id
hash (the documented bound of the classifier's sample); everything else sees all rows and whole texts.

Defined results: null texts and texts without letters are ``und`` with score 0 and no spans; words in a script that
no learned language uses leave all candidates open; without labelled documents every text is ``und``; ties go to the
language first in code-point order; repeated rows are labelled each. A null id is held out. A very long text is worked
on whole, some hundred bytes of a task's memory for each of its words. An empty table gives an empty result. Columns other
than id, text, language and the carried ones aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import in_batches
from ._words import row_slices

BUCKETS = 1 << 15
SWITCH_PENALTY = 8.0
NO_CANDIDATE = 60.0
SCRIPT_SHARE = 0.01
BLOCK = 128

#: First code point of each range and its script; fixed values of the Unicode blocks.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
    (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (0: no letter); the ranges' starts and scripts."""
    letters = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            letters[c] = ord(low) if len(low) == 1 else c
    return letters, np.array([a for a, _ in RANGES]), np.array([SCRIPTS.index(s) for _, s in RANGES])


@dataclass
class Letters:
    """Words of a batch: ``rows`` are word offsets of texts, ``at``/``size`` the words' place in their text."""

    buckets: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    scripts: np.ndarray
    rows: np.ndarray


def letters(texts: list[str | None]) -> Letters:
    table, range_start, range_script = _tables()
    texts = [t or "" for t in texts]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    low = np.concatenate([[0], table[points], [0]]).astype(np.uint64)
    is_letter = low > 0
    starts = np.flatnonzero(is_letter[1:] & ~is_letter[:-1])
    ends = np.flatnonzero(is_letter[:-1] & ~is_letter[1:])
    where = np.flatnonzero(is_letter)
    key = (low[where - 1] * np.uint64(0x1000193) + low[where]) * np.uint64(0x9E3779B97F4A7C15) + low[where + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ key >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    sizes = ends - starts
    rows = np.searchsorted(starts, begin)
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    return Letters(
        buckets=(key >> np.uint64(64 - 15)).astype(np.int64),
        firsts=np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64),
        sizes=sizes,
        at=starts - begin[row],
        scripts=range_script[np.searchsorted(range_start, points[starts], "right") - 1] if len(starts) else np.zeros(0, np.int64),
        rows=rows,
    )


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: log-probability
    allowed: np.ndarray  # script x language

    def word_scores(self, words: Letters) -> np.ndarray:
        if not len(words.sizes):
            return np.zeros((0, len(self.langs)), np.float32)
        scores = np.add.reduceat(self.table[words.buckets], words.firsts, axis=0)
        allowed = self.allowed[words.scripts]
        allowed |= ~allowed.any(axis=1)[:, None]
        return np.where(allowed, scores, scores.min(axis=1)[:, None] - np.float32(NO_CANDIDATE))


def viterbi(scores: np.ndarray, rows: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word, where a change of label between neighbours of a row costs ``penalty``.

    Rows are cut into blocks that advance together. First each block's best path from every entry label to every exit
    label is found, then the blocks of a row are joined, then paths are followed back: exact, in a few hundred array
    steps however long a row is.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    counts = np.diff(rows)
    if not n or k < 2:
        return labels
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = rows[owner] + nth * BLOCK
    size = np.minimum(rows[owner + 1] - start, BLOCK)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first_block = np.cumsum(blocks) - blocks
    active = np.array([np.searchsorted(-size, -t, "left") for t in range(int(size[0]) + 1)])  # blocks longer than t
    steps = int(size[0])

    paths = np.full((len(start), k, k), -penalty) + np.eye(k) * penalty
    paths += scores[start][:, None, :]
    for t in range(1, steps):
        a = paths[: active[t]]
        a[:] = np.maximum(a, a.max(axis=2, keepdims=True) - penalty) + scores[start[: active[t]] + t][:, None, :]

    entry = np.zeros((len(start), k))
    leave = np.zeros((len(counts), k))
    most = int(blocks.max())
    for b in range(most):
        docs = np.flatnonzero(blocks > b)
        at = place[first_block[docs] + b]
        entry[at] = leave[docs]
        out = (leave[docs][:, :, None] + paths[at]).max(axis=1)
        leave[docs] = out - out.max(axis=1, keepdims=True)

    back = np.empty((n, k), np.int8 if k < 128 else np.int32)
    state = entry.copy()
    own = np.arange(k)
    for t in range(steps):
        m = active[t]
        s = state[:m]
        best = s.argmax(axis=1)
        top = s[np.arange(m), best][:, None] - penalty
        back[start[:m] + t] = np.where(s >= top, own, best[:, None])
        state[:m] = np.maximum(s, top) + scores[start[:m] + t]

    came = np.broadcast_to(own, (len(start), k)).copy()
    for t in range(steps - 1, -1, -1):
        m = active[t]
        came[:m] = np.take_along_axis(back[start[:m] + t].astype(np.int64), came[:m], 1)
    last = np.zeros(len(start), np.int64)
    final = leave.argmax(axis=1)
    for b in range(most - 1, -1, -1):
        docs = np.flatnonzero(blocks > b)
        at = place[first_block[docs] + b]
        last[at] = final[docs]
        final[docs] = came[at, final[docs]]
    for t in range(steps - 1, -1, -1):
        m = active[t]
        labels[start[:m] + t] = last[:m]
        last[:m] = back[start[:m] + t, last[:m]]
    return labels


def learn(docs: DataFrame, text_col: str, lang_col: str, id_col: str, docs_per_lang: int = 2000) -> Model:
    """Trigram counts of a bounded, seeded sample of the labelled rows; bounded by languages x (buckets + scripts)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")
    )
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, docs_per_lang / sizes[lang])))])
    chance = F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.where(chance < share[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + len(SCRIPTS), np.int64))
        for b in row_slices(batches, "_text"):
            words = letters(b.column("_text").to_pylist())
            of = b.column("_lang").to_pylist()
            row = np.repeat(np.arange(len(of)), np.diff(words.rows))
            letter_row = np.repeat(row, words.sizes)
            for lang in set(of):
                mine = np.array([x == lang for x in of])
                found[lang][:BUCKETS] += np.bincount(words.buckets[mine[letter_row]], minlength=BUCKETS)
                found[lang][BUCKETS:] += np.bincount(words.scripts[mine[row]], minlength=len(SCRIPTS))
        for lang, n in found.items():
            keys = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n[keys])], names=["lang", "key", "n"])

    counts = in_batches(sample, count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    every[counts["key"], counts["lang"].map({x: i for i, x in enumerate(langs)})] = counts["n"]
    grams, scripts = every[:BUCKETS] + 0.1, every[BUCKETS:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def label(texts: list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> dict:
    """For each text: language, score, and its spans (``offsets`` into ``start``, ``end``, ``lang``)."""
    n, k = len(texts), len(model.langs)
    words = letters(texts)
    if not k:
        zero = np.zeros(0, np.int64)
        return {"pred": np.full(n, -1), "score": np.zeros(n), "offsets": np.zeros(n + 1, np.int64), "start": zero, "end": zero, "lang": zero}
    scores = model.word_scores(words)
    path = viterbi(scores.astype(np.float64), words.rows, penalty)
    row = np.repeat(np.arange(n), np.diff(words.rows))
    mass = np.bincount(row * k + path, weights=words.sizes, minlength=n * k).reshape(n, k)
    total = mass.sum(axis=1)
    pred = np.where(total > 0, mass.argmax(axis=1), -1)
    mine = path == pred[row]
    sums = np.stack([np.bincount(row[mine], weights=scores[mine, j], minlength=n) for j in range(k)], 1)
    sums -= sums.max(axis=1, keepdims=True)
    sure = np.exp(sums)
    sure = sure[np.arange(n), np.maximum(pred, 0)] / sure.sum(axis=1)
    score = np.where(total > 0, mass.max(axis=1) / np.maximum(1, total) * sure, 0.0)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(path)) - 1 if len(head) else head
    return {
        "pred": pred, "score": score, "offsets": np.searchsorted(row[head], np.arange(n + 1)),
        "start": words.at[head], "end": words.at[tail] + words.sizes[tail], "lang": path[head],
    }


def label_languages(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``carry`` with lang_pred, score and spans (start and end in code points of the text, language)."""
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    names = pa.array([*model.langs, "und"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text", 8_000_000 // max(4, len(model.langs))):
            got = label(b.column("_text").to_pylist(), model, penalty)
            pred = np.where(got["pred"] < 0, len(model.langs), got["pred"])
            span = pa.StructArray.from_arrays(
                [pa.array(got["start"], pa.int64()), pa.array(got["end"], pa.int64()), names.take(pa.array(got["lang"]))], ["start", "end", "lang"]
            )
            lists = pa.ListArray.from_arrays(pa.array(got["offsets"], pa.int32()), span)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(carry))), names.take(pa.array(pred)), pa.array(got["score"], pa.float64()), lists],
                names=[*(f"_c{i}" for i in range(len(carry))), "lang_pred", "score", "spans"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))] + ["lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"])
    out = in_batches(slim, run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "spans")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
