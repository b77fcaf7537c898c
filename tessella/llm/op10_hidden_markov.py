"""Hidden Markov language model of whole corpora.

1. Tokens are counted over all training texts (64-bit hashes; the table of counts stays distributed).
2. The most frequent words are symbols of their own, rarer words fall into classes by their ending. The alphabet is
   bounded, and a word's probability is that of its symbol times the word's share of its class, so probabilities of
   texts stay those of the words.
3. One pass turns all texts into arrays of symbols, which are written to the shared folder; words within the frequent
   table are settled on the spot, the others' counts come from a join on the word hash.
4. Baum-Welch: ``passes`` times over all training texts, expected counts of initial states, transitions and emissions
   are computed in each partition and summed by Spark, in fixed point of 38 digits, so that any order of summing gives the
   same model and no sum overflows.
   It starts from a seeded guess that knows the frequencies of the symbols only.
5. The scaled forward recursion runs over each whole text and gives its exact log-likelihood.

Texts of more than ``SEGMENT`` tokens are worked on in segments side by side. What a segment does to each state it can
be entered in is found first; from these the states at every border follow, forwards and backwards, so that counts and
likelihoods are those of the whole text.

Defined results: null and empty texts are one end token; words unseen in training count 0; a null id is held out;
repeated rows are scored each (and each is learned from); without training rows the model is uniform. A very long text is
stored as two bytes a token and worked on whole: Baum-Welch takes about 170 bytes of a task's memory for each of its
tokens, the forward recursion about 50. There are no ties. An empty table gives an empty result. Columns other than id, text and the
carried ones aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, in_batches
from ._words import SPACE, HashIndex, hashes, row_slices, spans, text_bytes

FREQUENT = 1 << 18
SYMBOLS = 1 << 13
CLASSES = 512
STATES = 8
PASSES = 4
SEGMENT = 512
#: Bytes of symbols that are worked on at once.
SYMBOL_BYTES = 600_000
#: Fixed point of expected counts.
SCALE = float(1 << 20)
END = np.uint64(0x0E1D0E1D0E1D0E1D)
END_CLASS = 0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class) of all tokens, an end token after each text's words, and the texts' offsets."""
    data, offsets = text_bytes(column)
    words = spans(data, offsets, SPACE)
    n = len(offsets) - 1
    rows = words.rows + np.arange(n + 1)
    key, kind = np.full(rows[-1], END, np.uint64), np.full(rows[-1], END_CLASS, np.int32)
    at = np.arange(len(words)) + words.row_of()
    key[at] = hashes(data, words.starts, words.ends, lower=True)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    tail = low[words.ends - 1] * 0x1F35 + low[np.maximum(words.ends - 2, words.starts)] * 0x2B1 + low[np.maximum(words.ends - 3, words.starts)]
    kind[at] = 1 + tail % (CLASSES - 1)
    return key, kind, rows


def token_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """key, kind and count of each distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, at, where = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            return key, np.concatenate([h[1] for h in held])[at], np.bincount(where, weights=np.concatenate([h[2] for h in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            key, kind, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), pa.array(n)], names=["key", "kind", "n"])

        for b in row_slices(batches, "_text"):
            key, kind, _ = tokens(b.column("_text"))
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            held.append((key, kind[at], n))
            size += len(key)
            if size > 2_000_000:
                held = [merged()]
                size = 0
                if len(held[0][0]) > 1_500_000:
                    yield rows()
                    held = []
        if held:
            held = [merged()]
            yield rows()

    found = in_batches(train.select(F.col(text_col).alias("_text")), run, "key long, kind int, n long")
    return found.groupBy("key").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What is known of words everywhere: the frequent ones with counts; symbols; sizes of the classes of the rest."""

    keys: np.ndarray
    counts: np.ndarray
    own: int  # the first so many keys are symbols 0..own-1, class k is symbol own + k
    class_tokens: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    @property
    def alphabet(self) -> int:
        return self.own + CLASSES


def least_frequent(counts: DataFrame, room: int) -> int:
    """The least count so that at most ``room`` words occur as often or more often.

    Words are counted by ranges of their count, and the range in which the room ends is divided again: a few hundred
    rows at a time.
    """
    lo, hi = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1  # within [lo, hi]
    while lo < hi:
        width = max(1, -(-(hi - lo) // 256))
        own = counts.where((F.col("n") >= lo) & (F.col("n") < hi)).groupBy(F.expr(f"(n - {lo}L) div {width}L").alias("at")).agg(F.count(F.lit(1)).alias("v"))
        for r in sorted(own.collect(), key=lambda r: -r["at"]):
            if r["v"] > room:
                begin = lo + r["at"] * width
                lo, hi = (begin + 1, begin + 1) if width == 1 else (begin, min(hi, begin + width))
                break
            room -= r["v"]
        else:
            return lo
    return lo


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent words and the sizes of the classes, from the distributed counts.

    The driver sees at most FREQUENT words, CLASSES rows and the ranges of ``least_frequent``.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    found = counts.where(F.col("n") >= least_frequent(counts, FREQUENT)).select("key", "kind", "n").toPandas()
    found = found.sort_values(["n", "key"], ascending=[False, True])
    own = min(SYMBOLS, len(found))
    by_kind = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens_, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_kind:
        tokens_[r["kind"]], words[r["kind"]] = r["n"], r["v"]
    head = found.iloc[:own]
    tokens_ -= np.bincount(head["kind"], weights=head["n"], minlength=CLASSES)
    words -= np.bincount(head["kind"], minlength=CLASSES)
    return Vocabulary(
        found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), own, tokens_, words, int(total["n"] or 0), int(total["v"])
    )


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # symbol x state


def _normal(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """A model from counts, smoothed so that no symbol is impossible in any state."""
    states = len(start)
    emit = emit + 20.0 * prior[:, None]
    move = move + 1.0 / states
    start = start + 1.0 / states
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _steps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: (first token, their order, how many are longer than t)."""
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    return rows[:-1][order], order, longer


def _run(symbols: np.ndarray, rows: np.ndarray, begin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(state after each sequence's last token, log-likelihood), where ``begin`` is each one's state before its first."""
    first, order, longer = _steps(rows)
    out, end, state = np.zeros(len(rows) - 1), begin[order], None
    for t, m in enumerate(longer):
        state = (begin[order[:m]] if t == 0 else state[:m] @ model.move) * model.emit[symbols[first[:m] + t]]
        norm = state.sum(axis=1)
        state /= norm[:, None]
        out[:m] += np.log(norm)
        end[:m] = state
    back, last = np.empty_like(out), np.empty_like(end)
    back[order], last[order] = out, end
    return last, back


def pieces(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets with every sequence cut into pieces of at most ``most``, the sequence of each piece)."""
    count = -(-np.diff(rows) // most)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.append(np.repeat(rows[:-1], count) + nth * most, rows[-1]), np.repeat(np.arange(len(count)), count)


def borders(symbols: np.ndarray, at: np.ndarray, of: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before each piece's first token, state that was left, weight of each state after its last token).

    Pieces that begin a sequence have the model's start; the weights are up to a factor.
    """
    states = len(model.start)
    opens = np.append(True, of[1:] != of[:-1])[: len(of)]
    before, came, after = np.tile(model.start, (len(of), 1)), np.zeros((len(of), states)), np.ones((len(of), states))
    several = np.flatnonzero(~opens | np.append(~opens[1:], False)[: len(of)])
    if not len(several):
        return before, came, after
    inner = several[~opens[several]]
    heads = several[opens[several]]
    sub = lambda x: (np.concatenate([symbols[at[i] : at[i + 1]] for i in x]), np.concatenate([[0], np.cumsum(at[x + 1] - at[x])]))
    ends = dict(zip(heads.tolist(), _run(*sub(heads), before[heads], model)[0], strict=True))
    # a row for each state that a piece can be entered from: where it leads, and how likely the piece then is
    flat, cut_at = sub(np.repeat(inner, states))
    lead, log = _run(flat, cut_at, np.tile(model.move, (len(inner), 1)), model)
    lead, log = lead.reshape(-1, states, states), log.reshape(-1, states)
    step = dict(zip(inner.tolist(), lead * np.exp(log - log.max(axis=1, keepdims=True))[:, :, None], strict=True))
    for i in inner.tolist():
        came[i] = ends[i - 1]
        before[i] = came[i] @ model.move
        out = came[i] @ step[i]
        ends[i] = out / out.sum()
    for i in inner[::-1].tolist():
        weight = step[i] @ after[i]
        after[i - 1] = weight / weight.max()
    return before, came, after


def forward(symbols: np.ndarray, rows: np.ndarray, model: Model, most: int | None = None) -> np.ndarray:
    """Exact natural log-likelihood of each sequence, by the scaled forward recursion, all sequences side by side."""
    at, of = pieces(rows, most or SEGMENT)
    before, _, _ = borders(symbols, at, of, model)
    return np.bincount(of, weights=_run(symbols, at, before, model)[1], minlength=len(rows) - 1)


def expected(symbols: np.ndarray, rows: np.ndarray, model: Model, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of these sequences: initial states, transitions, emissions; and their log-likelihood."""
    at, of = pieces(rows, most or SEGMENT)
    before, came, after = borders(symbols, at, of, model)
    opens = np.append(True, of[1:] != of[:-1])[: len(of)]
    first, order, longer = _steps(at)
    before, came, after, opens = before[order], came[order], after[order], opens[order]
    states = len(model.start)
    place = np.concatenate([[0], np.cumsum(longer)])
    where = np.concatenate([first[:m] + t for t, m in enumerate(longer)]) if len(longer) else np.zeros(0, np.int64)
    ordered = symbols[where]
    seen = model.emit[ordered]
    alpha, norms = np.empty((len(ordered), states)), np.empty(len(ordered))
    for t, m in enumerate(longer):
        lo, hi = place[t], place[t + 1]
        a = (alpha[place[t - 1] : place[t - 1] + m] @ model.move if t else before[:m]) * seen[lo:hi]
        norms[lo:hi] = a.sum(axis=1)
        alpha[lo:hi] = a / norms[lo:hi, None]
    moves, start = np.zeros((states, states)), np.zeros(states)
    seen /= norms[:, None]
    beta = np.zeros((0, states))
    for t in range(len(longer) - 1, -1, -1):
        lo, hi, m = place[t], place[t + 1], longer[t]
        ended = after[len(beta) : m]  # sequences whose last token this is: weights so that its states' shares sum to one
        beta = np.concatenate([beta, ended / (alpha[lo + len(beta) : hi] * ended).sum(axis=1, keepdims=True)])
        ahead = seen[lo:hi] * beta
        alpha[lo:hi] *= beta
        if t:
            moves += alpha[place[t - 1] : place[t - 1] + m].T @ ahead
            beta = ahead @ model.move.T
        else:
            moves += came[:m].T @ ahead  # over the borders; nothing came before a first piece
            start = alpha[lo:hi][opens[:m]].sum(axis=0)
    emitted = np.stack([np.bincount(ordered, weights=alpha[:, s], minlength=len(model.emit)) for s in range(states)], 1)
    return start, moves * model.move, emitted, float(np.log(norms).sum())


def _symbols(key: np.ndarray, kind: np.ndarray, index: HashIndex, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, place in the frequent table or -1) of tokens."""
    where = index.find(key)
    return np.where((where >= 0) & (where < own), where, own + kind), where


def symbol_rows(docs: DataFrame, learn_from: Column, words: Vocabulary, carry: list[str], text_col: str) -> DataFrame:
    """``_c0``, ..., _row, _train, n_tokens, and of each text: _sym (two bytes a token), _known, _base, _share, _rare.

    _known: tokens in the frequent table; _base: their and all tokens' part of the base score; _share: the words' shares of
    their classes; _rare: hashes of the words whose counts are still to be joined.
    """
    keys, known, own = words.keys, words.counts, words.own
    class_log = np.log10(words.class_tokens + words.class_words + 1)
    base_log = float(np.log10(words.total + words.distinct + 1))
    slim = docs.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.monotonically_increasing_id().alias("_row"), F.coalesce(learn_from, F.lit(False)).alias("_train"), F.col(text_col).alias("_text")
    )
    n = len(carry) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(keys)
        count_log = np.log10(known + 1.0)
        for b in row_slices(batches, "_text"):
            key, kind, at = tokens(b.column("_text"))
            symbol, where = _symbols(key, kind, index, own)
            found = np.where(where >= 0, count_log[where] if len(known) else 0.0, 0.0)
            rare = np.flatnonzero(where < 0)
            arrays = [
                *(b.column(i) for i in range(n)),
                pa.array(np.diff(at), pa.int64()),
                _binary(symbol.astype(np.uint16), at),
                pa.array(np.add.reduceat((where >= 0).astype(np.int64), at[:-1]), pa.int64()),
                pa.array(np.add.reduceat(found - base_log, at[:-1])),
                pa.array(np.add.reduceat(np.where(symbol < own, 0.0, found - class_log[kind]), at[:-1])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at), pa.int32()), pa.array(key[rare].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:n], "n_tokens", "_sym", "_known", "_base", "_share", "_rare"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"{c} {kinds[c]}" for c in slim.columns[:n]] + ["n_tokens long, _sym binary, _known long, _base double, _share double, _rare array<long>"])
    return in_batches(slim, run, schema)


def _binary(symbol: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(symbol)])


def _symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return data.view(np.uint16).astype(np.int32) if len(data) else np.zeros(0, np.int32), offsets // 2


def train(rows: DataFrame, words: Vocabulary, states: int, passes: int, seed: int) -> Model:
    """The model after ``passes`` of Baum-Welch over all ``rows`` (_sym)."""
    prior = np.concatenate([words.counts[: words.own], words.class_tokens]) + 1.0
    prior /= prior.sum()
    rng = np.random.Generator(np.random.PCG64(seed))
    # states that are seldom left: what tells texts apart is found in a few passes
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
    move = np.full((states, states), 0.05 / states) + 0.95 * np.eye(states)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    slim = rows.select("_sym")
    for _ in range(passes):
        now = model

        def counted(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            begin, moved, sent = np.zeros(states), np.zeros((states, states)), np.zeros(now.emit.shape)
            for b in row_slices(batches, "_sym", SYMBOL_BYTES):
                x, y, z, _ = expected(*_symbols_of(b.column("_sym")), now)
                begin += x
                moved += y
                sent += z
            every = np.rint(np.concatenate([begin[None], moved, sent]) * SCALE).astype(np.int64)
            some = np.flatnonzero(every.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(every[some, j]) for j in range(states))], names=["r", *(f"s{j}" for j in range(states))])

        sums = in_batches(slim, counted, "r long, " + ", ".join(f"s{j} long" for j in range(states)))
        # one row for each symbol and state, bounded by the alphabet
        wide = [F.sum(F.col(f"s{j}").cast("decimal(20, 0)")).alias(f"s{j}") for j in range(states)]
        got = sums.groupBy("r").agg(*wide).toPandas()
        every = np.zeros((1 + states + len(prior), states))
        if len(got):
            every[got["r"]] = got[[f"s{j}" for j in range(states)]].to_numpy(np.float64) / SCALE
        model = _normal(every[0], every[1 : 1 + states], every[1 + states :], prior)
    return model


def hmm_scores(
    docs: DataFrame, learn_from: Column, carry: list[str], text_col: str = "text", states: int = STATES, passes: int = PASSES, seed: int = 11,
) -> DataFrame:
    """``carry``, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model), both log10."""
    counts = cut(token_counts(docs.where(learn_from), text_col))
    words = vocabulary(counts)
    read = cut(symbol_rows(docs, learn_from, words, carry, text_col), narrow=True)
    model = train(read.where("_train"), words, states, passes, seed)
    own = [f"_c{i}" for i in range(len(carry))]
    slim = read.select(*own, "_row", "n_tokens", "_known", "_base", "_share", "_sym")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_sym", SYMBOL_BYTES):
            score = forward(*_symbols_of(b.column("_sym")), model) / np.log(10) + b.column("_share").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own) + 4], pa.array(score)], names=[*b.schema.names[: len(own) + 4], "_score"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    scored = in_batches(slim, run, ", ".join([*(f"{c} {kinds[c]}" for c in slim.columns[: len(own) + 4]), "_score double"]))
    rest = read.select("_row", F.explode("_rare").alias("key")).join(counts.select("key", "n"), "key")
    rest = rest.groupBy("_row").agg(F.count(F.lit(1)).alias("_more"), F.sum(F.log10(F.col("n") + 1.0)).alias("_sum"))
    out = scored.join(rest, "_row", "left")
    more = F.coalesce("_sum", F.lit(0.0))
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("_base") + more).alias("base_score"), (F.col("_score") + more).alias("score"),
    )


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
