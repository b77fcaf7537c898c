"""Co-training of two views of a document: what its text says and what its metadata says.

* The text view sees hashed words (log-odds of the classes by document frequency: their sum, extremes, and what the
  telling ones add up to) and the shape of the text: symbols, digits, capitals, repeats, line and word lengths.
* The metadata view sees source, language and length.

Each round, both views are trained and calibrated on labelled rows that train nothing (Platt scaling). Each picks the
unlabelled documents it is surest of by its calibrated probability, out of all there are: ``PICKS`` of them, positive and
negative ones in the ratio of the labels (where there are too few of one class, fewer of the other). These pseudo-labels
join the other view's training rows. A view that tells the rows set aside no better than the share of the classes does
(by their log loss, calibrated on one half of them and measured on the other) picks nothing and has no say in the scores.
A round after which the combination tells those rows worse than before is taken back, and is the target's last. At last a
logistic combination of the calibrated views, fitted on the same rows, scores every document. ``PICKS`` is a parameter of
the learner, as ``labelled_rows`` is: it bounds what the driver trains on, while all documents are candidates.

Features of all documents are computed once, from whole texts, and written to the shared folder; each round and the last
scores read them from there. Models are fitted on the driver to at most about ``labelled_rows`` labelled documents, taken
by id hash (the documented bound of the classifier's sample; one row for each id), with all their words, and to the
picks. Documents outside this sample are the unlabelled ones: all of them are candidates of each round.

Defined results: null texts are empty texts; null metadata is a value of its own; documents without labels are scored
like all others; labels for unknown documents and null ids are ignored, and a null label is none; of several labels of
an id the largest counts, of several texts of an id one trains; if the labels have one class only, its share is
everyone's score; without labels the score is 0.5; if the rows set aside for calibration or those left to train have
one class only (a few labels), all train and calibrate; repeated rows are scored each. Very long texts are read whole,
one at a time. An empty table gives an empty result. Columns other than id, text, metadata and the carried ones aren't
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._store import cut, in_batches
from ._words import NEWLINE, SPACE, hashes, row_slices, row_sums, spans, text_bytes

BUCKETS = 1 << 16
SHAPES = 9
DERIVED = 7
#: Log-odds beyond which a word speaks for itself.
TELLING = 1.5
ROUNDS = 3
PICKS = 200
SURE = 0.9
#: Share of the prior's loss that a view has to save, and the rows of each class set aside from which on it is asked to.
GAIN, ENOUGH = 0.02, 10

_CLASSES = {n: np.isin(np.arange(256), list(b)) for n, b in {"symbol": b"#*$%&|<>@^~_=+{}[]\\", "digit": b"0123456789", "upper": bytes(range(65, 91)), "bang": b"!?"}.items()}


@dataclass
class Batch:
    """Features of a batch: distinct word buckets of each text (flat, with offsets) and dense shapes."""

    buckets: np.ndarray
    rows: np.ndarray
    shapes: np.ndarray


def text_features(column: pa.Array) -> Batch:
    data, offsets = text_bytes(column)
    words = spans(data, offsets, SPACE)
    n = np.maximum(1, np.diff(words.rows))
    size = np.maximum(1, np.diff(offsets))
    row = words.row_of()
    key = hashes(data, words.starts, words.ends, lower=True)
    whole = np.unique(row << 16 | (key >> np.uint64(48)).astype(np.int64))  # row and bucket
    rows = np.searchsorted(whole >> 16, np.arange(len(offsets)))
    lines = np.diff(spans(data, offsets, NEWLINE).rows)
    again = np.zeros(len(key), bool)
    if len(key) > 1:
        again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    dense = [row_sums(_CLASSES[c][data], offsets) / size for c in ("symbol", "digit", "upper", "bang")]
    dense += [np.diff(rows) / n, np.bincount(row[again], minlength=len(n)) / n, np.log1p(size / n), np.log1p(n), np.log1p(n / np.maximum(1, lines))]
    return Batch(whole & (BUCKETS - 1), rows, np.stack(dense, 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    cost = np.full(x.shape[1], ridge)
    cost[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(cost), x.T @ (weight * (y - p)) - cost * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return w[0] + x @ w[1:]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class TextView:
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def dense(self, b: Batch) -> np.ndarray:
        return (_dense(b, self.odds) - self.mean) / self.scale

    def logit(self, b: Batch) -> np.ndarray:
        return _apply(self.weights, self.dense(b))


def _dense(b: Batch, odds: np.ndarray) -> np.ndarray:
    """Shapes, sums and extremes of the word log-odds, and what the telling words of either side add up to."""
    n = np.diff(b.rows)
    value = np.append(odds[b.buckets], 0.0)
    begin = np.minimum(b.rows[:-1], len(value) - 1)

    def over(f: np.ufunc, x: np.ndarray) -> np.ndarray:
        return np.where(n > 0, f.reduceat(x, begin), 0.0)

    root = np.sqrt(np.maximum(1, n))
    strong = over(np.add, np.maximum(value - TELLING, 0))
    return np.column_stack([
        b.shapes, over(np.add, value) / root, over(np.minimum, value), over(np.maximum, value),
        strong, over(np.add, (value > TELLING).astype(float)), over(np.add, np.maximum(-value - TELLING, 0)), strong / root,
    ])


def _take(b: Batch, at: np.ndarray) -> Batch:
    size = np.diff(b.rows)[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(b.rows[at] - ends[:-1], size) + np.arange(ends[-1])
    return Batch(b.buckets[flat], ends, b.shapes[at])


def fit_text(b: Batch, y: np.ndarray) -> TextView:
    """Word log-odds from one half of the rows weigh in on the other half, and the other way round, as on new rows."""
    row = np.repeat(np.arange(len(y)), np.diff(b.rows))

    def odds(use: np.ndarray) -> np.ndarray:
        mine = use[row]
        one = np.bincount(b.buckets[mine], weights=y[row[mine]], minlength=BUCKETS)
        all_ = np.bincount(b.buckets[mine], minlength=BUCKETS)
        share = (y[use].sum() + 0.5) / (use.sum() + 1)
        out = np.log((one + 2 * share) / (all_ - one + 2 * (1 - share))) - np.log(share / (1 - share))
        return np.where(all_ >= 2, out, 0.0)

    half = np.arange(len(y)) % 2 == 0
    x = np.zeros((len(y), SHAPES + DERIVED))
    for mine in (half, ~half):
        at = np.flatnonzero(mine)
        x[at] = _dense(_take(b, at), odds(~mine))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return TextView(odds(np.ones(len(y), bool)), mean, scale, _logistic((x - mean) / scale, y))


@dataclass
class MetaView:
    """Smoothed class log-odds of each source and language, and the length."""

    odds: list[dict]
    weights: np.ndarray

    def dense(self, meta: list[tuple], length: np.ndarray) -> np.ndarray:
        return np.column_stack([np.array([self.odds[j].get(m[j], 0.0) for m in meta], float).reshape(len(meta)) for j in range(len(self.odds))] + [length, length**2])

    def logit(self, meta: list[tuple], length: np.ndarray) -> np.ndarray:
        return _apply(self.weights, self.dense(meta, length)) if len(meta) else np.zeros(0)


def fit_meta(meta: list[tuple], length: np.ndarray, y: np.ndarray) -> MetaView:
    share = (y.sum() + 0.5) / (len(y) + 1)
    odds = []
    for j in range(len(meta[0])):
        seen: dict = {}
        for m, v in zip(meta, y.tolist(), strict=True):
            n, k = seen.get(m[j], (0, 0))
            seen[m[j]] = (n + 1, k + v)
        odds.append({v: float(np.log((k + 20 * share) / (n - k + 20 * (1 - share))) - np.log(share / (1 - share))) for v, (n, k) in seen.items()})
    view = MetaView(odds, np.zeros(1))
    view.weights = _logistic(view.dense(meta, length), y)
    return view


@dataclass
class Model:
    text: TextView | None
    meta: MetaView | None
    platt_text: np.ndarray
    platt_meta: np.ndarray
    joint: np.ndarray
    share: float

    def score(self, b: Batch, meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view's, metadata view's) probabilities."""
        n = len(b.shapes)
        if self.text is None:
            flat = np.full(n, self.share)
            return flat, flat, flat
        a = _apply(self.platt_text, self.text.logit(b)[:, None])
        m = _apply(self.platt_meta, self.meta.logit(meta, b.shapes[:, 7])[:, None])
        return _sigmoid(_apply(self.joint, np.column_stack([a, m]))), _sigmoid(a), _sigmoid(m)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of log-odds."""
    z = np.clip(z, -30, 30)
    return float(np.mean(np.log1p(np.exp(z)) - y * z)) if len(y) else 0.0


def _crossed(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Log-odds of each row by the regression on the other half of the rows, both halves with their share of the classes."""
    half = np.zeros(len(y), bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    out = np.zeros(len(y))
    for mine in (half, ~half):
        out[mine] = _apply(_logistic(x[~mine], y[~mine], ridge), x[mine])
    return out


@dataclass
class Calibrated:
    """Both views with their Platt weights, and whether each tells the rows set aside better than the prior."""

    views: tuple[TextView, MetaView]
    platt: list[np.ndarray]
    useful: list[bool]
    joint: np.ndarray
    loss: float  # of the combination on the rows set aside

    def chances(self, b: Batch, meta: list[tuple]) -> list[np.ndarray]:
        """Each view's calibrated probabilities, rounded so that they don't depend on how rows are batched."""
        z = self.views[0].logit(b), self.views[1].logit(meta, b.shapes[:, 7])
        return [np.round(_sigmoid(_apply(w, v[:, None])), 9) for w, v in zip(self.platt, z, strict=True)]


class CoTraining:
    """The training rows of both views for one target: labelled ones, and picks of the other view."""

    def __init__(self, y: np.ndarray):
        known = np.flatnonzero(~np.isnan(y))
        self.share = float(y[known].mean()) if len(known) else 0.5
        self.held, train = known[::5], np.setdiff1d(known, known[::5])
        if min(len(np.unique(y[self.held])), len(np.unique(y[train]))) < 2:
            self.held = train = known
        self.y, self.rows = y, {"text": (train, y[train]), "meta": (train, y[train])}
        self.trivial = len(np.unique(y[known])) < 2
        self.done = self.trivial

    def add(self, to: str, at: list[int], target: list[float]) -> None:
        own, before = self.rows[to]
        self.rows[to] = np.concatenate([own, np.array(at, own.dtype)]), np.concatenate([before, target])

    def views(self, b: Batch, meta: list[tuple]) -> tuple[TextView, MetaView]:
        at, target = self.rows["meta"]
        return fit_text(_take(b, self.rows["text"][0]), self.rows["text"][1]), fit_meta([meta[i] for i in at], b.shapes[at, 7], target)

    def calibrated(self, b: Batch, meta: list[tuple]) -> Calibrated:
        (text, view), held = self.views(b, meta), self.held
        y = self.y[held]
        z = text.logit(_take(b, held))[:, None], view.logit([meta[i] for i in held], b.shapes[held, 7])[:, None]
        platt = [_logistic(v, y, 0.01) for v in z]
        prior = _loss(np.full(len(y), np.log(y.mean() / (1 - y.mean()))), y)
        asked = min(y.sum(), len(y) - y.sum()) >= ENOUGH
        useful = [not asked or _loss(_crossed(v, y, 0.01), y) < (1 - GAIN) * prior for v in z]
        both = np.column_stack([_apply(w, v) * u for w, v, u in zip(platt, z, useful, strict=True)])
        return Calibrated((text, view), platt, useful, _logistic(both, y, 0.1) * np.array([True, *useful]), _loss(_crossed(both, y, 0.1), y) if asked else 0.0)

    def model(self, b: Batch, meta: list[tuple]) -> Model:
        if self.trivial:
            return Model(None, None, np.zeros(2), np.zeros(2), np.zeros(3), self.share)
        c = self.calibrated(b, meta)
        return Model(*c.views, *c.platt, c.joint, self.share)

    def quotas(self, picks: int) -> tuple[int, int]:
        """The most picks of the negative and the positive class, in the ratio of the labels."""
        positive = round(picks * self.share)
        return picks - positive, positive

    def balanced(self, negative: list, positive: list) -> list:
        """As many of each, the surest first, as the ratio of the labels allows."""
        ratio = self.share / (1 - self.share)
        return [*negative[: round(len(positive) / ratio)], *positive[: round(len(negative) * ratio)]]


def features(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """_row, _id, ``_m0``, ... (metadata), ``_c0``, ... (``carry``), w (word buckets) and s (shapes) of each document, written."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), *[F.col(c).cast("string").alias(f"_m{j}") for j, c in enumerate(meta)],
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text"):
            got = text_features(b.column("_text"))
            words = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * got.rows).astype(np.int32)), pa.py_buffer(got.buckets.astype(np.int32))])
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * 8 * SHAPES
            shapes = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(got.shapes))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], words, shapes], names=[*b.schema.names[:-1], "w", "s"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return cut(in_batches(slim, run, ", ".join([*kinds, "w binary, s binary"])))


def _batch(w: pa.Array, s: pa.Array) -> Batch:
    words, at = text_bytes(w)
    shapes, _ = text_bytes(s)
    return Batch(words.view(np.int32).astype(np.int64) if len(words) else np.zeros(0, np.int64), at // 4, shapes.view(np.float64).reshape(len(s), SHAPES) if len(s) else np.zeros((0, SHAPES)))


def _meta(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[b.column(c).to_pylist() for c in b.schema.names if c.startswith("_m")], strict=True))


def most_sure(featured: DataFrame, views: list[Calibrated | None], most: list[tuple[int, int]], gone: list[set[int]], labelled: pa.Array) -> list:
    """For each target, view and class the unlabelled documents that the view is surest of: (k, sure, features).

    k is four times the target's place, plus two for the metadata view, plus one for the positive class, of which there
    are ``most[target][class]`` at most. Every task sends no more than these, and they are ranked in as many parts as
    there are tasks' worth of them before they are ranked together.
    """
    meta = [c for c in featured.columns if c.startswith("_m")]
    slim = featured.select("_row", "_id", *meta, "w", "s")
    out = ["k", "sure", *slim.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        by = [("sure", "descending"), ("_id", "ascending"), ("w", "ascending"), ("s", "ascending"), ("_row", "ascending")]
        for b in row_slices(batches, "w"):
            b = b.filter(pc.invert(pc.is_in(b.column("_id"), value_set=labelled))) if len(labelled) else b
            if not b.num_rows:
                continue
            got, data, row = _batch(b.column("w"), b.column("s")), _meta(b), b.column("_row").to_numpy()
            for j, own in enumerate(views):
                if own is None:
                    continue
                free = ~np.isin(row, np.fromiter(gone[j], np.int64, len(gone[j])))
                for v, p in enumerate(own.chances(got, data)):
                    for c, sure in enumerate((1 - p, p)):
                        at = np.flatnonzero(free & (sure >= SURE)) if own.useful[v] and most[j][c] else []
                        if len(at):
                            k = 4 * j + 2 * v + c
                            more = pa.Table.from_batches([b.take(pa.array(at))]).append_column("sure", pa.array(sure[at]))
                            every = pa.concat_tables([best[k], more]) if k in best else more
                            best[k] = every.take(pc.sort_indices(every, sort_keys=by)[: most[j][c]])
        for k, t in best.items():
            t = t.append_column("k", pa.array([k] * t.num_rows, pa.int32())).select(out)
            yield from t.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    found = in_batches(slim, run, ", ".join(["k int, sure double", *(f"{c} {kinds[c]}" for c in slim.columns)]))
    order, parts = [F.desc("sure"), F.col("_id").asc_nulls_last(), "w", "s", "_row"], max(1, int(featured.rdd.getNumPartitions() ** 0.5))
    limit = F.element_at(F.array(*[F.lit(n) for pair in most for _ in (0, 1) for n in pair]), F.col("k") + 1)
    for part in (["k", F.pmod(F.shiftright("_row", 33), F.lit(parts))], ["k"]):
        found = found.withColumn("_nth", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_nth") <= limit).drop("_nth")
    return sorted(found.collect(), key=lambda r: (r["k"], -r["sure"], r["_id"] is None, r["_id"], bytes(r["w"]), bytes(r["s"])))


def fit(featured: DataFrame, labels: DataFrame, targets: list[str], id_col: str = "doc_id", labelled_rows: int = 4000, rounds: int = ROUNDS, picks: int = PICKS, seed: int = 5) -> dict[str, Model]:
    """A model for each target column of ``labels``."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(*[F.max(t).cast("double").alias(f"_y{j}") for j, t in enumerate(targets)])
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("_lid").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    known = own.where(chance < min(1.0, labelled_rows / max(1, own.count())))  # distinct ids, so that about labelled_rows is a bound
    meta = [c for c in featured.columns if c.startswith("_m")]
    some = featured.join(F.broadcast(known), featured["_id"] == known["_lid"])
    some = some.groupBy("_lid").agg(F.min(F.struct("w", "s", *meta)).alias("f"), *[F.first(f"_y{j}").alias(f"_y{j}") for j in range(len(targets))])
    rows = sorted(some.collect(), key=lambda r: str(r["_lid"]))
    labelled = pa.array([r["_lid"] for r in rows], to_arrow_type(featured.schema["_id"].dataType))
    w, s, data = [bytes(r["f"]["w"]) for r in rows], [bytes(r["f"]["s"]) for r in rows], [tuple(r["f"][c] for c in meta) for r in rows]
    training = [CoTraining(np.array([np.nan if r[f"_y{j}"] is None else r[f"_y{j}"] for r in rows], float)) for j in range(len(targets))]
    gone: list[set[int]] = [set() for _ in targets]
    batch = lambda: _batch(pa.array(w, pa.binary()), pa.array(s, pa.binary()))
    b = batch()
    now = [None if t.trivial else t.calibrated(b, data) for t in training]
    for _ in range(rounds):
        if all(t.done for t in training):
            break
        found: dict[int, list] = {}
        for r in most_sure(featured, [None if t.done else c for t, c in zip(training, now, strict=True)], [t.quotas(picks) for t in training], gone, labelled):
            if r["_row"] not in gone[r["k"] // 4]:  # the text view, which comes first, may have picked it in this round
                found.setdefault(r["k"], []).append(r)
                gone[r["k"] // 4].add(r["_row"])
        before = [dict(t.rows) for t in training]
        for j, t in enumerate(training):
            for v, to in enumerate(("meta", "text")):
                own = t.balanced(found.get(4 * j + 2 * v, []), found.get(4 * j + 2 * v + 1, []))
                t.add(to, list(range(len(w), len(w) + len(own))), [float(r["k"] & 1) for r in own])
                w += [bytes(r["w"]) for r in own]
                s += [bytes(r["s"]) for r in own]
                data += [tuple(r[c] for c in meta) for r in own]
        b = batch()
        for j, t in enumerate(training):
            if not t.done:
                then = t.calibrated(b, data)
                if then.loss > now[j].loss or all(len(t.rows[x][0]) == len(before[j][x][0]) for x in t.rows):
                    t.rows, t.done = before[j], True
                else:
                    now[j] = then
    return {t: x.model(b, data) for t, x in zip(targets, training, strict=True)}


def scored(featured: DataFrame, models: dict[str, Model], carry: list[str]) -> DataFrame:
    """``carry`` and, for each target, its combined probability and those of the two views."""
    own = [f"_c{i}" for i in range(len(carry))]
    slim = featured.select(*own, *[c for c in featured.columns if c.startswith("_m")], "w", "s")
    names = [f"{t}{v}" for t in models for v in ("_score", "_text_view", "_meta_view")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "w"):
            got, data = _batch(b.column("w"), b.column("s")), _meta(b)
            found = [pa.array(x) for m in models.values() for x in m.score(got, data)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *found], names=[*own, *names])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    out = in_batches(slim, run, ", ".join([*(f"{c} {kinds[c]}" for c in own), *(f"{n} double" for n in names)]))
    return out.select(*[F.col(c).alias(x) for c, x in zip(own, carry, strict=True)], *names)


def learn(
    docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang"), **how,
) -> dict[str, Model]:
    """A model for each target column of ``labels``; ``how`` as in ``fit``."""
    return fit(features(docs, [], id_col, text_col, meta), labels, targets, id_col, **how)


def scores(docs: DataFrame, models: dict[str, Model], carry: list[str], id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """As ``scored``, from documents."""
    return scored(features(docs, carry, id_col, text_col, meta), models, carry)


def co_trained(docs: DataFrame, labels: DataFrame, targets: list[str], carry: list[str], id_col: str = "doc_id", **how) -> DataFrame:
    """Learn and score the same documents, whose features are computed once."""
    featured = features(docs, carry, id_col)
    return scored(featured, fit(featured, labels, targets, id_col, **how), carry)
