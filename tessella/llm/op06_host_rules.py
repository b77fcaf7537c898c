"""Quality rules with verdicts by host.

Every text is measured whole. Rule failures are summed by host, the hosts' failure rates are shrunk with a beta
prior that is fitted to all hosts (method of moments), and the hosts' verdicts are joined back to the documents:

* a host whose base failures are more than ``reject_rate`` even at the low end of its posterior loses all documents;
* where failures of a soft rule recur on a host (shrunk rate of ``watch_rate`` or more), its documents that fail this
  rule go; elsewhere a soft failure alone is tolerated;
* base failures go everywhere.

Defined results: a null or empty text has no words and fails the base rules. Null hosts are one host. Repeated rows are
measured and counted each. There are no ties: rates are compared with bounds, not with each other. A very long text is
measured whole, some tens of bytes of a task's memory for each of its bytes. An empty table gives an empty result. Columns of the input named like results are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, in_batches
from ._words import NEWLINE, SPACE, hashes, mix, row_slices, row_sums, spans, text_bytes, windows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: One line said twice in a short text is no fault yet.
MIN_DUP_LINES = 2
MAX_ECHO_PERCENT = 30
#: A row of a host has a name and a few numbers: some 20 MB at most.
BROADCAST_HOSTS = 100_000
SALTS = 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")
SOFT = ("symbols", "dup_lines", "echo")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key came earlier."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    data, offsets = text_bytes(column)
    words = spans(data, offsets, SPACE)
    count = np.diff(words.rows)
    inside = ~SPACE[data]
    out = {
        "n_words": count,
        "word_chars": row_sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
    }
    lines = spans(data, offsets, NEWLINE)
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_row = lines.row_of()[full].astype(np.uint64)
    keys = hashes(data, lines.starts[full], lines.ends[full]) ^ mix(line_row + np.uint64(1))
    again = _later(keys)
    out["n_lines"] = np.bincount(line_row.astype(np.int64), minlength=len(count))
    out["n_dup_lines"] = np.bincount(line_row[again].astype(np.int64), minlength=len(count))
    own, row = hashes(data, words.starts, words.ends), words.row_of()
    echo = np.zeros(len(own), bool)
    echo[1:] = (own[1:] == own[:-1]) & (row[1:] == row[:-1])
    out["n_echo_words"] = row_sums(echo, words.rows)
    keys, at = windows(own, words.rows, WINDOW)
    twice = at[_repeated(keys ^ mix(row[at].astype(np.uint64) + np.uint64(1)))]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    out["n_repeat_words"] = row_sums(np.cumsum(edge[:-1]) > 0, words.rows)
    return out


def text_measures(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` and the measures of each document's whole text."""
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "_text"):
            got = measure(b.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(carry))] + [pa.array(got[m], pa.int64()) for m in MEASURES],
                names=[f"_c{i}" for i in range(len(carry))] + list(MEASURES),
            )

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))] + [f"{m} long" for m in MEASURES])
    return in_batches(slim, run, schema)


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failures() -> dict[str, Column]:
    return {
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "dup_lines": (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")) & (F.col("n_dup_lines") >= MIN_DUP_LINES),
        "echo": 100 * F.col("n_echo_words") > MAX_ECHO_PERCENT * F.col("n_words"),
    }


def beta_prior(mean: float | None, var: float | None, size: float | None) -> tuple[float, float]:
    """(alpha, beta) by moments of the hosts' rates; ``size``: the harmonic mean of their document counts.

    The sampling variance of a rate is taken off first. Too little spread means strong shrinkage (10^6 documents' worth);
    without hosts, or with all rates 0 or 1, the prior is a weak one round the mean.
    """
    m = 0.0 if mean is None else float(mean)
    if not 0 < m < 1:
        return (0.5 + m, 1.5 - m)
    noise = m * (1 - m) / max(1.0, float(size or 1))
    spread = max(float(var or 0) - noise, m * (1 - m) / 1e6)
    weight = max(2.0, m * (1 - m) / spread - 1)
    return m * weight, (1 - m) * weight


def host_rates(measured: DataFrame, host: str, rules: dict[str, Column], z: float = 1.96) -> tuple[DataFrame, int]:
    """For each host: n_docs and, for each rule, failures, the shrunk rate and the low end of its posterior; their number."""
    hosts = cut(
        measured.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"), *[F.sum(r.cast("long")).alias(f"fail_{k}") for k, r in rules.items()]
        )
    )
    rate = {k: F.col(f"fail_{k}") / F.col("n_docs") for k in rules}
    moments = hosts.agg(
        (F.count(F.lit(1)) / F.sum(1 / F.col("n_docs"))).alias("size"),
        *[f(rate[k]).alias(f"{n}_{k}") for k in rules for n, f in (("mean", F.avg), ("var", F.var_pop))],
    ).first()
    out = hosts
    for k in rules:
        a, b = beta_prior(moments[f"mean_{k}"], moments[f"var_{k}"], moments["size"])
        total = F.col("n_docs") + F.lit(a + b)
        shrunk = (F.col(f"fail_{k}") + F.lit(a)) / total
        out = out.withColumn(f"rate_{k}", shrunk)
        out = out.withColumn(f"low_{k}", F.greatest(F.lit(0.0), F.col(f"rate_{k}") - z * F.sqrt(F.col(f"rate_{k}") * (1 - F.col(f"rate_{k}")) / (total + 1))))
    return out, hosts.count()


def _with_verdicts(measured: DataFrame, host: str, hosts: tuple[DataFrame, int], reject_rate: float, watch_rate: float) -> DataFrame:
    """``measured`` with _reject, host_fail_rate and _kept.

    Up to ``BROADCAST_HOSTS`` hosts are broadcast, so that rows stay where they are; more are joined by host and salt,
    so that no host's rows meet in one task.
    """
    rates, n_hosts = hosts
    rates = rates.select(
        F.col("host").alias("_host"),
        F.col("rate_base").alias("host_fail_rate"),
        (F.col("low_base") > reject_rate).alias("_reject"),
        *[(F.col(f"rate_{k}") >= watch_rate).alias(f"_watch_{k}") for k in SOFT],
    )
    if n_hosts <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(rates), measured[host].eqNullSafe(rates["_host"]), "left")
    else:
        rates = rates.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        measured = measured.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        joined = measured.join(rates, measured[host].eqNullSafe(rates["_host"]) & (measured["_salt"] == rates["_part"]), "left")
    gone = F.col("_reject")
    for k, failed in soft_failures().items():
        gone = gone | (F.col(f"_watch_{k}") & failed)
    return joined.withColumn("_kept", ~base_failure() & ~gone)


def host_rules(
    docs: DataFrame, carry: list[str], host_col: str = "source", text_col: str = "text", reject_rate: float = 0.5, watch_rate: float = 0.01,
) -> DataFrame:
    """Measures, base_failed, host verdict and kept for each document; the carried columns come back under their names.

    ``carry`` names at least one column of ``docs``; the host is carried as well. The text is read once: the narrow
    measures are written to the shared folder, then summed by host and joined back.
    """
    own = [c for c in carry if c != host_col] + [host_col]
    measured = cut(text_measures(docs, own, text_col), narrow=True)
    host = f"_c{len(own) - 1}"
    rates = host_rates(measured, host, {"base": base_failure()} | soft_failures())
    return _with_verdicts(measured, host, rates, reject_rate, watch_rate).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)],
        *MEASURES,
        base_failure().alias("base_failed"),
        F.col("_reject").alias("host_rejected"),
        "host_fail_rate",
        F.col("_kept").alias("kept"),
    )


def keep_by_host_rules(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", reject_rate: float = 0.5, watch_rate: float = 0.01,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are measured twice, once for the hosts' rates and once beside the rows themselves, so that no text is
    shuffled or written.
    """
    rates = host_rates(text_measures(docs, [host_col], text_col), "_c0", {"base": base_failure()} | soft_failures())
    measured = text_measures(docs, docs.columns, text_col)
    host = f"_c{docs.columns.index(host_col)}"
    kept = _with_verdicts(measured, host, rates, reject_rate, watch_rate).where("_kept")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
