"""Documents put together from their windows' predictions while these arrive, in any order and more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "strategy string, sample_id long, actual_codes array<string>, predicted_codes array<string>, num_chunks long, complete boolean"
STATE = "seen array<int>, codes array<string>, actual array<string>, total int, done boolean"


def complete_documents(windows: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Each document once: when its last window is there, or ``wait`` after a window came while others are still missing.

    ``windows``: a stream of strategy, sample_id, chunk_idx, total_chunks, actual_codes and codes (null where a window's
    prediction failed: it counts as there, without codes). The result has the union of the codes, in order, the number
    of windows and whether all were there; ``score.scored`` gives its scores. A window that comes again is passed over,
    also after its document is out, as long as the state is held: until ``wait`` has gone by without a window of it. The
    state of a document is its distinct codes and window numbers. Windows without a number of windows are left out.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, codes, actual, total, done = state.get if state.exists else ([], [], None, 0, False)
        seen, codes = set(seen), set(codes)

        def row(complete: bool) -> pd.DataFrame:
            return pd.DataFrame({
                "strategy": [key[0]], "sample_id": [key[1]], "actual_codes": [None if actual is None else list(actual)], "predicted_codes": [sorted(codes)],
                "num_chunks": [len(seen)], "complete": [complete],
            })

        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(False)
            return
        for part in parts:
            for idx, n, own, found in zip(part["chunk_idx"], part["total_chunks"], part["actual_codes"], part["codes"], strict=True):
                if done or idx in seen:
                    continue
                seen.add(int(idx))
                total = int(n)
                actual = actual if own is None else list(own)
                codes.update(found if found is not None else ())
        out = not done and total > 0 and len(seen) >= total
        state.update(([], [], None, total, True) if out or done else (sorted(seen), sorted(codes), actual, total, False))
        state.setTimeoutDuration(wait_ms)
        if out:
            yield row(True)

    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    own = windows.where(F.col("total_chunks").isNotNull() & F.col("chunk_idx").isNotNull()).select(
        "strategy", F.col("sample_id").cast("long").alias("sample_id"), F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("total_chunks").cast("int").alias("total_chunks"), "actual_codes", "codes"
    )
    return own.groupBy("strategy", "sample_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
