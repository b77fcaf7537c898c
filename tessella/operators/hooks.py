"""Where a tokenizer or a model is plugged in."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_ids(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A Column function array<int> from a tokenizer's ``encode``, by Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(t) if t is not None else [])

    return run


def byte_bpe_ends(path: str, pattern: str, most_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """A Column function array<int>: the byte offset behind each token of a text, for a vocabulary of byte-level ranks.

    ``path``: a file of ranks that the driver can read; its bytes (``most_bytes`` at most) go to the workers with the
    function, which make their encoder once a task. ``pattern`` splits texts before they are merged. A null text has none.
    """
    with open(path, "rb") as f:
        raw = f.read(most_bytes + 1)
    if len(raw) > most_bytes:
        raise ValueError(f"{path} has over {most_bytes} bytes")

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        encoder = tiktoken.Encoding("windows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: np.cumsum(size[encoder.encode_ordinary(t)]).astype(np.int32) if t else np.zeros(0, np.int32))

    return run


def predict(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(key, response, success): ``load`` is called once a task; a text that fails gets a null response."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            found = []
            for t in part["t"]:
                try:
                    found.append((model(t), True))
                except Exception:  # one bad text must not end the run; it is reported as such
                    found.append((None, False))
            yield pd.DataFrame({key: part["k"], "response": [f[0] for f in found], "success": [f[1] for f in found]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, response string, success boolean")
