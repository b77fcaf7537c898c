"""Reliable lineage cuts in the folder that the cluster shares, and Arrow batches of bounded bytes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import SLICE_BYTES

#: Partitions behind one file of a narrow table.
PARTS_A_FILE = 8
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = 64 << 20


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of about ``SLICE_BYTES``, so that a batch is no larger than what is worked on at once.

    Spark's limit of a batch's bytes is a setting of the session. It is lowered where it is still Spark's own; a value
    that the session's owner has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES) in (f"{_SPARKS_OWN}b", str(_SPARKS_OWN)):
        conf.set(_BATCH_BYTES, str(SLICE_BYTES))
    return df.mapInArrow(run, schema)


def cut(df: DataFrame, narrow: bool = False, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there from now on.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) gets a
    temporary folder, and a cluster an error, because its executors don't share such a folder.

    A table of a few numbers a row needs few files. ``narrow``: ``df`` maps a scan; a file then takes several of its
    splits. ``dealt``: ``df`` ends in a cheap join or sum after an exchange; a file then takes several of its partitions.
    Either way every core keeps two tasks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-checkpoint-"))
    if narrow or dealt:
        parts = df.rdd.getNumPartitions() if narrow else int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(2 * context.defaultParallelism, -(-parts // PARTS_A_FILE)))
    return df.checkpoint(eager=True)
