"""Sources: CSV and JSON with schemas, tagged splits, term lists, latest files, checkpoints."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split_records

NOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("hadm_id", "subject_id", "text")])
DIAGNOSES = T.StructType(
    [T.StructField("subject_id", T.StringType()), T.StructField("hadm_id", T.StringType()), T.StructField("seq_num", T.IntegerType()), T.StructField("icd_code", T.StringType())]
)
SAMPLE_RESULT = "sample_id long, subject_id long, actual_codes array<string>, predicted_codes array<string>, num_chunks int, success boolean, precision double, recall double, f1 double, tp long, fp long, fn long"


def csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """CSV with header; fields may hold line feeds and doubled quotes, and an empty one is null. Only ``columns`` are parsed, if given.

    A file is read in as many splits as Spark makes of it. Line ends within fields are kept as they are.
    """
    found = split_records.records(spark, path, split_records.Csv(), header=True).where(F.length(F.rtrim("value", F.lit("\r\n"))) > 0)
    fields = found.select(split_records.csv_fields(F.col("value"), schema if isinstance(schema, str) else schema.toDDL()).alias("_r"))
    return fields.select([f"_r.{c}" for c in columns] if columns else "_r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system knows the path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def splits(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | str) -> DataFrame:
    """All splits whose file exists, tagged with their name; an error if there is none."""
    parts = [csv(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items() if exists(spark, p)]
    if not parts:
        raise FileNotFoundError(f"no split found: {dict(paths)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that are one JSON array of objects each, read in as many splits as Spark makes of them."""
    return split_records.records(spark, path, split_records.Json()).select(F.from_json("value", schema).alias("_r")).select("_r.*")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Sample results of evaluation reports that have scores and a patient. No task holds a whole report."""
    found = split_records.records(spark, path, split_records.Json("sample_results"))
    rows = found.select(F.from_json("value", SAMPLE_RESULT).alias("_r")).select("_r.*")
    return rows.where(F.col("tp").isNotNull() & F.col("subject_id").isNotNull())


def files(spark: SparkSession, glob: str) -> DataFrame:
    """path, name and modification time of the files; contents aren't read. A part of a folder that Spark wrote has the folder's name."""
    df = spark.read.format("binaryFile").load(glob).select("path", "modificationTime")
    steps = F.split("path", "/")
    return df.withColumn("name", F.element_at(steps, F.when(F.startswith(F.element_at(steps, -1), F.lit("part-")), -2).otherwise(-1)))


def latest_by_time(spark: SparkSession, glob: str) -> str | None:
    """The file modified last (by name of several)."""
    return files(spark, glob).agg(F.max_by("path", F.struct("modificationTime", "name"))).first()[0]


def latest_by_name(spark: SparkSession, glob: str) -> str | None:
    """The last file in order of names: not always the one modified last."""
    return files(spark, glob).agg(F.max_by("path", "name")).first()[0]


def match_name(wanted: str, names: list[str]) -> str | None:
    """The name that is equal, else begins with, else contains ``wanted``; the first in order."""
    names = sorted(names)
    for test in (lambda n: n == wanted, lambda n: n.startswith(wanted), lambda n: wanted in n):
        if found := next((n for n in names if test(n)), None):
            return found
    return None


def terms(spark: SparkSession, path: str, column: str = "term") -> DataFrame:
    """A term list: the column of a CSV, or the lines of a text file; blank terms are dropped."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True).select(F.col(column).alias("term"))
    else:
        df = spark.read.text(path).select(F.col("value").alias("term"))
    return df.select(F.btrim("term").alias("term")).where("term <> ''")


def step_of(name: Column, default: int | None = None) -> Column:
    """The number of checkpoint-<number>."""
    return F.coalesce(F.regexp_extract(name, "^checkpoint-([0-9]+)$", 1).try_cast("bigint"), F.lit(default).cast("bigint"))


def checkpoints(names: DataFrame, least: int = 0) -> DataFrame:
    """(name, step) of the checkpoint folders from ``least`` on, in order of step."""
    own = names.select("name", step_of(F.col("name")).alias("step"))
    return own.where(F.col("step") >= least).orderBy("step")


def best_checkpoint(spark: SparkSession, stored: str, default: str, variable: str = "CHECKPOINT_PATH", required: bool = True) -> str:
    """The first path that exists: the stored file's ``checkpoint``, the environment's variable, the default.

    A stored file that is missing or isn't JSON has none. If no path exists: an error, or the default if not ``required``.
    """
    found = [os.environ.get(variable), default]
    if exists(spark, stored):
        row = spark.read.schema("checkpoint string").json(stored, multiLine=True).first()
        found.insert(0, row["checkpoint"] if row else None)
    for path in found:
        if path and exists(spark, path):
            return path
    if required:
        raise FileNotFoundError(f"no checkpoint: {stored}, ${variable}, {default}")
    return default


def first_setting(name: str, stored: Mapping[str, str] | None = None, default: str | None = None) -> str:
    """A setting from stored values, else the environment, else the default; an error if none has it."""
    for value in ((stored or {}).get(name), os.environ.get(name), default):
        if value:
            return value
    raise KeyError(name)
