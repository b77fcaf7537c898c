"""Sinks: CSV, JSON arrays and lines, nested reports, capped samples, LaTeX rows and term literals."""

from __future__ import annotations

import datetime
import importlib.metadata
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, quote_all: bool = False, single: bool = False) -> None:
    """CSV with header, blanks at either end of a field kept; ``single`` only for results of report size."""
    own = (df.coalesce(1) if single else df).write.mode("overwrite")
    own.csv(path, header=True, quoteAll=quote_all, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _framed(df: DataFrame, head: str, tail: str, path: str, single: bool) -> None:
    """Each file: ``head``, the rows as JSON objects with commas between them, ``tail``. A file is one partition."""
    rows = (df.coalesce(1) if single else df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda values: pa.RecordBatch.from_arrays([values], ["value"])
        yield line(pa.array([head]))
        between = ""
        for batch in batches:
            if batch.num_rows:
                before = pa.array([between] + [", "] * (batch.num_rows - 1))
                yield line(pc.binary_join_element_wise(before, batch.column(0).cast(pa.string()), ""))
                between = ", "
        yield line(pa.array([tail]))

    rows.mapInArrow(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def json_array(df: DataFrame, path: str, drop: tuple[str, ...] = (), single: bool = False) -> None:
    """Files that are one JSON array of objects each, without the dropped fields; nulls are written.

    ``single``: one file, for results of report size.
    """
    _framed(df.drop(*drop), "[", "]", path, single)


def json_lines(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """A JSON object a line, without the dropped fields."""
    df.drop(*drop).write.mode("overwrite").json(path)


def nested_report(df: DataFrame, info: dict, path: str, key: str = "sample_results", single: bool = False) -> None:
    """Reports as `readers.report` reads them: an object of ``info`` with the rows as an array under ``key``.

    ``single``: one file. Otherwise each file is a whole report of its rows, so that a report of any size can be written.
    """
    own = json.dumps(info, ensure_ascii=False)[:-1] + (", " if info else "")
    _framed(df, f"{own}{json.dumps(key, ensure_ascii=False)}: [", "]}", path, single)


def rendered_list(c: Column, separator: str = "; ") -> Column:
    """An empty list gives an empty string."""
    return F.array_join(c, separator)


def capped(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def grouped(c: Column, digits: int = 0) -> Column:
    """A number with commas between thousands, rounded half to even: Python's ``f"{x:,.0f}"``."""
    return F.format_number(c, digits)


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage, rounded half to even: Python's ``f"{x:.1%}"``."""
    return F.concat(F.replace(F.format_number(c * 100.0, digits), F.lit(","), F.lit("")), F.lit("%"))


def latex_rows(df: DataFrame, name: str, values: list[str], digits: int = 3) -> DataFrame:
    """One LaTeX row each; the best of each value (rank 1) is bold."""
    one = Window.partitionBy(F.lit(0))
    cells = [
        F.when(F.rank().over(one.orderBy(F.desc(v))) == 1, F.format_string(f"\\textbf{{%.{digits}f}}", F.col(v))).otherwise(F.format_string(f"%.{digits}f", F.col(v)))
        for v in values
    ]
    return df.select(name, F.concat(F.concat_ws(" & ", F.col(name), *cells), F.lit(" \\\\")).alias("latex"))


def literal_lines(df: DataFrame, term: str, per_line: int = 6) -> DataFrame:
    """Lines of ``per_line`` quoted terms in order; terms with an apostrophe are in double quotes."""
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(term)) - 1
    shown = F.when(F.contains(term, F.lit("'")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(F.concat(F.lit("'"), term, F.lit("'")))
    own = df.select(F.floor(rn / per_line).alias("line"), F.struct(rn.alias("i"), shown.alias("t")).alias("e"))
    return own.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), ", ").alias("text"))


def run_metadata(spark: SparkSession, config: dict, packages: tuple[str, ...] = ("pyspark", "pandas", "numpy")) -> DataFrame:
    """Settings, package versions and time of a run: one row."""
    versions = {p: importlib.metadata.version(p) for p in packages}
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return spark.createDataFrame([(now, json.dumps(config, sort_keys=True, default=str), json.dumps(versions, sort_keys=True))], "written_at string, config string, versions string")
