"""Records across splits against readers of whole files, for borders everywhere."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import readers, split_records


@pytest.fixture(params=[61, 1 << 27])
def small_splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_across_borders(spark, tmp_path, small_splits):
    rng = random.Random(1)
    signs = ["a", "b", '"', ",", "\n", "é", "漢", " ", '""', "\r\n", "}", "\n\n"]
    want = []
    for f, end in enumerate(("\n", "\r\n")):
        own = [(str(100 * f + i), "".join(rng.choice(signs) for _ in range(400 if i == 7 else rng.randrange(50))), rng.choice(["", "x", "y\nz"])) for i in range(25)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows([("id", "t\n1", "u"), *own])
        text = out.getvalue()
        (tmp_path / f"{f}.csv").write_bytes((text[: -len(end)] if f else text + end).encode())  # no end of line; a blank line
        want += [(int(a), b or None, c or None) for a, b, c in own]
    schema = "id int, t string, u string"
    assert rows(readers.csv(spark, str(tmp_path), schema)) == sorted(want, key=str)
    one = spark.read.schema(schema).csv(str(tmp_path / "0.csv"), header=True, multiLine=True, quote='"', escape='"')
    assert rows(readers.csv(spark, str(tmp_path / "0.csv"), schema)) == rows(one)
    assert rows(readers.csv(spark, str(tmp_path), schema, ["u", "id"])) == sorted(((c, a) for a, _, c in want), key=str)


def element(rng, i):
    text = "".join(rng.choice(['a', '"', "\\", "}", "{", "[", "]", "\n", "é", ",", ":", '"sample_results": [']) for _ in range(400 if i == 7 else rng.randrange(25)))
    return {"id": i, "t": text, "l": [{"k": 1}, {"sample_results": [{"id": 5}]}][: rng.randrange(3)]}


def test_json_across_borders(spark, tmp_path, small_splits):
    rng = random.Random(2)
    want, schema = [], "id long, t string"
    for name, indent in (("a", 2), ("b", None)):
        own = [element(rng, i) for i in range(12)]
        want += [(x["id"], x["t"]) for x in own]
        (tmp_path / "lists").mkdir(exist_ok=True)
        (tmp_path / "reports").mkdir(exist_ok=True)
        (tmp_path / "lists" / name).write_text(json.dumps(own, indent=indent, ensure_ascii=indent is None))
        around = {"info": {"x": {"y": {}}, "sample_results": [{"id": -1}]}, "other": [{"id": -2}], "sample_results": own, "after": [{"id": -3}], "z": {"sample_results": {"id": -4}}}
        (tmp_path / "reports" / name).write_text(json.dumps(around, indent=indent))
    (tmp_path / "lists" / "empty").write_text("[ ]\n")
    (tmp_path / "reports" / "none").write_text('{"other": [{"id": -5}]}')
    assert rows(readers.json_array(spark, str(tmp_path / "lists"), schema)) == sorted(want, key=str)
    found = split_records.records(spark, str(tmp_path / "reports"), split_records.Json("sample_results"))
    assert rows(found.select(F.from_json("value", schema).alias("r")).select("r.*")) == sorted(want, key=str)


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("id,t\n" + "".join(f'{i},"line\nline {i}"\n' for i in range(100)))
    found = readers.csv(spark, str(tmp_path / "x.csv"), "id int, t string")
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > (20 if small_splits < 100 else 0)
    assert found.agg(F.count("t"), F.sum("id")).first()[:] == (100, 4950)


def test_a_record_over_many_splits_and_empty_files(spark, tmp_path, small_splits):
    long = "x\n" * 600
    (tmp_path / "a.csv").write_text(f'id,t\n1,"{long}"\n2,b\n')
    (tmp_path / "b.csv").write_text("id,t\n")
    (tmp_path / "c.csv").write_text("")
    assert rows(readers.csv(spark, str(tmp_path), "id int, t string")) == [(1, long), (2, "b")]
