"""Readers and writers on small files."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.sources import readers, writers


def test_csv_with_line_feeds_and_quotes(spark, tmp_path):
    (tmp_path / "n.csv").write_text('hadm_id,subject_id,text\n01,7,"line one\nsays ""x"", y"\n02,8,\n')
    rows = readers.csv(spark, str(tmp_path / "n.csv"), readers.NOTES).collect()
    assert [(r["hadm_id"], r["text"]) for r in rows] == [("01", 'line one\nsays "x", y'), ("02", None)]
    assert readers.csv(spark, str(tmp_path / "n.csv"), readers.NOTES, ["hadm_id"]).columns == ["hadm_id"]


def test_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hadm_id,subject_id,text\n1,2,x\n")
    paths = {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "none.csv")}
    assert [(r["hadm_id"], r["split"]) for r in readers.splits(spark, paths, readers.NOTES).collect()] == [("1", "train")]
    with pytest.raises(FileNotFoundError):
        readers.splits(spark, {"test": paths["test"]}, readers.NOTES)


def test_reports(spark, tmp_path):
    rows = [{"sample_id": 1, "subject_id": 2, "actual_codes": ["F1"], "tp": 1, "fp": 0, "fn": 0}, {"sample_id": 2, "error": "x"}]
    for i, name in enumerate(("eval_b.json", "eval_a.json")):
        (tmp_path / name).write_text(json.dumps({"evaluation_info": {"k": "v"}, "sample_results": rows}, indent=1))
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    glob = str(tmp_path / "eval_*.json")
    assert readers.latest_by_time(spark, glob).endswith("eval_a.json") and readers.latest_by_name(spark, glob).endswith("eval_b.json")
    got = readers.report(spark, readers.latest_by_name(spark, glob)).collect()
    assert [(r["sample_id"], r["actual_codes"]) for r in got] == [(1, ["F1"])]
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "x.json"), "a int").count() == 2


def test_names_terms_checkpoints(spark, tmp_path, monkeypatch):
    assert readers.match_name("run", ["x_run", "run_2", "run"]) == "run" and readers.match_name("run", ["x_run", "run_2"]) == "run_2"
    assert readers.match_name("run", ["x_run"]) == "x_run" and readers.match_name("q", ["a"]) is None
    (tmp_path / "t.csv").write_text("term,category\n lithium ,Mood\n,x\n")
    (tmp_path / "t.txt").write_text("one\n\n two\n")
    assert [r["term"] for r in readers.terms(spark, str(tmp_path / "t.csv")).collect()] == ["lithium"]
    assert [r["term"] for r in readers.terms(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    names = spark.createDataFrame([("checkpoint-900",), ("checkpoint-1000",), ("checkpoint-x",), ("final",), ("checkpoint-5",)], "name string")
    assert [r["step"] for r in readers.checkpoints(names, 100).collect()] == [900, 1000]
    monkeypatch.setenv("BEST", "env")
    assert [readers.first_setting("BEST", s, "d") for s in ({"BEST": "file"}, {}, None)] == ["file", "env", "env"]
    monkeypatch.delenv("BEST")
    assert readers.first_setting("BEST", None, "d") == "d"
    with pytest.raises(KeyError):
        readers.first_setting("BEST")


def test_best_checkpoint(spark, tmp_path, monkeypatch):
    for name in ("stored", "own", "final"):
        (tmp_path / name).mkdir()
    at = lambda name: str(tmp_path / name)
    (tmp_path / "best.json").write_text(json.dumps({"checkpoint": at("stored"), "micro_f1": 0.5}, indent=2))
    monkeypatch.setenv("CHECKPOINT_PATH", at("own"))
    assert readers.best_checkpoint(spark, at("best.json"), at("final")) == at("stored")
    (tmp_path / "gone.json").write_text(json.dumps({"checkpoint": at("gone")}))
    (tmp_path / "bad.json").write_text("{not json")
    for name in ("gone.json", "bad.json", "missing.json"):
        assert readers.best_checkpoint(spark, at(name), at("final")) == at("own")
    monkeypatch.setenv("CHECKPOINT_PATH", at("gone"))
    assert readers.best_checkpoint(spark, at("bad.json"), at("final")) == at("final")
    assert readers.best_checkpoint(spark, at("bad.json"), at("gone"), required=False) == at("gone")
    with pytest.raises(FileNotFoundError):
        readers.best_checkpoint(spark, at("bad.json"), at("gone"))


def test_numbers_as_python_shows_them(spark):
    values = [0.0, 0.25, 0.35, 0.125, 0.0005, 2.5, 3.5, 1234567.5, 999.995, 12.3456, 1e9 + 0.5, 0.99999, 10.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", writers.grouped(F.col("v")).alias("a"), writers.grouped(F.col("v"), 2).alias("b"), writers.percent(F.col("v")).alias("c")).collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(f"{v:,.0f}", f"{v:,.2f}", f"{v:.1%}") for v in values]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", x\ny', ["F1", "F2"]), (2, "b", [])], "id int, t string, codes array<string>")
    flat = df.select("id", "t", writers.rendered_list(df["codes"]).alias("codes"))
    writers.csv(flat, str(tmp_path / "c"), single=True)
    back = readers.csv(spark, str(tmp_path / "c"), "id int, t string, codes string").orderBy("id").collect()
    assert [(r["t"], r["codes"]) for r in back] == [('a "q", x\ny', "F1; F2"), ("b", None)]
    writers.json_lines(df, str(tmp_path / "j"), drop=("t",))
    assert spark.read.json(str(tmp_path / "j")).columns == ["codes", "id"]
    writers.json_array(df, str(tmp_path / "a"), drop=("t",), single=True)
    (one,) = Path(tmp_path / "a").glob("part*")
    assert json.loads(one.read_text()) == [{"id": 1, "codes": ["F1", "F2"]}, {"id": 2, "codes": []}]
    writers.json_array(df.limit(0), str(tmp_path / "e"), single=True)
    assert readers.json_array(spark, str(tmp_path / "e"), "id int").count() == 0
    scores = spark.createDataFrame([(i, 7 if i else None, ["F1"], 1) for i in range(20)], "sample_id long, subject_id long, actual_codes array<string>, tp long").repartition(3)
    writers.nested_report(scores, {"configuration": {"name": "é"}}, str(tmp_path / "r"))
    files = [json.loads(f.read_text()) for f in Path(tmp_path / "r").glob("part*")]
    assert sum(len(f["sample_results"]) for f in files) == 20 and all(f["configuration"] == {"name": "é"} for f in files)
    assert sorted(r["sample_id"] for r in readers.report(spark, str(tmp_path / "r")).collect()) == list(range(1, 20))
    writers.csv(spark.createDataFrame([(1, "  x ", None), (2, "", "a")], "id int, a string, b string"), str(tmp_path / "w"))
    assert {(r["a"], r["b"]) for r in readers.csv(spark, str(tmp_path / "w"), "id int, a string, b string").collect()} == {("  x ", None), (None, "a")}
    assert writers.capped(spark.createDataFrame([("a", i) for i in range(5)], "g string, i int"), ["g"], ["i"], 2).count() == 2
    rows = spark.createDataFrame([("A", 0.5, 0.25), ("B", 0.75, 0.125)], "s string, p double, r double")
    got = {r["s"]: r["latex"] for r in writers.latex_rows(rows, "s", ["p", "r"]).collect()}
    assert got == {"A": "A & 0.500 & \\textbf{0.250} \\\\", "B": "B & \\textbf{0.750} & 0.125 \\\\"}
    terms = spark.createDataFrame([("b",), ("it's",), ("a",)], "t string")
    assert [r["text"] for r in writers.literal_lines(terms, "t", 2).orderBy("line").collect()] == ["'a', 'b'", '"it\'s"']
    assert writers.run_metadata(spark, {"k": 1}).first()["config"] == '{"k": 1}'


def test_entry_without_the_llm_folders(tmp_path):
    """The library and its entry import, and keep their queries, without the llm subpackage and the pipeline."""
    root = Path(__file__).parents[1]
    for p in ("__spark_entry__.py", "tessella"):
        (tmp_path / p).symlink_to(root / p) if p.endswith(".py") else None
    (tmp_path / "tessella").mkdir()
    for p in (root / "tessella").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessella" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cohort_build' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
