"""The intake job: runs over growing input, a batch that breaks off, and odd rows."""

import json
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import intake
from jobs.common import load

SCHEMA = "doc_id long, source string, text string, lang string"
KEY = "api_key: 'NotARealKey_0987'"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.fixture
def places(tmp_path):
    return {"input": f"{tmp_path}/in/*", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark"}


def state(spark, output):
    """All rows of all tables."""
    plain = lambda r: tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r)
    return {name: sorted((plain(r) for r in intake.read(spark, output, name).collect()), key=str) for name in intake.SCHEMAS}


def test_runs_take_only_what_is_new(spark, tmp_path, places):
    put(spark, tmp_path / "in", "day1", [(1, "a", "one\n" * 70, "en"), (2, "a", f"x {KEY}", "en"), (3, "b", "three", None)])
    first = intake.run(spark, **places)
    assert [b["documents"] for b in first] == [3] and first[0]["chunks"] == 4 and first[0]["secrets"] == {"credential": 1}
    before = state(spark, places["output"])
    assert intake.run(spark, **places) == []
    assert state(spark, places["output"]) == before
    put(spark, tmp_path / "in", "day2", [(1, "a", "one, changed", "en"), (2, "a", f"x {KEY}", "en"), (4, "b", "four", "de")])
    second = intake.run(spark, **places)
    assert [b["documents"] for b in second] == [2]
    files = {(r["path"], r["batch"]): r["text"] for r in intake.read(spark, places["output"], "files").collect()}
    assert sorted(files) == [("a/1.txt", 0), ("a/1.txt", 1), ("a/2.txt", 0), ("b/3.txt", 0), ("b/4.txt", 1)]
    now = sorted((r["path"], r["text"]) for r in intake.current(spark, places["output"]).collect())
    assert now == [("a/1.txt", "one, changed"), ("a/2.txt", "x api_key: '[REDACTED:credential]'"), ("b/3.txt", "three"), ("b/4.txt", "four")]
    # A document that goes back to an earlier text is a change as well.
    put(spark, tmp_path / "in", "day3", [(1, "a", "one\n" * 70, "en")])
    assert [b["documents"] for b in intake.run(spark, **places)] == [1]
    assert intake.current(spark, places["output"]).filter("path = 'a/1.txt'").count() == 2


def test_growing_input_gives_what_one_run_gives(spark, tmp_path, places):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text", "lang")
    parts = [docs.filter(F.col("doc_id") % 3 == k) for k in range(3)]
    for k, part in enumerate(parts):
        part.repartition(2).write.parquet(f"{tmp_path}/in/part{k}")
        intake.run(spark, **places, config={"files_per_batch": 1})
    whole = {"input": "/root/testdata/sf0.001/documents.parquet*", "output": f"{tmp_path}/whole", "checkpoint": f"{tmp_path}/mark2"}
    assert len(intake.run(spark, **whole)) == 1
    plain = lambda out: sorted((r.asDict() | {"batch": 0} for r in intake.current(spark, out).collect()), key=str)
    assert plain(places["output"]) == plain(whole["output"])
    assert intake.read(spark, places["output"], "files").select("batch").distinct().count() == 6


@pytest.mark.parametrize("broken", ["files", "chunks", "secrets"])
def test_a_batch_that_breaks_off_runs_again(spark, tmp_path, places, monkeypatch, broken):
    put(spark, tmp_path / "in", "day1", [(1, "a", "one", "en")])
    intake.run(spark, **places)
    put(spark, tmp_path / "in", "day2", [(1, "a", "two", "en"), (2, "b", KEY, "en")])
    write = intake.write

    def failing(df, output, name):
        write(df, output, name)
        if name == broken:
            raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(intake, "write", failing)
        with pytest.raises(Exception, match="lost"):
            intake.run(spark, **places)
    assert [b["batch"] for b in intake.run(spark, **places)] == [1]
    put(spark, tmp_path / "in2", "day1", [(1, "a", "one", "en")])
    other = {"input": f"{tmp_path}/in2/*", "output": f"{tmp_path}/out2", "checkpoint": f"{tmp_path}/mark2"}
    intake.run(spark, **other)
    put(spark, tmp_path / "in2", "day2", [(1, "a", "two", "en"), (2, "b", KEY, "en")])
    intake.run(spark, **other)
    assert state(spark, places["output"]) == state(spark, other["output"])


def test_odd_rows(spark, tmp_path, places):
    rows = [(None, "a", "no id", None), (None, "a", "no id", None), (5, None, "no repo", "en"), (6, "a", None, "en"), (7, "a/b=c", "x", "en"), (8, "007", "y", "en")]
    rows += [(9, "a", "first", "en"), (9, "a", "second", "en")] * 3
    put(spark, tmp_path / "in", "day1", rows)
    counts = intake.run(spark, **places)
    files = {r["path"]: (r["repo"], r["text"]) for r in intake.read(spark, places["output"], "files").collect()}
    assert len(files) == 6 and counts[0]["documents"] == 6
    assert files["/5.txt"][1] == "no repo" and files["a/6.txt"] == ("a", "") and files["a/b=c/7.txt"] == ("a/b=c", "x") and files["007/8.txt"] == ("007", "y")
    assert files["a/9.txt"][1] in ("first", "second")
    assert intake.current(spark, places["output"]).count() == 5
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"suffix": ".md"}))
    assert load(spark, f"{tmp_path}/c.json", intake.DEFAULTS)["suffix"] == ".md"
    assert load(spark, "jobs/intake.json", intake.DEFAULTS) == intake.DEFAULTS
    (tmp_path / "d.json").write_text(json.dumps({"sufix": ".md"}))
    with pytest.raises(ValueError, match="sufix"):
        load(spark, f"{tmp_path}/d.json", intake.DEFAULTS)


def test_command_line(spark, tmp_path, places):
    put(spark, tmp_path / "in", "day1", [(1, "a", "one", "en")])
    said = [f"--{k}={v}" for k, v in places.items()]
    done = subprocess.run([sys.executable, "-m", "jobs.intake", "--config", "jobs/intake.json", *said], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"took 1 documents, wrote 1 chunks", done.stderr) and re.search(r"read 1 rows in 1 batches", done.stderr)
    assert intake.current(spark, places["output"]).count() == 1
