import pytest

from brindle.operators import chunking as c

SAMPLE = '''"""What it is for.

More of it."""
import json
from time import sleep


async def fetch(url):
    await url


class Point:
    x = 1

    def norm(self):
        return self.x


class Shape:
    """Has many sides."""

''' + "\n".join(f"    @property\n    def side{i}(self):\n        return {i}\n" for i in range(1, 8))


def rows(spark, *files):
    df = spark.createDataFrame([(p, "r", t, "." + p.rsplit(".", 1)[-1]) for p, t in files], "path string, repo string, text string, suffix string")
    return sorted(((r.path, r.start_line, r.end_line, r.symbol, r.kind, r.text) for r in c.chunk_files(df).collect()))


def test_python_parts(spark):
    got = [r[1:5] for r in rows(spark, ("a.py", SAMPLE))]
    want = [(1, 5, "<module>", "module"), (8, 9, "fetch", "function"), (12, 16, "Point", "class"), (19, 21, "Shape", "class")]
    want += [(22 + 4 * i, 24 + 4 * i, f"Shape.side{i + 1}", "method") for i in range(7)]
    assert got == want


def test_gaps_decorators_and_late_imports():
    text = "@wraps\n@more\ndef f():\n    pass\n\nX = 1\nimport late\n\nclass A:\n    y = 2\n"
    assert c.spans_of_python(text) == [("f", "function", 1, 4), ("<module>", "module", 1, 7), ("A", "class", 9, 10)]
    assert c.spans_of_python("x = 1\n\n\ndef f(): pass\nprint(2)\n") == [("<module>", "module", 1, 3), ("f", "function", 4, 4), ("<module>", "module", 5, 5)]


def test_unparsable_and_empty(spark):
    assert [r[3:5] for r in rows(spark, ("a.py", "def f(:\n    pass\n"))] == [("lines 1-2", "window")]
    assert rows(spark, ("a.py", ""), ("b.txt", ""), ("c.md", "")) == []


def test_markdown(spark):
    got = rows(spark, ("a.md", "before\n# Title\nx\n## Section A \ny\n###\n#\t \nno #heading\n"), ("b.md", "plain"))
    assert [r[1:5] for r in got] == [(1, 1, "<preamble>", "markdown_section"), (2, 3, "Title", "markdown_section"), (4, 6, "Section A", "markdown_section"), (7, 8, "<section>", "markdown_section"), (1, 1, "lines 1-1", "window")]
    assert "y" not in got[1][5]


@pytest.mark.parametrize("n, want", [(1, [(1, 1)]), (60, [(1, 60)]), (61, [(1, 60), (51, 61)]), (110, [(1, 60), (51, 110)]), (150, [(1, 60), (51, 110), (101, 150)])])
def test_windows(spark, n, want):
    assert [r[1:3] for r in rows(spark, ("a.txt", "\n".join(map(str, range(n)))))] == want


def test_long_line_in_slices(spark):
    got = rows(spark, ("a.txt", "x" * 10006))
    assert [(r[3], len(r[5])) for r in got] == [("lines 1-1 [chars 0-4000]", 4000), ("lines 1-1 [chars 3800-7800]", 4000), ("lines 1-1 [chars 7600-10006]", 2406)]


def test_long_chunk_in_windows(spark):
    text = "D = {\n" + "".join(f"    'key{i}': 'value{i}',\n" for i in range(2000)) + "}\n"
    got = rows(spark, ("a.py", text))
    assert len(got) == 40 and got[0][3] == "<module> [part 1]" and all(len(r[5]) <= 4000 for r in got)
    assert {n for r in got for n in range(r[1], r[2] + 1)} == set(range(1, 2003))


def test_line_ends(spark):
    from pyspark.sql import functions as F

    from brindle.functions.text import lines

    texts = ["", "\n", "a", "a\n", "a\r\nb\rc\n\n", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g", " a b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.l for r in df.select("i", lines(F.col("t")).alias("l")).collect()} == {i: t.splitlines() for i, t in enumerate(texts)}


def test_long_chunks_are_split_in_one_pass(spark):
    rows = [("a", "r", "s", "window", 1, 1, t) for t in ("", "x", "y" * 4000, "y" * 9000, "\n".join(["line"] * 2000), "\n".join(["z" * 5000, "b"]), "\n" * 4001, None)]
    made = c.split_long(spark.createDataFrame(rows, c.SCHEMA))
    assert made._jdf.queryExecution().executedPlan().toString().count("Union") == 0
    out = made.collect()
    assert all(len(r["text"]) <= 4000 for r in out) and {"", "x", "y" * 4000} <= {r["text"] for r in out}
    assert {r["symbol"] for r in out if r["text"].startswith("y") and len(r["text"]) < 4000 or r["symbol"].startswith("s [chars")} >= {"s [chars 0-4000]", "s [chars 3800-7800]", "s [chars 7600-9000]"}


def test_texts_are_not_split_to_be_filtered_and_other_kinds_are_skipped(spark, tmp_path):
    spark.createDataFrame([("a", "r", "x\ny\n", ".txt"), ("b", "r", "", ".txt"), ("c", "r", "\n", ".TXT"), ("d", "r", "# h\nz", ".Md"), ("e", "r", "def f():\n    pass", ".pY")], "path string, repo string, text string, suffix string").write.parquet(str(tmp_path / "files"))
    made = c.chunk_files(spark.read.parquet(str(tmp_path / "files")))
    assert {(r.path, r.kind, r.start_line, r.end_line, r.text) for r in made.collect()} == {("a", "window", 1, 2, "x\ny"), ("c", "window", 1, 1, ""), ("d", "markdown_section", 1, 2, "# h\nz"), ("e", "function", 1, 2, "def f():\n    pass")}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "In(suffix, [.MD,.Md,.mD,.md])" in plan and "In(suffix, [.PY,.Py,.pY,.py])" in plan
    # Markdown files are split to find their headings.
    assert not [line for line in plan.splitlines() if " Filter " in line and "split(" in line and ".md" not in line]
