"""

Windows, Markdown sections and the splitting of long chunks are array expressions; only the syntax tree of Python files needs Python.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, lines, strip

# Fixed values
WINDOW, OVERLAP = 60, 10
BIG_CLASS_LINES, BIG_CLASS_METHODS = 80, 6
MAX_CHARS, CHAR_OVERLAP = 4000, 200

FIELDS = ["path", "repo", "symbol", "kind", "start_line", "end_line", "text"]
SCHEMA = "path string, repo string, symbol string, kind string, start_line int, end_line int, text string"


def _starts(n: Column, size: int, overlap: int) -> Column:
    """0-based starts of windows that cover n items; the last one ends at n."""
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int") * step), F.lit(step))


def line_windows(files: DataFrame) -> DataFrame:
    """Overlapping windows of lines."""
    # An empty text has no lines, any other has some: asked of the text, so that it isn't split to be filtered.
    split = files.filter(F.col("text") != "").select("path", "repo", lines("text").alias("ls")).withColumn("n", F.size("ls"))
    out = split.select("path", "repo", "ls", "n", F.explode(_starts(F.col("n"), WINDOW, OVERLAP)).alias("s")).withColumn("e", F.least(F.col("s") + WINDOW, F.col("n")))
    return out.select("path", "repo", F.format_string("lines %d-%d", F.col("s") + 1, F.col("e")).alias("symbol"), F.lit("window").alias("kind"), (F.col("s") + 1).alias("start_line"), F.col("e").alias("end_line"), F.array_join(F.slice("ls", F.col("s") + 1, F.col("e") - F.col("s")), "\n").alias("text"))


HEADING = rf"(?U)^(#{{1,6}}){SPACE}+(.*)$"


def markdown_sections(files: DataFrame) -> DataFrame:
    """A section for each heading, and one for what comes before the first; files without headings go in windows."""
    split = files.select("path", "repo", "text", lines("text").alias("ls"))
    at = F.filter(F.transform("ls", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    split = split.withColumn("at", at)
    headed = split.filter(F.size("at") > 0)
    first = F.when(F.col("at")[0] > 0, F.concat(F.array(F.lit(0)), F.col("at"))).otherwise(F.col("at"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("ls")))
    parts = headed.withColumn("starts", first).withColumn("part", F.explode(F.arrays_zip(F.col("starts").alias("s"), ends.alias("e")))).select("path", "repo", "ls", F.col("at")[0].alias("first"), F.col("part.s").alias("s"), F.col("part.e").alias("e"))
    title = strip(F.regexp_extract(F.col("ls")[F.col("s")], HEADING, 2))
    symbol = F.when(F.col("s") < F.col("first"), "<preamble>").when(title == "", "<section>").otherwise(title)
    sections = parts.select("path", "repo", symbol.alias("symbol"), F.lit("markdown_section").alias("kind"), (F.col("s") + 1).alias("start_line"), F.col("e").alias("end_line"), F.array_join(F.slice("ls", F.col("s") + 1, F.col("e") - F.col("s")), "\n").alias("text"))
    return sections.unionByName(line_windows(split.filter(F.size("at") == 0)))


def split_long(chunks: DataFrame) -> DataFrame:
    """Chunks over MAX_CHARS in windows of lines, and in slices of characters where that isn't enough: one pass over the chunks, in which -1 stands for the whole."""
    whole, n = F.array(F.lit(-1)), F.length("text")
    own = chunks.select(*FIELDS).filter("text IS NOT NULL").withColumn("ls", F.when(n > MAX_CHARS, lines("text")).otherwise(F.array().cast("array<string>"))).withColumn("n", F.size("ls"))
    parts = own.select("*", F.posexplode(F.when(F.col("n") <= 1, whole).otherwise(_starts(F.col("n"), WINDOW, OVERLAP))).alias("part", "s")).withColumn("e", F.least(F.col("s") + WINDOW, F.col("n")))
    of = lambda part, other: F.when(F.col("s") < 0, other).otherwise(part)
    symbol = of(F.concat("symbol", F.format_string(" [part %d]", F.col("part") + 1)), F.col("symbol"))
    text = of(F.array_join(F.slice("ls", F.greatest(F.col("s"), F.lit(0)) + 1, F.greatest(F.col("e") - F.col("s"), F.lit(0))), "\n"), F.col("text"))
    parts = parts.select("path", "repo", symbol.alias("symbol"), "kind", of(F.col("start_line") + F.col("s"), F.col("start_line")).alias("start_line"), of(F.col("start_line") + F.col("e") - 1, F.col("end_line")).alias("end_line"), text.alias("text"))
    return _sliced(parts, F.when(n <= MAX_CHARS, whole).otherwise(_starts(n, MAX_CHARS, CHAR_OVERLAP)))


def char_slices(chunks: DataFrame) -> DataFrame:
    """Overlapping slices of characters; the lines are those of the whole chunk."""
    return _sliced(chunks.filter(F.length("text") > 0), _starts(F.length("text"), MAX_CHARS, CHAR_OVERLAP))


def _sliced(chunks: DataFrame, starts: Column) -> DataFrame:
    at = chunks.withColumn("s", F.explode(starts)).withColumn("e", F.least(F.col("s") + MAX_CHARS, F.length("text")))
    symbol = F.when(F.col("s") < 0, F.col("symbol")).otherwise(F.concat("symbol", F.format_string(" [chars %d-%d]", "s", "e")))
    text = F.when(F.col("s") < 0, F.col("text")).otherwise(F.col("text").substr(F.col("s") + 1, F.col("e") - F.col("s")))
    return at.select("path", "repo", symbol.alias("symbol"), "kind", "start_line", "end_line", text.alias("text"))


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def spans_of_python(text: str) -> list[tuple[str, str, int, int]] | None:
    """(symbol, kind, first line, last line) of a Python file's parts in order; None where it can't be parsed or has none."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):  # the last two are what the parser says of code nested too deep
        return None
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)
    found: list[tuple[str, str, int, int]] = []
    tops = [n.end_lineno for n in body if isinstance(n, (ast.Import, ast.ImportFrom))]
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        tops.append(body[0].end_lineno)
    if tops:
        found.append(("<module>", "module", 1, max(tops)))
    for node in body:
        first, last = (_first_line(node), node.end_lineno) if isinstance(node, (*defs, ast.ClassDef)) else (0, 0)
        if isinstance(node, defs):
            found.append((node.name, "function", first, last))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, defs)]
            if not methods or (last - first <= BIG_CLASS_LINES and len(methods) <= BIG_CLASS_METHODS):
                found.append((node.name, "class", first, last))
                continue
            if (head := _first_line(methods[0]) - 1) >= first:
                found.append((node.name, "class", first, head))
            found += [(f"{node.name}.{m.name}", "method", _first_line(m), m.end_lineno) for m in methods]
    rows = text.splitlines()
    reached = 0
    gaps = []
    for first, last in sorted((s[2], s[3]) for s in found) + [(len(rows) + 1, len(rows) + 1)]:
        if first > reached + 1 and "\n".join(rows[reached : first - 1]).strip():
            gaps.append(("<module>", "module", reached + 1, first - 1))
        reached = max(reached, last)
    return sorted(found + gaps, key=lambda s: s[2:]) or None


def python_chunks(files: DataFrame) -> DataFrame:
    """Functions, classes, methods of big classes, and the module's own lines; files that can't be parsed go in windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, repo, text in zip(batch["path"], batch["repo"], batch["text"]):
                spans = spans_of_python(text)
                if spans is None:
                    out.append((path, repo, None, None, 0, 0, text))
                    continue
                rows = text.splitlines()
                out += [(path, repo, symbol, kind, a, b, "\n".join(rows[max(1, a) - 1 : max(a, b)])) for symbol, kind, a, b in spans]
            yield pd.DataFrame(out, columns=FIELDS).astype({"start_line": "int32", "end_line": "int32"})

    found = files.filter(F.col("text").isNotNull()).select("path", "repo", "text").mapInPandas(run, SCHEMA)
    return found.filter(F.col("kind").isNotNull()).unionByName(line_windows(found.filter(F.col("kind").isNull())))


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files by their suffix, long ones split."""
    # Suffixes are compared as they are, in all their cases, so that stored files without a kind aren't read to find that out.
    cases = lambda s: [f".{a}{b}" for a in (s[0], s[0].upper()) for b in (s[1], s[1].upper())]
    python, markdown = (files.filter(F.col("suffix").isin(cases(s))) for s in ("py", "md"))
    rest = files.filter(F.coalesce(~F.col("suffix").isin(cases("py") + cases("md")), F.lit(True)))
    return split_long(python_chunks(python).unionByName(markdown_sections(markdown)).unionByName(line_windows(rest)))


def gaps(intervals: DataFrame, total: DataFrame) -> DataFrame:
    """path, first and last of the lines that no interval(path, start_line, end_line) covers, up to total(path, n). The running end of the
    intervals before tells where a gap opens."""
    from pyspark.sql import Window

    ordered = Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    ends = intervals.select("path", "start_line", "end_line").unionByName(total.select("path", (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line")))
    opened = ends.withColumn("first", F.coalesce(F.max("end_line").over(ordered), F.lit(0)) + 1)
    return opened.filter("first < start_line").select("path", "first", (F.col("start_line") - 1).alias("last"))
