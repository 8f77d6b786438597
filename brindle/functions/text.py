"""

Java's classes differ from Python's: WORD, SPACE and EDGE spell out Python's \\w, \\s and \\b.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x1C-\x1F]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: Python's line ends for str.splitlines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
RARE_LINE_END = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# Words too common to tell anything, Russian and English.
STOPWORDS_RU = """
как что где когда почему зачем какой какая какие каким какого который которая которые это этот эта эти для при если или либо чтобы чтоб на по в во с со
о об от до из у к не ни и а но же ли бы то так тот та те его её их он она оно они
""".split()
STOPWORDS_EN = """
the a an is are was were be been being does do did how what why where when which who whom this that these those in on for of to and or but with without
into onto from by as at it its there here if so
""".split()
STOPWORDS = frozenset(STOPWORDS_RU) | frozenset(STOPWORDS_EN)

# Paths that hold tests, documentation and the like.
NON_SOURCE = (
    r"(?i)(^|/)(tests?|docs?|examples?|benchmarks?|questions)/|(^|/)test_[^/]*\.py$|_test\.py$"
    r"|(^|/)(changelog|changes|history|faq|readme|contributing)[^/]*$|\.(md|rst|txt)$"
)
NON_SOURCE_WEIGHT = 0.5
SNIPPET = 240


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """As str.splitlines: a last line end opens no line, and an empty text has no lines."""
    text = _column(text)
    # Most texts have no line ends but newlines, for which no pattern is needed.
    parts = F.when(text.rlike(RARE_LINE_END), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    # The array of one lets the parts be named again without being split again.
    return F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))[0]


def strip(text: Column | str) -> Column:
    """As str.strip."""
    return F.regexp_replace(_column(text), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def relative_path(path: Column | str) -> Column:
    return F.translate(_column(path), "\\", "/")


def header(path: Column | str, symbol: Column | str, kind: Column | str) -> Column:
    return F.concat_ws(" | ", relative_path(path), _column(symbol), _column(kind))


def identifier_parts(name: Column | str) -> Column:
    """Lower-case parts of a path or name: at separators, and where the case changes."""
    spaced = F.regexp_replace(_column(name), r"(?U)(?<=[a-z0-9])(?=[A-Z])", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(spaced), rf"(?U)[\\/_\-.\s\x1C-\x1F]+", -1), lambda p: p != "")


def header_tokens(path: Column | str, symbol: Column | str, kind: Column | str, repo: Column | str) -> Column:
    own = F.array(F.lower(_column(kind)), F.lower(_column(repo)))
    return F.array_join(F.concat(identifier_parts(relative_path(path)), identifier_parts(symbol), own), " ")


def tokens(text: Column | str) -> Column:
    """Lower-case words without stopwords, repeats kept."""
    words = F.regexp_extract_all(_column(text), F.lit(f"({WORD}+)"), 1)
    return F.filter(F.transform(words, F.lower), lambda w: ~w.isin(sorted(STOPWORDS)))


def query_tokens(text: Column | str) -> Column:
    """Distinct tokens in their first order."""
    return F.array_distinct(tokens(text))


def snippet(text: Column | str, limit: int = SNIPPET) -> Column:
    whole = strip(text)
    cut = strip(F.regexp_replace(F.substring(whole, 1, limit), r"\n[^\n]*\z", ""))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit(" ...")))


def source_prior(path: Column | str) -> Column:
    return F.when(_column(path).rlike(NON_SOURCE), F.lit(NON_SOURCE_WEIGHT)).otherwise(F.lit(1.0))


def normal_path(path: Column | str) -> Column:
    return F.lower(relative_path(path))


def parse_span(span: Column | str) -> Column:
    """path, first and last of `path:first-last`."""
    part = lambda i: F.regexp_extract(_column(span), r"^(.*):(\d+)-(\d+)$", i)
    return F.struct(F.lower(part(1)).alias("path"), part(2).cast("int").alias("first"), part(3).cast("int").alias("last"))


def embedding_input(head: Column | str, text: Column | str) -> Column:
    return F.when(_column(head) != "", F.concat(_column(head), F.lit("\n"), _column(text))).otherwise(_column(text))


def to_unit_interval(logit: Column | str) -> Column:
    """Logistic function, written so that it can't overflow."""
    return 0.5 * (1 + F.tanh(_column(logit) / 2))
