
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EDGE as B
from .text import SPACE as S
from .text import WORD as W

# Kinds and what they look like. {B}, {W} and {S} are Python's \b, \w and \s.
PATTERNS = {
    "telegram_token": rf"(?U){B}\d{{6,12}}:[A-Za-z0-9_-]{{35}}{B}",
    "openai_key": rf"(?U){B}sk-(?:ant-|or-)?[A-Za-z0-9_-]{{16,}}{B}",
    "google_api_key": rf"(?U){B}AIza[0-9A-Za-z_-]{{35}}{B}",
    "github_token": rf"(?U){B}(?:ghp_[A-Za-z0-9]{{36}}|github_pat_[A-Za-z0-9_]{{20,}}){B}",
    "bearer_token": rf"(?U){B}Bearer{S}+[A-Za-z0-9\-._~+/]{{10,}}=*",
    "credential": rf"(?imU){B}({W}*(?:key|token|secret|password|passwd|api){W}*{S}*[:=]{S}*)(['\"]?)([A-Za-z0-9+/_\-]{{12,}})\2",
    "phone": rf"(?U)(?<![\p{{L}}\p{{N}}_.])(?:\+7|8)[\s\x1C-\x1F\-]?\(?\d{{3}}\)?[\s\x1C-\x1F\-]?\d{{3}}[\s\x1C-\x1F\-]?\d{{2}}[\s\x1C-\x1F\-]?\d{{2}}(?!{W})",
    "ip_address": rf"(?U){B}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{B}",
}


#: What any match of a kind holds: cheap tests that spare most texts the search. Of the plain strings one must be there; then the pattern must be found. A credential's is a sign and a value, which
#: are rarer than the names before them and found by their first character.
GUARDS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "telegram_token": ((":",), r"(?U)\d{6}:[A-Za-z0-9_-]{35}"), "openai_key": (("sk-",), None), "google_api_key": (("AIza",), None), "github_token": (("ghp_", "github_pat_"), None), "bearer_token": (("Bearer",), None),
    "credential": ((":", "="), rf"[:=](?U){S}*['\"]?(?i)[A-Za-z0-9+/_\-]{{12}}"), "phone": ((), r"(?U)(?:\+7|8)[\s\x1C-\x1F\-]?\(?\d{3}"), "ip_address": ((".",), r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d"),
}


def replacement(kind: str) -> str:
    mark = f"[REDACTED:{kind}]"
    return rf"$1$2{mark}$2" if kind == "credential" else mark


def _guarded(text: Column, kind: str) -> Column:
    """Whether a text may have a match."""
    strings, pattern = GUARDS[kind]
    out = reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in strings]) if strings else None
    if pattern:
        out = text.rlike(pattern) if out is None else out & text.rlike(pattern)
    return out


def _pass(text: Column, kind: str) -> Column:
    """One kind's pass. The array of one lets the text be named twice without being worked out twice."""
    once = lambda t: F.when(_guarded(t, kind), F.regexp_replace(t, F.lit(PATTERNS[kind]), F.lit(replacement(kind)))).otherwise(t)
    return F.transform(F.array(text), once)[0]


def redact(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for kind in PATTERNS:
        out = _pass(out, kind)
    return out


def _counted_pass(state: Column, kind: str) -> Column:
    """One kind's pass over a struct of text and the hits so far."""
    pattern = F.lit(PATTERNS[kind])

    def once(s: Column) -> Column:
        hit = F.struct(F.regexp_replace(s["t"], pattern, F.lit(replacement(kind))).alias("t"), F.array_append(s["n"], F.regexp_count(s["t"], pattern)).alias("n"))
        return F.when(_guarded(s["t"], kind), hit).otherwise(F.struct(s["t"].alias("t"), F.array_append(s["n"], F.lit(0)).alias("n")))

    return F.transform(F.array(state), once)[0]


def with_redaction(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text redacted, and redactions, a map of the number of hits by kind without zeros."""
    state = F.struct(F.col(text).alias("t"), F.array().cast("array<int>").alias("n"))
    for kind in PATTERNS:
        state = _counted_pass(state, kind)
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.col("_state.n"))
    kept = [F.col("_state.t").alias(c) if c == text else F.col(c) for c in df.columns]
    return df.withColumn("_state", state).select(*kept, F.map_filter(pairs, lambda _, n: n > 0).alias("redactions"))


def counts_by_kind(df: DataFrame) -> DataFrame:
    """kind and hits over all rows of with_redaction."""
    return df.select(F.explode("redactions").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("hits"))
