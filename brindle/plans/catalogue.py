"""Queries of the core engine, by name, with the SQL that states what each must return. Scores are rounded before they are ranked, so that engines agree on ties."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction, text
from ..functions.stemming import stemmed
from ..operators import cells, chunking, evaluation, keyword, ranking, vectors
from ..operators.containment import holding
from ..sources import files as sources
from ..sources.store import Store
from . import search as plans
from .carriers import CHUNKS_SQL, FILES_SQL, QUERIES_SQL, chunks, files, queries, shared_dir, stored, table
from .indexing import file_diff, index_files

DIGITS, K = 6, 8
POOL = ranking.pool_size(K)


# Chunking


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(files(spark, sf_dir)).select("path", "symbol", "start_line", "end_line", "text")


LINES = "CASE WHEN string_split({t}, chr(10))[-1] = '' THEN list_slice(string_split({t}, chr(10)), 1, len(string_split({t}, chr(10))) - 1) ELSE string_split({t}, chr(10)) END"
STARTS = "unnest(range(0, greatest(0, ceil(({n} - {size}) / {step}.0)::INT * {step}) + 1, {step}))"
_WINDOWS = f"""{FILES_SQL},
l AS (SELECT path, {LINES.format(t='text')} AS ls FROM files),
w AS (SELECT path, ls, len(ls) AS n, {STARTS.format(n='len(ls)', size=60, step=50)} AS s FROM l WHERE len(ls) > 0),
windows AS (SELECT path, 'lines ' || (s + 1) || '-' || least(s + 60, n) AS symbol, (s + 1)::INT AS start_line, least(s + 60, n)::INT AS end_line,
            array_to_string(list_slice(ls, s + 1, least(s + 60, n)), chr(10)) AS text FROM w)"""


def char_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.char_slices(chunks(spark, sf_dir)).select("path", "symbol", "text")


_CHARS = "SELECT path, {extra} symbol || ' [chars ' || s || '-' || least(s + 4000, length(text)) || ']' AS symbol, substr(text, s + 1, least(s + 4000, length(text)) - s) AS text FROM (SELECT *, " + STARTS.format(n="length(text)", size=4000, step=3800) + " AS s FROM {source} WHERE length(text) > 0)"


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_long(chunking.line_windows(files(spark, sf_dir))).select("path", "symbol", "start_line", "end_line", "text")


_OVERSIZE = f"""{_WINDOWS},
big AS (SELECT *, {LINES.format(t='text')} AS ls FROM windows WHERE length(text) > 4000),
bw AS (SELECT *, len(ls) AS n, {STARTS.format(n='len(ls)', size=60, step=50)} AS s FROM big WHERE len(ls) > 1),
parts AS (SELECT path, symbol || ' [part ' || (s // 50 + 1) || ']' AS symbol, (start_line + s)::INT AS start_line, (start_line + least(s + 60, n) - 1)::INT AS end_line,
          array_to_string(list_slice(ls, s + 1, least(s + 60, n)), chr(10)) AS text FROM bw),
long AS (SELECT * FROM parts WHERE length(text) > 4000 UNION ALL SELECT path, symbol, start_line, end_line, text FROM big WHERE len(ls) <= 1)
SELECT path, symbol, start_line, end_line, text FROM windows WHERE length(text) <= 4000
UNION ALL SELECT path, symbol, start_line, end_line, text FROM parts WHERE length(text) <= 4000
UNION ALL SELECT path, symbol, start_line, end_line, text FROM ({_CHARS.format(source='long', extra='start_line, end_line,')})"""


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as Markdown, its turns under headings; every third starts with a line before the first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("t")).alias("s"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    body = F.array_join(F.transform("ss", lambda s: s["t"]), "\n")
    page = F.concat(F.when(F.col("conv_id") % 3 == 0, F.lit("log\n")).otherwise(F.lit("")), body)
    made = whole.select(F.col("conv_id").cast("string").alias("path"), F.lit("c").alias("repo"), page.alias("text"))
    return chunking.markdown_sections(made).select("path", "symbol", "start_line", "end_line", "text")


_MARKDOWN = f"""WITH m AS (SELECT conv_id::VARCHAR AS path, CASE WHEN conv_id % 3 = 0 THEN 'log' || chr(10) ELSE '' END || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT path, {LINES.format(t='text')} AS ls FROM m),
u AS (SELECT path, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
h AS (SELECT path, ls, line, i, min(i) OVER (PARTITION BY path) AS first, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i) - 1, len(ls)) AS e FROM u WHERE regexp_matches(line, '^#{{1,6}}\\s+'))
SELECT path, CASE WHEN trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) = '' THEN '<section>' ELSE trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) END AS symbol,
       i::INT AS start_line, e::INT AS end_line, array_to_string(list_slice(ls, i, e), chr(10)) AS text FROM h
UNION ALL SELECT path, '<preamble>', 1, (first - 1)::INT, array_to_string(list_slice(ls, 1, first - 1), chr(10)) FROM (SELECT DISTINCT path, ls, first FROM h) WHERE first > 1"""

SAMPLE = '"""Module."""\nimport os\n\n\ndef top(x):\n    return x\n\n\nclass Small:\n    def one(self):\n        return 1\n\n\nclass Big:\n    """Many."""\n' + "".join(f"\n    def m{i}(self):\n        return {i}\n" for i in range(7)) + "\nLIMIT = 3\n"


def python_ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each region, its functions named after nations."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("region"), F.concat(F.lit("def n"), F.col("n_nationkey").cast("string"), F.lit("():\n    return '"), "n_name", F.lit("'\n")).alias("d"))
    body = nations.groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("d")), "\n").alias("d"))
    return chunking.chunk_files(body.select(F.concat("region", F.lit(".py")).alias("path"), F.lit("r").alias("repo"), F.lit(".py").alias("suffix"), F.concat(F.lit(SAMPLE), F.lit("\n"), "d").alias("text")))


def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order that no lineitem's interval covers."""
    first = (F.col("l_partkey") % 200 + 1).cast("int")
    intervals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), first.alias("start_line"), (first + F.col("l_quantity").cast("int")).alias("end_line"))
    return chunking.gaps(intervals, intervals.select("path").distinct().withColumn("n", F.lit(260)))


_GAPS = """WITH i AS (SELECT l_orderkey AS path, (l_partkey % 200 + 1)::INT AS s, (l_partkey % 200 + 1)::INT + l_quantity::INT AS e FROM lineitem),
a AS (SELECT path, s, e FROM i UNION ALL SELECT DISTINCT path, 261, 261 FROM i),
o AS (SELECT path, s, coalesce(max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first FROM a)
SELECT path, first::INT AS first, (s - 1)::INT AS last FROM o WHERE first < s"""


# Redaction

#: Made-up secrets, one of each kind, put at the end of every seventh document.
FAKES = ["id 4711471147:" + "Zz9" * 11 + "-q", "sk-or-madeup0madeup1madeup2", "AIza" + "Qw3rt" * 7, "ghp_" + "n0t4r34l" * 4 + "key9", "Bearer not.a.real-token~1", "my_api_key: 'NotARealKey_0987'", "ring +7 (812) 555-01-23 now", "at 10.20.30.40 port"]


def _with_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fake = F.element_at(F.array(*[F.lit(f) for f in FAKES]), (F.floor(F.col("doc_id") / 7) % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n"), fake)).otherwise(F.col("text")).alias("text"))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fakes(spark, sf_dir).select("doc_id", redaction.redact("text").alias("text"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.counts_by_kind(redaction.with_redaction(_with_fakes(spark, sf_dir))).select("kind", F.col("hits").cast("long").alias("hits"))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The patterns in the dialect without look-around: what stands before or after a match is put back.
_W, _NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_VALUE = r"[A-Za-z0-9+/_\-]{12,}"
_RE2 = {
    "telegram_token": (r"\b\d{6,12}:[A-Za-z0-9_-]{35}\b", "[REDACTED:telegram_token]"),
    "openai_key": (r"\bsk-(?:ant-|or-)?[A-Za-z0-9_-]{16,}\b", "[REDACTED:openai_key]"),
    "google_api_key": (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED:google_api_key]"),
    "github_token": (r"\b(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED:github_token]"),
    "bearer_token": (r"\bBearer\s+[A-Za-z0-9\-._~+/]{10,}=*", "[REDACTED:bearer_token]"),
    "credential": (rf"(?i)(^|{_NW})({_W}*(?:key|token|secret|password|passwd|api){_W}*\s*[:=]\s*)(?:(\")({_VALUE})(\")|(')({_VALUE})(')|({_VALUE}))", r"\1\2\3\6[REDACTED:credential]\5\8"),
    "phone": (r"(^|[^\p{L}\p{N}_.])(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b", r"\1[REDACTED:phone]"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED:ip_address]"),
}
_FAKED = f"d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || [{', '.join(map(_quote, FAKES))}][(doc_id // 7) % 8 + 1] ELSE text END AS t0 FROM documents)"
_STEPS = ", ".join(f"r{i + 1} AS (SELECT *, regexp_replace(t{i}, {_quote(p)}, {_quote(r)}, 'g') AS t{i + 1} FROM {'d' if not i else f'r{i}'})" for i, (p, r) in enumerate(_RE2.values()))
_HITS = " UNION ALL ".join(f"SELECT {_quote(kind)} AS kind, len(regexp_extract_all(t{i}, {_quote(p)})) AS n FROM r8" for i, (kind, (p, _)) in enumerate(_RE2.items()))


# Files


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["a%d.py", "B%d.PY", "my_secret%d.md", ".env%d", "x%d.pem", ".gitignore", "img%d.png", "big%d.txt", "_client%d.py", "archive.tar%d.gz"]
    dirs = ["", "src/pkg", "src/vendor_libs/x", "Build/out", ".venv/lib", "docs", "gen_generated", "a/node_modules/b", "src/core", "tests/unit"]
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 10 + 1).cast("int"))
    name = F.replace(pick(names, F.col("doc_id")), F.lit("%d"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), pick(dirs, F.floor(F.col("doc_id") / 10)).alias("rel_dir"), (F.col("n_chars") * 100).alias("size"))


_NAMES = """n AS (SELECT doc_id, replace(['a%d.py','B%d.PY','my_secret%d.md','.env%d','x%d.pem','.gitignore','img%d.png','big%d.txt','_client%d.py','archive.tar%d.gz'][doc_id % 10 + 1], '%d', doc_id::VARCHAR) AS name,
  ['','src/pkg','src/vendor_libs/x','Build/out','.venv/lib','docs','gen_generated','a/node_modules/b','src/core','tests/unit'][(doc_id // 10) % 10 + 1] AS rel_dir, n_chars * 100 AS size FROM documents),
c AS (SELECT *, CASE WHEN contains(lower(name), 'credential') OR contains(lower(name), 'secret') OR contains(lower(name), '.env') OR regexp_matches(lower(name), '\\.(pem|key|p12)$') THEN 'secret_like_name'
  WHEN NOT regexp_matches(lower(name), '^.+\\.(py|md|rst|txt|yaml|yml|toml|cfg|ini|sh|j2)$') THEN 'extension_not_included' WHEN size > 307200 THEN 'too_large' END AS reason,
  list_filter(list_transform(range(1, len(string_split(rel_dir, '/')) + 1), lambda i: array_to_string(list_slice(string_split(rel_dir, '/'), 1, i), '/')),
    lambda d: list_contains({names}, lower(string_split(d, '/')[-1])) OR len(list_filter({parts}, lambda v: contains(lower(d), v))) > 0)[1] AS pruned_at FROM n),
d AS (SELECT *, CASE WHEN list_contains({names}, lower(string_split(pruned_at, '/')[-1])) THEN 'skip_dir_name' WHEN pruned_at IS NOT NULL THEN 'vendored_or_generated' END AS dir_reason FROM c)""".replace(
    "{names}", f"[{', '.join(map(_quote, sources.SKIPPED_DIRECTORIES))}]"
).replace("{parts}", f"[{', '.join(map(_quote, sources.VENDORED))}]")


def file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).select("doc_id", "name", sources.file_reason(F.col("name"), F.col("size")).alias("reason"))


def dir_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.pruned_at(F.col("rel_dir"))
    return _listing(spark, sf_dir).select("doc_id", "rel_dir", at.alias("pruned_at"), sources.directory_reason(at).alias("reason"))


def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(sources.directory_reason(sources.pruned_at(F.col("rel_dir"))), sources.file_reason(F.col("name"), F.col("size")))
    return _listing(spark, sf_dir).select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def _snapshots(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """path and sha256, and the text if the whole is asked for, of the documents before: without every ninth, with another text in every fifth; and now: without every eleventh."""
    now = files(spark, sf_dir)
    before = now.filter("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    return tuple(df.select("path", sha, *(["text"] if whole else [])) for df in (before, now.filter("doc_id % 11 <> 0")))


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diff(*_snapshots(spark, sf_dir))


_DIFF = f"""WITH {FILES_SQL},
b AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM files WHERE doc_id % 9 <> 0), n AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 11 <> 0)
SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'new' WHEN b.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN n ON b.path = n.path"""


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diff(*_snapshots(spark, sf_dir)).filter("status = 'deleted'").select("path")


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, "m1").otherwise("m2").alias("model"))
    return vectors.missing(chunks(spark, sf_dir), rows, "m1").select("chunk_id")


# Text


def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in several styles made of part names."""
    name = F.concat(F.lit("XMLReader"), F.col("p_partkey").cast("string"), F.lit("ForURL.get_"), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("/"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.identifier_parts(name), " ").alias("parts"))


_CAMEL = r"""WITH n AS (SELECT p_partkey, 'XMLReader' || p_partkey || 'ForURL.get_' || replace(p_type, ' ', '-') || '/' || p_name AS x FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS x FROM n)
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(x), '[\\/_\-.\s]+'), lambda p: p <> ''), ' ') AS parts FROM c"""


def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", text.header("path", "symbol", "kind").alias("header"), text.header_tokens("path", "symbol", "kind", "repo").alias("tokens"))


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_tokens("text"), " ").alias("tokens"))


_STOP = "[" + ", ".join(_quote(w) for w in sorted(text.STOPWORDS)) + "]"
_TOKENS = "list_filter(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)), lambda w: NOT list_contains(" + _STOP + ", w))"


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("stem", stemmed("word"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", text.snippet("text").alias("snippet"))


def source_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "path", text.source_prior("path").alias("prior"))


_PRIOR = "CASE WHEN regexp_matches({p}, '(?i)(^|/)(tests?|docs?|examples?|benchmarks?|questions)/|(^|/)test_[^/]*\\.py$|_test\\.py$|(^|/)(changelog|changes|history|faq|readme|contributing)[^/]*$|\\.(md|rst|txt)$') THEN 0.5 ELSE 1.0 END"


# Keyword search, unstemmed so that SQL can follow


def _corpus(spark: SparkSession, sf_dir: str) -> plans.Corpus:
    """The stored index, with the vectors of the embeddings table as those of the queries of the same numbers."""
    corpus = plans.open_store(stored(spark, sf_dir, stem=False), "given")
    return replace(corpus, embed_queries=lambda q: _asked(spark, sf_dir).join(q.select("qid"), "qid", "left_semi"), stem=False, digits=DIGITS)


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every term of both fields, as the store keeps them."""
    found = _corpus(spark, sf_dir).index
    each = keyword.added_up(found.dictionary, found.totals, whole=True).select("field", "term", "df")
    return each.withColumns({"n_chunks": F.lit(found.totals[0]).cast("long"), "n_terms": F.lit(found.totals[1]).cast("long")})


_TERMS = "regexp_extract_all(lower(strip_accents({t})), '[\\p{{L}}\\p{{N}}]+')"
_KEYWORD = f"""{CHUNKS_SQL}, {QUERIES_SQL},
t AS (SELECT chunk_id, 'header' AS field, unnest({_TERMS.format(t="path || ' ' || symbol || ' ' || kind || ' ' || repo")}) AS term FROM chunks
      UNION ALL SELECT chunk_id, 'body', unnest({_TERMS.format(t='text')}) FROM chunks),
lengths AS (SELECT chunk_id, count(term) AS length FROM chunks LEFT JOIN t USING (chunk_id) GROUP BY chunk_id),
post AS (SELECT chunk_id, field, term, count(*) AS hits FROM t GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
ask AS (SELECT qid, unnest(list_distinct({_TOKENS.format(t='query')})) AS token FROM queries),
ph AS (SELECT qid, token, field, lower(strip_accents(token)) AS term FROM ask, (VALUES ('header'), ('body')) f(field)),
scored AS (SELECT qid, chunk_id, round(sum((CASE WHEN n <= 2 * df THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), {DIGITS}) AS score
  FROM (SELECT qid, chunk_id, df.df, hits * CASE field WHEN 'header' THEN 3.0 ELSE 1.0 END AS f FROM ph JOIN post USING (field, term) JOIN df USING (field, term)) JOIN lengths USING (chunk_id), corpus GROUP BY qid, chunk_id)"""


def _ranked_sql(name: str, source: str, limit: int, order: str = "score DESC, chunk_id", columns: str = "qid, chunk_id, score") -> str:
    return f"{name} AS (SELECT {columns}, (row_number() OVER (PARTITION BY qid ORDER BY {order}) - 1)::INT AS rank FROM {source} QUALIFY rank < {limit})"


def _final_sql(name: str, source: str, k: int = K) -> str:
    """Prior, cap and limit."""
    return f"""{name}_p AS (SELECT s.qid, s.chunk_id, c.path, round(s.score * {_PRIOR.format(p='c.path')}, {DIGITS + 1}) AS score, s.rank AS came FROM {source} s JOIN chunks c USING (chunk_id)),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, came) AS r FROM {name}_p),
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY r) AS f FROM {name}_r),
{name} AS (SELECT qid, chunk_id, path, score, (row_number() OVER (PARTITION BY qid ORDER BY r) - 1)::INT AS rank FROM {name}_c WHERE f <= 2 QUALIFY rank < {k})"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return plans.final(corpus, plans.keyword_pool(corpus, queries(spark, sf_dir), POOL), K).select("qid", "chunk_id", "path", "score", "rank")


def bm25_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.keyword_pool(_corpus(spark, sf_dir), queries(spark, sf_dir), POOL, "src3")


def bm25_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole results of the stored index, with the fields and snippets of their chunks."""
    return plans.search(_corpus(spark, sf_dir), queries(spark, sf_dir), K, "bm25")


def hybrid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.search(_corpus(spark, sf_dir), queries(spark, sf_dir), K, "hybrid")


# Vector search


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each query: that with the query's number."""
    return _vectors(spark, sf_dir).withColumnRenamed("chunk_id", "qid").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")


_DENSE = f"dense AS (SELECT q.item_id AS qid, v.vec_id AS chunk_id, round(list_inner_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), {DIGITS}) AS score FROM benchmark q JOIN embeddings a ON a.vec_id = q.item_id, embeddings v {{where}})"


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), POOL, digits=DIGITS)
    return ranking.capped(ranking.with_prior(found, chunks(spark, sf_dir), DIGITS), K).select("qid", "chunk_id", "path", "score", "rank")


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from vectors by cells, of which those that can't matter aren't multiplied."""
    folder = f"{shared_dir(spark)}/cells-{uuid4().hex}"
    held = cells.build(_vectors(spark, sf_dir), folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    found = cells.search(held, _asked(spark, sf_dir), POOL, digits=DIGITS)
    return ranking.capped(ranking.with_prior(found, chunks(spark, sf_dir), DIGITS), K).select("qid", "chunk_id", "path", "score", "rank")


def dense_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), POOL, chunks(spark, sf_dir), "src3", DIGITS)


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors made of the events' values and numbers; zeros stay."""
    raw = table(spark, sf_dir, "events").select("event_id", F.array(F.floor("value"), F.floor("value") % 3, F.col("event_id") % 2).cast("array<double>").alias("v"))
    unit = vectors.normalize("v")
    return raw.select("event_id", *(F.round(unit[i], DIGITS).alias(f"x{i}") for i in range(3)))


# Fusion


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _corpus(spark, sf_dir), queries(spark, sf_dir)
    return ranking.fuse([plans.keyword_pool(corpus, asked, POOL), plans.dense_pool(corpus, asked, POOL)], weights=[ranking.KEYWORD_WEIGHT, 1.0], digits=DIGITS)


def _fused_sql(size: int) -> str:
    return f"""{_KEYWORD}, {_DENSE.format(where='')}, {_ranked_sql('kp', 'scored', size)}, {_ranked_sql('dp', 'dense', size)},
fused_s AS (SELECT coalesce(kp.qid, dp.qid) AS qid, coalesce(kp.chunk_id, dp.chunk_id) AS chunk_id, round(coalesce(0.5 / (61 + kp.rank), 0) + coalesce(1.0 / (61 + dp.rank), 0), {DIGITS}) AS score, kp.rank AS a, dp.rank AS b FROM kp FULL JOIN dp ON kp.qid = dp.qid AND kp.chunk_id = dp.chunk_id),
{_ranked_sql('fused', 'fused_s', 10**9, 'score DESC, a NULLS LAST, b NULLS LAST')}"""


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.hybrid_candidates(_corpus(spark, sf_dir), queries(spark, sf_dir), K).select("qid", "chunk_id", "path", "score", "rank")


def rerank_fuse(spark: SparkSession, sf_dir: str, first: int = ranking.RERANKED, k: int = K) -> DataFrame:
    """Relevance: the share of the query's tokens that the chunk's text has, as a logit."""
    corpus, asked = _corpus(spark, sf_dir), queries(spark, sf_dir)
    candidates = keyword.held(plans.hybrid_candidates(corpus, asked, first).select("qid", "chunk_id", "score", "rank"))
    first = candidates.filter(F.col("rank") < ranking.RERANKED)
    # Texts are split into tokens once each, and only those of candidates.
    has = corpus.chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", text.query_tokens("text").alias("has"))
    rows = first.join(has, "chunk_id").join(asked.select("qid", text.query_tokens("query").alias("wants")), "qid")
    share = F.size(F.array_intersect("has", "wants")) / F.greatest(F.lit(1), F.size("wants"))
    relevance = rows.select("qid", "chunk_id", F.round(text.to_unit_interval(6 * share - 3), DIGITS).alias("relevance"))
    return ranking.rerank(candidates, relevance, corpus.chunks, k, digits=DIGITS).select("qid", "chunk_id", "score", "rank")


def rerank_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More candidates and results than are reranked: the rest follow with score 0."""
    return rerank_fuse(spark, sf_dir, 28, 26)


def _rerank_sql(first: int, k: int) -> str:
    return f"""WITH {_fused_sql(max(30, 6 * first))}, {_final_sql('cand', 'fused', first)},
rel AS (SELECT c.qid, c.chunk_id, c.path, c.rank, round(0.5 * (1 + tanh((6.0 * len(list_intersect(list_distinct({_TOKENS.format(t='k.text')}), list_distinct({_TOKENS.format(t='q.query')}))) / greatest(1, len(list_distinct({_TOKENS.format(t='q.query')}))) - 3) / 2)), {DIGITS}) AS rel
  FROM cand c JOIN chunks k USING (chunk_id) JOIN queries q ON q.qid = c.qid WHERE c.rank < 20),
own AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rel * {_PRIOR.format(p='path')}, {DIGITS + 1}) DESC, rank) - 1 AS second FROM rel),
again AS (SELECT qid, chunk_id, round(1.0 / (61 + rank) + 1.0 / (61 + second), {DIGITS}) AS score, rank AS came FROM own UNION ALL SELECT qid, chunk_id, 0.0, rank FROM cand WHERE rank >= 20)
SELECT qid, chunk_id, score::DOUBLE AS score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, came) - 1)::INT AS rank FROM again QUALIFY rank < {k}"""


def file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, by falling length, as one list."""
    all_ = chunks(spark, sf_dir).select(F.pmod("chunk_id", F.lit(5)).alias("qid"), "chunk_id", "path", F.length("text").cast("double").alias("score"))
    ranked = ranking.ranked(all_, F.desc("score"), F.col("chunk_id"))
    return ranking.capped(ranked, 20).select("qid", "chunk_id", "path", "score", "rank")


_CAP = f"""WITH {CHUNKS_SQL}, a AS (SELECT chunk_id % 5 AS qid, chunk_id, path, length(text)::DOUBLE AS score FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY r) AS f FROM r) SELECT qid, chunk_id, path, score, (row_number() OVER (PARTITION BY qid ORDER BY r) - 1)::INT AS rank FROM c WHERE f <= 2 QUALIFY rank < 20"""


# Evaluation: the questions are the benchmark items, asked by keywords; expected are the files of the documents that hold the item's words


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten chunks, each taken as some lines of its file."""
    corpus = _corpus(spark, sf_dir)
    found = plans.final(corpus, plans.keyword_pool(corpus, queries(spark, sf_dir), ranking.pool_size(10)), 10)
    first = (F.col("chunk_id") % 50 + 1).cast("int")
    return keyword.held(found.select("qid", (F.col("rank") + 1).alias("rank"), "path", first.alias("start_line"), (first + 30).alias("end_line")))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and path of the documents that hold the item."""
    docs = chunks(spark, sf_dir)
    held = holding(docs.select(F.col("chunk_id").alias("doc"), "text"), queries(spark, sf_dir).select(F.col("qid").alias("passage"), F.col("query").alias("text")))
    truth = held.join(docs.select(F.col("chunk_id").alias("doc"), "path"), "doc").select(F.col("passage").alias("qid"), "path").distinct()
    # Questions and ranks read it several times; texts are searched once.
    folder = f"{shared_dir(spark)}/truth-{uuid4().hex}"
    truth.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(truth.schema).parquet(folder)


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The questions, every third with a span in the first of its files, and their expected files: any of these, or, for every second question, one in `docs` and one elsewhere, if it has both."""
    truth = _truth(spark, sf_dir)
    first = truth.groupBy("qid").agg(F.min("path").alias("first"))
    asked = queries(spark, sf_dir).select("qid").join(first, "qid", "left")
    spans = F.when((F.col("qid") % 3 == 0) & F.col("first").isNotNull(), F.array(F.concat("first", F.lit(":20-40"))))
    questions = asked.select("qid", F.concat(F.lit("q"), F.col("qid").cast("string")).alias("id"), spans.alias("expected_spans"))
    group = F.when((F.col("qid") % 2 == 1) & F.col("path").contains("/docs/"), 1).otherwise(0)
    return questions, truth.select("qid", group.alias("g"), text.normal_path("path").alias("p"))


_SPACED = "regexp_replace(' ' || {t} || ' ', '[\\x20\\x09-\\x0D]+', ' ', 'g')"
_EVAL = f"""WITH {_KEYWORD}, {_ranked_sql('pool', 'scored', 60)}, {_final_sql('found', 'pool', 10)},
hits AS (SELECT qid, rank + 1 AS rank, lower(path) AS path, chunk_id % 50 + 1 AS s, chunk_id % 50 + 31 AS e FROM found),
truth AS (SELECT DISTINCT qid, path FROM queries JOIN chunks ON contains({_SPACED.format(t='text')}, {_SPACED.format(t='query')})),
qs AS (SELECT qid, lower(min(path)) AS first FROM queries LEFT JOIN truth USING (qid) GROUP BY qid),
g AS (SELECT qid, CASE WHEN qid % 2 = 1 AND contains(path, '/docs/') THEN 1 ELSE 0 END AS g, lower(path) AS p FROM truth),
gr AS (SELECT g.qid, g.g, min(h.rank) AS r FROM g LEFT JOIN hits h ON h.qid = g.qid AND h.path = g.p GROUP BY ALL),
fr AS (SELECT qs.qid, CASE WHEN bool_or(r IS NULL) THEN NULL ELSE max(r) END AS file_rank FROM qs LEFT JOIN gr USING (qid) GROUP BY qs.qid),
sr AS (SELECT qs.qid, CASE WHEN qs.qid % 3 = 0 AND qs.first IS NOT NULL THEN (SELECT min(h.rank) FROM hits h WHERE h.qid = qs.qid AND h.path = qs.first AND h.s <= 40 AND h.e >= 20) ELSE fr.file_rank END AS span_rank FROM qs JOIN fr USING (qid)),
ranks AS (SELECT fr.qid, 'q' || fr.qid AS id, file_rank::INT AS file_rank, span_rank::INT AS span_rank FROM fr JOIN sr USING (qid))"""


def eval_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, wanted = _questions(spark, sf_dir)
    return evaluation.file_ranks(questions, _hits(spark, sf_dir), wanted)


def eval_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, wanted = _questions(spark, sf_dir)
    return evaluation.span_ranks(questions, _hits(spark, sf_dir), wanted)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, wanted = _questions(spark, sf_dir)
    m = evaluation.metrics(evaluation.ranks(questions, _hits(spark, sf_dir), wanted))
    names = [f"{p}{n}" for p in ("", "fn_") for n in ("recall_5", "recall_10", "mrr")]
    return m.select(*(F.round(n, DIGITS).alias(n) for n in names), F.array_join("misses", ",").alias("misses"), F.array_join("fn_misses", ",").alias("fn_misses"))


def _metrics_sql(r: str, p: str) -> str:
    return f"""round(avg(CASE WHEN {r} <= 5 THEN 1.0 ELSE 0.0 END), {DIGITS}) AS {p}recall_5, round(avg(CASE WHEN {r} <= 10 THEN 1.0 ELSE 0.0 END), {DIGITS}) AS {p}recall_10,
round(avg(coalesce(1.0 / {r}, 0)), {DIGITS}) AS {p}mrr, coalesce(string_agg(id, ',' ORDER BY qid) FILTER (WHERE {r} IS NULL OR {r} > 5), '') AS {p}misses"""


# Tables


def repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, stem=False).repos()


def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, stem=False).repo_ids("src3")


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the ids that the embeddings name; ids without a chunk give nothing."""
    ids = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("chunk_id")).distinct()
    return stored(spark, sf_dir, stem=False).chunks_by_id(ids).select("chunk_id", "path", "repo", F.length("text").cast("long").alias("n_chars"))


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the stored index, and its highest id."""
    store = stored(spark, sf_dir, stem=False)
    parts = [store.read(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last")) for t in ("chunks", "postings", "lengths", "embeddings")]
    return reduce(DataFrame.unionByName, parts)


_TABLES = """SELECT 'chunks' AS name, count(*) AS n, max(chunk_id) AS last FROM chunks UNION ALL SELECT 'postings', count(*), max(chunk_id) FROM post
UNION ALL SELECT 'lengths', count(*), max(chunk_id) FROM lengths UNION ALL SELECT 'embeddings', count(*), max(vec_id) FROM embeddings"""


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one day are indexed, then those of the next: hash, chunks and vectors of each file that is there. Rows of files that went or changed must be gone from every table."""
    store = Store(spark, f"{shared_dir(spark)}/update-{uuid4().hex}")
    for number in (0, 1):
        found = _snapshots(spark, sf_dir, whole=True)[number]
        index_files(store, found.withColumns({"size": F.octet_length("text").cast("long"), "mtime": F.lit(float(number)), "repo": F.lit("r"), "suffix": F.lit(".txt")}), ["hashing"])
    path = spark._jvm.org.apache.hadoop.fs.Path(store.root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    count = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    own = store.read("chunks").select("chunk_id", "path")
    # Rows of ids that no chunk has would show as those of a file without a name.
    of = lambda name: store.read(name).join(own, "chunk_id", "left")
    out = store.read("files").select("path", "sha256")
    for df, name in ((own, "chunks"), (of("embeddings"), "vectors"), (of("lengths"), "lengths")):
        out = out.join(count(df, name), "path", "full_outer")
    return out.select("path", "sha256", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "vectors", "lengths")))


def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of the stored index with stems and the hashing model."""
    return plans.search(plans.open_store(stored(spark, sf_dir, stem=True)), queries(spark, sf_dir), K, "hybrid+rerank")

QUERIES = {
    "line_windows": line_windows, "char_split": char_split, "oversize_split": oversize_split, "markdown_sections": markdown_sections, "python_ast_chunks": python_ast_chunks, "gap_merge": gap_merge,
    "redact": redact, "redact_counts": redact_counts, "file_classify": file_classify, "dir_prune": dir_prune, "skip_counts": skip_counts, "content_hash": content_hash, "file_diff": diff_files,
    "deleted_files": deleted_files, "missing_embeddings": missing_embeddings, "identifier_split": identifier_split, "header_tokens": header_tokens, "query_tokens": query_tokens,
    "stopword_filter": stopword_filter, "stem_vocab": stem_vocab, "snippet": snippets, "source_prior": source_prior, "bm25_stats": bm25_stats, "bm25_topk": bm25_topk, "bm25_repo": bm25_repo,
    "bm25_results": bm25_results, "hybrid_results": hybrid_results, "rerank_tail": rerank_tail, "repo_ids": repo_ids, "index_tables": index_tables, "index_update": index_update,
    "dense_topk": dense_topk, "dense_cells": dense_cells, "dense_repo": dense_repo, "normalize": normalize, "rrf_fuse": rrf_fuse, "hybrid_topk": hybrid_topk, "rerank_fuse": rerank_fuse, "file_cap": file_cap,
    "eval_file": eval_file, "eval_span": eval_span, "eval_metrics": eval_metrics, "repo_counts": repo_counts, "chunk_lookup": chunk_lookup, "stemmed_search": stemmed_search,
}

_SNIPPET = "CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(regexp_replace(regexp_replace(substr(t, 1, 240), '\\n[^\\n]*$', ''), '^\\s+', ''), '\\s+$', '') || ' ...' END"
_RESULTS = f"""SELECT f.qid, f.rank, f.chunk_id, c.path, c.repo, c.symbol, c.kind, 1 AS start_line, 60 AS end_line, {_SNIPPET} AS snippet, f.score
FROM found f JOIN (SELECT *, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM chunks) c USING (chunk_id)"""
_NOW_SQL = FILES_SQL + ", now_files AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 11 <> 0)"

ORACLES = {
    "line_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "char_split": f"WITH {CHUNKS_SQL} {_CHARS.format(source='chunks', extra='')}",
    "oversize_split": f"WITH {_OVERSIZE}",
    "markdown_sections": _MARKDOWN,
    "gap_merge": _GAPS,
    "redact": f"WITH {_FAKED}, {_STEPS} SELECT doc_id, t8 AS text FROM r8",
    "redact_counts": f"WITH {_FAKED}, {_STEPS} SELECT kind, sum(n)::BIGINT AS hits FROM ({_HITS}) GROUP BY kind HAVING sum(n) > 0",
    "file_classify": f"WITH {_NAMES} SELECT doc_id, name, reason FROM c",
    "dir_prune": f"WITH {_NAMES} SELECT doc_id, rel_dir, pruned_at, dir_reason AS reason FROM d",
    "skip_counts": f"WITH {_NAMES} SELECT r AS reason, count(*) AS n FROM (SELECT coalesce(dir_reason, reason) AS r FROM d) WHERE r IS NOT NULL GROUP BY r",
    "content_hash": f"WITH {FILES_SQL} SELECT path, sha256(text) AS sha256 FROM files",
    "file_diff": _DIFF,
    "deleted_files": f"WITH {FILES_SQL} SELECT path FROM files WHERE doc_id % 9 <> 0 AND doc_id % 11 = 0",
    "missing_embeddings": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)",
    "identifier_split": _CAMEL,
    "header_tokens": f"WITH {CHUNKS_SQL} SELECT chunk_id, path || ' | ' || symbol || ' | ' || kind AS header, array_to_string(list_filter(regexp_split_to_array(lower(path || ' ' || symbol || ' ' || kind || ' ' || repo), '[\\\\/_\\-.\\s]+'), lambda p: p <> ''), ' ') AS tokens FROM chunks",
    "query_tokens": f"SELECT item_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ' ') AS tokens FROM (SELECT item_id, {_TOKENS.format(t='text')} AS l FROM benchmark)",
    "stopword_filter": f"SELECT doc_id, len({_TOKENS.format(t="coalesce(text, '')")}) AS n_tokens FROM documents",
    "snippet": f"WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM chunks) SELECT chunk_id, {_SNIPPET} AS snippet FROM s",
    "source_prior": f"WITH {CHUNKS_SQL} SELECT chunk_id, path, ({_PRIOR.format(p='path')})::DOUBLE AS prior FROM chunks",
    "bm25_stats": f"WITH {_KEYWORD} SELECT field, term, df, (SELECT n FROM corpus) AS n_chunks, (SELECT sum(length)::BIGINT FROM lengths) AS n_terms FROM df",
    "bm25_topk": f"WITH {_KEYWORD}, {_ranked_sql('pool', 'scored', POOL)}, {_final_sql('found', 'pool')} SELECT * FROM found",
    "bm25_repo": f"WITH {_KEYWORD}, mine AS (SELECT scored.* FROM scored JOIN chunks USING (chunk_id) WHERE repo = 'src3'), {_ranked_sql('pool', 'mine', POOL)} SELECT * FROM pool",
    "dense_topk": f"WITH {CHUNKS_SQL}, {_DENSE.format(where='')}, {_ranked_sql('pool', 'dense', POOL)}, {_final_sql('found', 'pool')} SELECT * FROM found",
    "dense_cells": f"WITH {CHUNKS_SQL}, {_DENSE.format(where='')}, {_ranked_sql('pool', 'dense', POOL)}, {_final_sql('found', 'pool')} SELECT * FROM found",
    "dense_repo": f"WITH {CHUNKS_SQL}, {_DENSE.format(where='''JOIN chunks c ON c.chunk_id = v.vec_id WHERE c.repo = 'src3' ''')}, {_ranked_sql('pool', 'dense', POOL)} SELECT * FROM pool",
    "normalize": f"WITH v AS (SELECT event_id, floor(value) AS a, floor(value)::BIGINT % 3 AS b, event_id % 2 AS c FROM events), n AS (SELECT *, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN 1.0 ELSE sqrt((a * a + b * b + c * c)::DOUBLE) END AS l FROM v) SELECT event_id, round(a / l, {DIGITS}) AS x0, round(b / l, {DIGITS}) AS x1, round(c / l, {DIGITS}) AS x2 FROM n",
    "rrf_fuse": f"WITH {_fused_sql(POOL)} SELECT * FROM fused",
    "hybrid_topk": f"WITH {_fused_sql(POOL)}, {_final_sql('found', 'fused')} SELECT * FROM found",
    "rerank_fuse": _rerank_sql(20, K),
    "rerank_tail": _rerank_sql(28, 26),
    "bm25_results": f"WITH {_KEYWORD}, {_ranked_sql('pool', 'scored', POOL)}, {_final_sql('found', 'pool')} {_RESULTS}",
    "hybrid_results": f"WITH {_fused_sql(POOL)}, {_final_sql('found', 'fused')} {_RESULTS}",
    "repo_ids": f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE repo = 'src3'",
    "index_tables": f"WITH {_KEYWORD} {_TABLES}",
    "index_update": f"WITH {_OVERSIZE.replace(FILES_SQL, _NOW_SQL)}".replace("SELECT path, symbol, start_line, end_line, text FROM windows WHERE", "SELECT n.path, n.h AS sha256, count(w.path) AS chunks, count(w.path) AS vectors, count(w.path) AS lengths FROM now_files n LEFT JOIN (SELECT path, symbol, start_line, end_line, text FROM windows WHERE", 1) + ") w ON w.path = n.path GROUP BY n.path, n.h",
    "file_cap": _CAP,
    "eval_file": f"{_EVAL} SELECT qid, file_rank FROM ranks",
    "eval_span": f"{_EVAL} SELECT qid, span_rank FROM ranks",
    "eval_metrics": f"{_EVAL} SELECT {_metrics_sql('file_rank', '')}, {_metrics_sql('span_rank', 'fn_')} FROM ranks",
    "repo_counts": f"WITH {CHUNKS_SQL} SELECT repo, count(*) AS chunks FROM chunks GROUP BY repo",
    "chunk_lookup": f"WITH {CHUNKS_SQL} SELECT chunk_id, path, repo, length(text) AS n_chars FROM chunks WHERE chunk_id IN (SELECT vec_id * 3 FROM embeddings)",
}
