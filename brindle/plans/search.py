
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_input, snippet
from ..operators import keyword, ranking, vectors
from ..sources.store import Store

MODES = ("bm25", "dense", "hybrid", "hybrid+rerank")
RESULT = ["qid", "rank", "chunk_id", "path", "repo", "symbol", "kind", "start_line", "end_line", "snippet", "score"]


@dataclass
class Corpus:
    """What a search reads. chunks: chunk_id, path, repo, symbol, kind, start_line, end_line, text, header."""

    chunks: DataFrame
    index: keyword.KeywordIndex
    vectors: DataFrame
    embed_queries: Callable[[DataFrame], DataFrame]  # queries(qid, query) to (qid, vector)
    stem: bool = True
    digits: int | None = None  # rounds scores before they are ranked, for comparison with other engines


def open_store(store: Store, model: str = "hashing") -> Corpus:
    """The store as it is now: whatever is committed later, the corpus stays the same."""
    now = store.snapshot()
    chunks = now.read("chunks")
    index = keyword.KeywordIndex(now.read("postings"), now.read("lengths"), chunks.select("chunk_id", "path", "repo"), now.read("lists"), now.read("dictionary"), tuple(now.state["totals"]), now.read("dead") if now.dead else None)
    return Corpus(chunks, index, now.vectors(model), lambda q: vectors.embed(q, model, "query", query=True, keep="qid"))


def keyword_pool(corpus: Corpus, queries: DataFrame, size: int, repo: str | None = None) -> DataFrame:
    return keyword.search(corpus.index, queries, size, repo, corpus.stem, corpus.digits)


def dense_pool(corpus: Corpus, queries: DataFrame, size: int, repo: str | None = None) -> DataFrame:
    return vectors.search(corpus.vectors, corpus.embed_queries(queries), size, corpus.chunks, repo, corpus.digits)


def final(corpus: Corpus, pool: DataFrame, k: int) -> DataFrame:
    """Prior, cap for each file, first k."""
    return ranking.capped(ranking.with_prior(pool, corpus.chunks, corpus.digits), k)


def hybrid_candidates(corpus: Corpus, queries: DataFrame, k: int, repo: str | None = None) -> DataFrame:
    size = ranking.pool_size(k)
    pools = [keyword_pool(corpus, queries, size, repo), dense_pool(corpus, queries, size, repo)]
    return final(corpus, ranking.fuse(pools, weights=[ranking.KEYWORD_WEIGHT, 1.0], digits=corpus.digits), k)


def reranked(corpus: Corpus, queries: DataFrame, k: int, repo: str | None = None, logits=ranking.overlap_logits) -> DataFrame:
    candidates = keyword.held(hybrid_candidates(corpus, queries, max(k, ranking.RERANKED), repo))  # few rows that are read thrice; broadcast, so that no texts are shuffled to them
    inputs = corpus.chunks.select("chunk_id", embedding_input("header", "text").alias("input"))
    relevance = ranking.relevance(candidates, queries, inputs, logits)
    return ranking.rerank(candidates.select("qid", "chunk_id", "score", "rank"), relevance, corpus.chunks, k, digits=corpus.digits)


def hydrated(corpus: Corpus, found: DataFrame) -> DataFrame:
    """Results with their chunks' fields; snippets are made of the final rows' texts only, and of each once."""
    found = keyword.held(found.select("qid", "chunk_id", "score", "rank"))
    texts = corpus.chunks.join(found.select("chunk_id"), "chunk_id", "left_semi")
    fields = texts.select("chunk_id", "path", "repo", "symbol", "kind", "start_line", "end_line", snippet("text").alias("snippet"))
    return found.join(fields, "chunk_id").select(*RESULT).orderBy("qid", "rank")


def search(corpus: Corpus, queries: DataFrame, k: int = 8, mode: str = "hybrid", repo: str | None = None, logits=ranking.overlap_logits) -> DataFrame:
    """The k best chunks of each query."""
    if mode == "bm25":
        found = final(corpus, keyword_pool(corpus, queries, ranking.pool_size(k), repo), k)
    elif mode == "dense":
        found = final(corpus, dense_pool(corpus, queries, ranking.pool_size(k), repo), k)
    elif mode == "hybrid":
        found = hybrid_candidates(corpus, queries, k, repo)
    elif mode == "hybrid+rerank":
        found = reranked(corpus, queries, k, repo, logits)
    else:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)} is asked for")
    return hydrated(corpus, found)


def run_mode(corpus: Corpus, questions: DataFrame, mode: str, logits=ranking.overlap_logits) -> dict:
    """Metrics of one mode over a set of questions, and the mean seconds a question takes in the batch."""
    import time

    from ..operators import evaluation

    queries = questions.select("qid", F.col("question").alias("query"))
    # Loads models and starts workers, which isn't counted.
    search(corpus, queries.limit(1), evaluation.DEPTH, mode, logits=logits).collect()
    began = time.perf_counter()
    hits = search(corpus, queries, evaluation.DEPTH, mode, logits=logits).withColumn("rank", F.col("rank") + 1).cache()
    hits.count()
    seconds = time.perf_counter() - began
    out = evaluation.metrics(evaluation.ranks(questions, hits)).first().asDict()
    hits.unpersist()
    return out | {"latency_ms": 1000 * seconds / max(1, questions.count())}
