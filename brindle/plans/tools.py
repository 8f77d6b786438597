
from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.store import Store
from . import search as plans


def search_code(spark: SparkSession, root: str, query: str, k: int = 8, repo: str | None = None, rerank: bool = False) -> list[dict]:
    """Hybrid search; the best match first."""
    corpus = plans.open_store(Store(spark, root))
    rows = plans.search(corpus, spark.createDataFrame([(0, query)], "qid int, query string"), k, "hybrid+rerank" if rerank else "hybrid", repo)
    return [{k_: v for k_, v in r.asDict().items() if k_ not in ("qid", "rank")} for r in rows.collect()]


def read_chunk(spark: SparkSession, root: str, chunk_id: int) -> dict:
    """A chunk with its whole text; {} if there is none."""
    return Store(spark, root).chunk(chunk_id) or {}


def list_repos(spark: SparkSession, root: str) -> list[dict]:
    return [r.asDict() for r in Store(spark, root).repos().collect()]
