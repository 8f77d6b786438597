
from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import source_prior, to_unit_interval
from .vectors import parse_model

# Fixed values
RRF_K, KEYWORD_WEIGHT = 60, 0.5
PER_FILE, POOL_FACTOR, LEAST_POOL, RERANKED = 2, 6, 30, 20
SCORED_AT_ONCE, LONGEST_INPUT = 8, 512

Scorer = Callable[[list[str], list[str]], list[float]]


def pool_size(k: int) -> int:
    return max(POOL_FACTOR * k, LEAST_POOL)


def ranked(df: DataFrame, *order: Column, first: int | None = None) -> DataFrame:
    """Ranks from 0 within each query; of the first so many rows, if that is said. Those are picked before the rank is lowered, as each task then keeps only
    so many of its rows before they are shuffled."""
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    if first is not None:
        df = df.filter(F.col("rank") <= first)
    return df.withColumn("rank", F.col("rank") - 1)


def with_prior(scored: DataFrame, paths: DataFrame, digits: int | None = None) -> DataFrame:
    """Scores times the prior of the chunk's path, ranked anew; ties keep their order. Chunks without a path go later, in capped. A rounded score is kept
    to one more digit, so that half of it isn't rounded again."""
    score = F.col("score") * source_prior(F.coalesce("path", F.lit("")))
    out = scored.join(paths.select("chunk_id", "path"), "chunk_id", "left").withColumn("score", score if digits is None else F.round(score, digits + 1))
    return ranked(out, F.desc("score"), F.col("rank"))


def capped(scored: DataFrame, k: int, per_file: int = PER_FILE) -> DataFrame:
    """The first k of each query, with at most per_file chunks of a path; rows without a path are left out. scored has paths."""
    in_file = Window.partitionBy("qid", "path").orderBy("rank")
    kept = scored.filter(F.col("path").isNotNull()).withColumn("in_file", F.row_number().over(in_file)).filter(F.col("in_file") <= per_file).drop("in_file")
    return ranked(kept, F.col("rank"), first=k)


def fuse(lists: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None, digits: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion. Ties keep the order in which chunks come up first: by the first list, then by the next."""
    weights = weights or [1.0] * len(lists)
    parts = [df.select("qid", "chunk_id", (F.lit(w) / (k + F.col("rank") + 1)).alias("part"), *(F.when(F.lit(i == j), F.col("rank")).alias(f"r{j}") for j in range(len(lists)))) for i, (df, w) in enumerate(zip(lists, weights))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    score = F.sum("part") if digits is None else F.round(F.sum("part"), digits)
    out = union.groupBy("qid", "chunk_id").agg(score.alias("score"), *(F.min(f"r{j}").alias(f"r{j}") for j in range(len(lists))))
    return ranked(out, F.desc("score"), *(F.col(f"r{j}").asc_nulls_last() for j in range(len(lists)))).select("qid", "chunk_id", "score", "rank")


def rerank(candidates: DataFrame, relevance: DataFrame, paths: DataFrame, k: int, head: int = RERANKED, digits: int | None = None) -> DataFrame:
    """Fuses the first candidates' order with that of relevance(qid, chunk_id, relevance) times the prior; later candidates follow with score 0. Candidates
    without a relevance go."""
    first = candidates.filter(F.col("rank") < head).join(relevance, ["qid", "chunk_id"])
    first = ranked(first, F.col("rank"))
    own = F.col("relevance") * source_prior(F.coalesce("path", F.lit("")))
    by_relevance = first.join(paths.select("chunk_id", "path"), "chunk_id", "left").withColumn("own", own if digits is None else F.round(own, digits + 1))
    by_relevance = ranked(by_relevance.withColumnRenamed("rank", "came"), F.desc("own"), F.col("came"))
    fused = fuse([first, by_relevance], digits=digits)
    tail = candidates.filter(F.col("rank") >= head).select("qid", "chunk_id", F.lit(0.0).alias("score"), (F.col("rank") + head).alias("rank"))
    return ranked(fused.unionByName(tail), F.col("rank"), first=k)


def relevance(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, logits: Scorer, head: int = RERANKED) -> DataFrame:
    """qid, chunk_id and relevance in (0, 1) of the first candidates, by a scorer of (queries, passages). chunks: chunk_id and input."""
    rows = candidates.filter(F.col("rank") < head).join(chunks.select("chunk_id", "input"), "chunk_id").join(F.broadcast(queries.select("qid", "query")), "qid")

    @F.pandas_udf("double")
    def score(query: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(logits(query.tolist(), passage.tolist()), dtype="float64")

    return rows.select("qid", "chunk_id", to_unit_interval(score("query", "input")).alias("relevance"))


def overlap_logits(queries: list[str], passages: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: the share of the query's stems that the passage has."""
    from ..functions.stemming import stem_text

    out = []
    for q, p in zip(queries, passages):
        asked = set(stem_text(q).split())
        out.append(6.0 * len(asked & set(stem_text(p).split())) / len(asked) - 3.0 if asked else -3.0)
    return out


class GpuScorer:
    """A cross-encoder of sentence-transformers."""

    def __init__(self, name: str):
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(name, device="cuda", max_length=LONGEST_INPUT)

    def __call__(self, queries: list[str], passages: list[str]) -> list[float]:
        import torch

        found = self.model.predict(list(zip(queries, passages)), batch_size=SCORED_AT_ONCE, activation_fn=torch.nn.Identity(), show_progress_bar=False)
        return [float(x) for x in found]


class OnnxScorer:
    """A cross-encoder of fastembed, which scores passages of one query at a time."""

    def __init__(self, name: str):
        from fastembed.rerank.cross_encoder import TextCrossEncoder

        self.model = TextCrossEncoder(model_name=name)

    def __call__(self, queries: list[str], passages: list[str]) -> list[float]:
        of_query: dict[str, list[int]] = {}
        for i, q in enumerate(queries):
            of_query.setdefault(q, []).append(i)
        out = [0.0] * len(queries)
        for q, rows in of_query.items():
            for i, x in zip(rows, self.model.rerank(q, [passages[i] for i in rows], batch_size=SCORED_AT_ONCE)):
                out[i] = float(x)
        return out


_SCORERS: dict[str, Callable[[], Scorer]] = {"overlap": lambda: overlap_logits}
_LOADED: dict[str, Scorer] = {}


def register_scorer(name: str, factory: Callable[[], Scorer]) -> None:
    """Makes a reranker known by its id. The factory is shipped to the workers."""
    _SCORERS[name] = factory


def unload_scorers() -> None:
    _LOADED.clear()


def _scored(name: str, factory: Callable[[], Scorer], queries: list[str], passages: list[str]) -> list[float]:
    if not queries:
        return []
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name](queries, passages)


def scorer(name: str) -> Scorer:
    """The scorer of a name: a registered one, or a published cross-encoder, loaded once in each worker that needs it."""
    own, backend = parse_model(name)
    return partial(_scored, name, _SCORERS.get(own) or partial(GpuScorer if backend == "cuda" else OnnxScorer, own))
