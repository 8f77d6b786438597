"""

A model is anything with embed(texts) -> array; models are made in the Python workers, once each. A name that isn't registered is taken as that of a published model, for which a library is
imported when a worker first needs it: sentence-transformers on a GPU for names that end in @st-cuda, fastembed otherwise. HashingModel stands in where no model files are at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stemming import WORD, stem_token
from ..functions.text import STOPWORDS, embedding_input
from .keyword import pool

GPU_SUFFIX = "@st-cuda"
# Texts that published models are given at once
GPU_BATCH, CPU_BATCHES, CPU_BATCH = 32, {"bge": 32, "e5": 16}, 16
#: Queries that are multiplied with a batch of vectors at once, and those that are broadcast for one pass over the vectors.
QUERY_BLOCK, QUERIES_AT_ONCE = 1024, 1 << 16
#: Words that the hashing model remembers.
KNOWN = 1 << 18


class Model(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingModel:
    """Stems hashed to signed dimensions: deterministic, and alike for texts with words in common."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.known: dict[str, int] = {}

    def place(self, word: str) -> int:
        """Where the word of a text counts: a dimension, beyond them those that are taken off, and after all of these that of words that don't count."""
        if word in STOPWORDS or not (stem := stem_token(word)):
            return 2 * self.dimensions
        h = crc32(stem.encode())
        return h % self.dimensions + (0 if h >> 31 else self.dimensions)

    def embed(self, texts: list[str]) -> np.ndarray:
        n, known, out = 2 * self.dimensions, self.known, np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            if len(known) > KNOWN:
                known.clear()
            found = WORD.findall(text.lower())
            for word in set(found).difference(known):
                known[word] = self.place(word)
            counts = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=n + 1)
            row[:] = counts[: self.dimensions] - counts[self.dimensions : n]
        return out


class GpuModel:
    """A model of sentence-transformers."""

    def __init__(self, name: str):
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name, device="cuda")

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, batch_size=GPU_BATCH, show_progress_bar=False), np.float32)


class OnnxModel:
    """A model of fastembed."""

    def __init__(self, name: str):
        from fastembed import TextEmbedding

        self.model, self.batch = TextEmbedding(model_name=name), next((n for part, n in CPU_BATCHES.items() if part in name.lower()), CPU_BATCH)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array(list(self.model.embed(texts, batch_size=self.batch)), np.float32)


_FACTORIES: dict[str, Callable[[], Model]] = {"hashing": HashingModel}
_LOADED: dict[str, Model] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    """Makes a model known by its id. The factory is shipped to the workers, so it must be importable or picklable there."""
    _FACTORIES[name] = factory


def parse_model(name: str) -> tuple[str, str]:
    """Model id and backend."""
    return (name.removesuffix(GPU_SUFFIX), "cuda") if name.endswith(GPU_SUFFIX) else (name, "cpu")


def factory_of(name: str) -> Callable[[], Model]:
    """What makes a model in a worker."""
    own, backend = parse_model(name)
    return _FACTORIES.get(own) or partial(GpuModel if backend == "cuda" else OnnxModel, own)


def prefix(name: str, query: bool) -> str:
    """What models of the e5 family want before a text."""
    return ("query: " if query else "passage: ") if "e5" in parse_model(name)[0].lower() else ""


def unload() -> None:
    _LOADED.clear()


def _loaded(name: str, factory: Callable[[], Model]) -> Model:
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def normalize(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def embed(df: DataFrame, name: str, text: str = "text", query: bool = False, keep: str = "chunk_id") -> DataFrame:
    """keep and the unit vector of each text."""
    factory, before = factory_of(name), prefix(name, query)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(name, factory)
        for batch in batches:
            found = unit(np.asarray(model.embed([before + t for t in batch[text]]), np.float32).reshape(len(batch), -1))
            yield pd.DataFrame({keep: batch[keep], "vector": list(found.astype(np.float32))})

    return df.select(keep, text).mapInPandas(run, f"{keep} {df.schema[keep].dataType.simpleString()}, vector array<float>")


def missing(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model."""
    return chunks.join(embeddings.filter(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def embed_chunks(chunks: DataFrame, model: str) -> DataFrame:
    """Rows of the embeddings table for chunks(chunk_id, header, text)."""
    inputs = chunks.select("chunk_id", embedding_input("header", "text").alias("text"))
    return embed(inputs, model).select("chunk_id", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector")


def matrix_of(column: pa.Array, size: int, ids: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; all must have as many numbers as the queries' vectors."""
    lengths = pc.list_value_length(column)
    if wrong := pc.index(pc.not_equal(lengths, size), True).as_py() + 1:
        raise ValueError(f"the vector of chunk {ids[wrong - 1].as_py()} has {lengths[wrong - 1].as_py()} numbers, those of the queries have {size}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def search(vectors: DataFrame, queries: DataFrame, size: int, chunks: DataFrame | None = None, repo: str | None = None, digits: int | None = None) -> DataFrame:
    """qid, chunk_id, score and rank of the chunks with the largest dot products; vectors(chunk_id, vector), queries(qid, vector). Null vectors are like nothing, and queries without a vector find
    nothing; a vector of another length than the queries' is an error. Up to QUERIES_AT_ONCE queries are broadcast and matched in one pass over the vectors; each task keeps its best rows for
    each query, so that little is shuffled."""
    if repo:
        vectors = vectors.join(chunks.filter(F.col("repo") == repo).select("chunk_id"), "chunk_id", "left_semi")
    vectors, asked = vectors.filter("vector IS NOT NULL").select("chunk_id", "vector"), queries.filter("vector IS NOT NULL").select("qid", "vector")
    spark, q_field, c_field = vectors.sparkSession, queries.schema["qid"], vectors.schema["chunk_id"]
    schema = pa.schema([("qid", to_arrow_type(q_field.dataType)), ("chunk_id", to_arrow_type(c_field.dataType)), ("score", pa.float64())])
    passes, out = 1 + asked.count() // QUERIES_AT_ONCE, None
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).collect()
        if len({len(r["vector"]) for r in rows}) > 1:
            raise ValueError("the vectors of the queries differ in length")
        held = spark.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["vector"]) if rows else 0)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            least = np.full(len(ids), -np.inf)
            for batch in batches:
                if not batch.num_rows or not ids:
                    continue
                v, chunk = matrix_of(batch.column("vector"), matrix.shape[1], batch.column("chunk_id")), batch.column("chunk_id").to_numpy(zero_copy_only=False)
                for start in range(0, len(ids), QUERY_BLOCK):
                    found = matrix[start : start + QUERY_BLOCK] @ v.T
                    if digits is not None:
                        found = np.round(found, digits)
                    # Only rows that reach a query's last place so far are looked at.
                    fits = found >= least[start : start + QUERY_BLOCK, None]
                    for j in np.nonzero(fits.any(1))[0]:
                        scores, names = np.concatenate([best[start + j][0], found[j][fits[j]]]), np.concatenate([best[start + j][1], chunk[fits[j]]])
                        top = np.lexsort((names, -scores))[:size]
                        best[start + j] = scores[top], names[top]
                        if len(top) == size:
                            least[start + j] = scores[top[-1]]
            if n := sum(len(s) for s, _ in best):
                qids = [qid for qid, (s, _) in zip(ids, best) for _ in range(len(s))]
                found = [pa.array(qids, schema.field(0).type), pa.array(np.concatenate([c for _, c in best if len(c)]), schema.field(1).type), pa.array(np.concatenate([s for s, _ in best]))]
                for start in range(0, n, 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(start, 10_000) for c in found], schema=schema)

        part = vectors.mapInArrow(run, f"qid {q_field.dataType.simpleString()}, chunk_id {c_field.dataType.simpleString()}, score double")
        out = part if out is None else out.unionByName(part)
    return pool(out, size, digits)
