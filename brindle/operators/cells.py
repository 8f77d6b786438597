"""

Centres are fitted to a bounded sample (some rounds of k-means); every vector goes to its nearest centre, and each cell keeps its radius, the largest distance of its vectors from the centre. A vector x of
a cell with centre c and radius r has q.x = q.c + q.(x - c) <= q.c + |q| r, so this bounds the scores of a whole cell.

A batch of queries is searched in two passes. The first takes for each query the cells with the best bounds that hold enough vectors together; the last of the best scores found is the score to reach. The
second takes the other cells whose bounds reach it. Both give exact scores, so the result is that of a search of all vectors, ties included, whatever the cells; cells that no query asks for aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .keyword import pool
from .vectors import QUERIES_AT_ONCE, matrix_of

#: Vectors that centres are fitted to for each of them, rounds of k-means, and the most cells.
SAMPLE, ROUNDS, MOST = 64, 6, 1024


@dataclass
class Cells:
    """vectors: cell, chunk_id and vector, in folders by cell. The arrays have a row for each cell that isn't empty."""

    vectors: DataFrame
    names: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def fitted(sample: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Centres of a sample's vectors."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), n, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=n)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def build(vectors: DataFrame, folder: str, n: int | None = None) -> Cells | None:
    """Writes vectors(chunk_id, vector) by cells into a folder; null vectors are left out. n: the number of cells, by default about the root of the number of vectors. None without vectors."""
    vectors = vectors.filter("vector IS NOT NULL").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    spark, total = vectors.sparkSession, vectors.count()
    if not total:
        return None
    n = min(n or round(total**0.5), MOST, total)
    cut = min(1.0, 2 * SAMPLE * n / total)
    rows = vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40)) < int(cut * (1 << 40))).limit(SAMPLE * n).select("vector").collect() or vectors.limit(1).select("vector").collect()
    if len({len(r["vector"]) for r in rows}) > 1:
        raise ValueError("the vectors differ in length")
    sample = np.array([r["vector"] for r in rows], float).reshape(len(rows), -1)
    centres = fitted(sample, min(n, len(sample)))
    held, field = spark.sparkContext.broadcast(centres), vectors.schema["chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("vector"), held.value.shape[1], batch.column("chunk_id"))
                near = nearest(x, held.value)
                away = np.sqrt(((x - held.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("chunk_id"), batch.column("vector"), pa.array(away)], ["cell", "chunk_id", "vector", "away"])

    schema = f"cell int, chunk_id {field.dataType.simpleString()}, vector array<double>, away double"
    vectors.mapInArrow(run, schema).hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    told = sorted(written.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect())
    names = np.array([r["cell"] for r in told])
    return Cells(written.select("cell", "chunk_id", "vector"), names, centres[names], np.array([r["radius"] for r in told]), np.array([r["n"] for r in told]))


def _scored(cells: Cells, ids: list, queries: np.ndarray, asks: np.ndarray, size: int, digits: int | None, kind) -> DataFrame | None:
    """qid, chunk_id and score of the best vectors in the cells that each query asks for, a few more in each task than are wanted."""
    wanted = np.nonzero(asks.any(0))[0]
    if not len(wanted):
        return None
    spark = cells.vectors.sparkSession
    held = spark.sparkContext.broadcast((queries, {int(cells.names[c]): np.nonzero(asks[:, c])[0] for c in wanted}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_cell = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("vector"), own.shape[1], batch.column("chunk_id"))
            cell, chunk = batch.column("cell").to_numpy(), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for c in np.unique(cell).tolist():
                at = np.nonzero(cell == c)[0]
                found = own[of_cell[c]] @ x[at].T
                found = found if digits is None else np.round(found, digits)
                for q, row in zip(of_cell[c], found):
                    top = np.lexsort((chunk[at], -row))[:size]
                    out.append((np.full(len(top), q), chunk[at][top], row[top]))
            number, names, scores = (np.concatenate(p) for p in zip(*out))
            for start in range(0, len(number), 10_000):
                part = slice(start, start + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(number[part]), pa.array(names[part], batch.column("chunk_id").type), pa.array(scores[part])], ["number", "chunk_id", "score"])

    part = cells.vectors.filter(F.col("cell").isin([int(x) for x in cells.names[wanted]])) if len(wanted) < len(cells.names) else cells.vectors
    found = part.mapInArrow(run, f"number long, chunk_id {part.schema['chunk_id'].dataType.simpleString()}, score double")
    names = spark.createDataFrame(pa.table({"number": pa.array(range(len(ids)), pa.int64()), "qid": pa.array(ids, to_arrow_type(kind))}))
    return found.join(F.broadcast(names), "number").select("qid", "chunk_id", "score")


def plan(cells: Cells, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that each query asks for in the first pass, and the bounds of all cells."""
    bounds = queries @ cells.centres.T + np.sqrt((queries**2).sum(1))[:, None] * cells.radii
    # For the rounding of products and norms.
    bounds += 1e-9 * (1 + np.abs(bounds))
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(cells.sizes[order], 1) - cells.sizes[order]
    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order, before < size, 1)
    return first, bounds


def search(cells: Cells | None, queries: DataFrame, size: int, digits: int | None = None, told: list | None = None) -> DataFrame:
    """qid, chunk_id, score and rank of the vectors with the largest dot products, as vectors.search() gives them. Queries without a vector find nothing. Blocks of queries are held by the driver, at most
    QUERIES_AT_ONCE at a time. told: gets the share of all products that was worked out, for each block."""
    asked, kind = queries.filter("vector IS NOT NULL").select("qid", "vector"), queries.schema["qid"].dataType
    spark, out = queries.sparkSession, None
    passes = 1 + asked.count() // QUERIES_AT_ONCE if cells else 0
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).collect()
        if not rows:
            continue
        if {len(r["vector"]) for r in rows} != {cells.centres.shape[1]}:
            raise ValueError("the vectors of the queries have another length than those of the cells")
        ids, own = [r["qid"] for r in rows], np.array([r["vector"] for r in rows], float)
        first, bounds = plan(cells, own, size)
        near = pool(_scored(cells, ids, own, first, size, digits, kind), size, digits)
        floors = {r["qid"]: r["score"] for r in near.filter(F.col("rank") == size - 1).select("qid", "score").collect()}
        floor = np.array([floors.get(q, -np.inf) for q in ids]) - (0 if digits is None else 10.0**-digits)
        asks = bounds >= floor[:, None]
        if told is not None:
            told.append(float(((asks | first) * cells.sizes).sum() / (len(ids) * cells.sizes.sum())))
        part = pool(_scored(cells, ids, own, asks | first, size, digits, kind), size, digits)
        out = part if out is None else out.unionByName(part)
    if out is None:
        chunk = cells.vectors.schema["chunk_id"].dataType.simpleString() if cells else "long"
        return spark.createDataFrame([], f"qid {kind.simpleString()}, chunk_id {chunk}, score double, rank int")
    return out
