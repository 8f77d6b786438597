"""Operator 11: hard negatives by inner products, searched in the order of an orthogonal PCA rotation.

Components are made whole numbers first, so scores are whole numbers. Vectors are turned by the eigenvectors of the sample's second moments, largest first, which keeps inner
products. A pair's product is added up over the leading components; what is missing is at most the product of the two residual norms, plus a slack for the rounding of all steps. A pair goes as
soon as it can't reach what is wanted, at a few marks where the residual's share of the sample's energy has fallen to SHARES. Those that are left at the end are multiplied as whole numbers, and
only these products decide.

Anchors are taken in blocks of BLOCK bytes, which are broadcast, in two passes over all rows: first the positives, then, for each anchor and positive, the band of scores below the
positive's. Each task keeps the best so far for each anchor (and positive), and with them the limits that new pairs must reach. Limits start from the best of the sample: a part of the rows never has a
better best, so this only spares work. So what tasks hand on, and what is shuffled, is a few rows for each anchor, however many the tasks.

The sample is of SAMPLE rows at most, those with small hashes. It sets the rotation, the marks and the first limits; results don't depend on it. No label, however frequent, is gathered
anywhere: rows are read where they are.

Defined results: rows with a null id, label, vector or component, or one that isn't finite, take no part, nor do those whose squared length is 2**62 or more, as a product might not fit a long. Vectors
of unlike lengths have no score. Other rows are those with another id; rows that repeat an id each take part, also as anchors, but equal anchors count once. Ties go to the smaller id. An empty table gives no
rows; columns besides vec_id, embedding and label don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, small_batches, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Bytes of a block of anchors, rows of the sample, pairs that are looked at and multiplied at once.
BLOCK, SAMPLE, TILE, EXACT = 16 << 20, 4096, 1 << 20, 1 << 14
#: The residual's shares of the sample's energy at which pairs are dropped.
SHARES = (0.5, 0.2, 0.05)
LARGEST = 1 << 62


def whole(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and y, the components as whole numbers, of the rows that take part."""
    rows = pick(rows, "vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    y = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), y.alias("y"))
    return rows.filter(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x) < float(LARGEST))


@dataclass
class Rotation:
    """turn: an orthogonal matrix, leading directions first. marks: numbers of components after which pairs are dropped. slack: for the rounding, as a share of the product of
    two lengths."""

    turn: np.ndarray
    marks: list[int]
    slack: float


def rotation(sample: np.ndarray) -> Rotation:
    size = sample.shape[1]
    power, turn = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
    power, turn = np.maximum(power[::-1], 0), turn[:, ::-1]
    left = 1 - np.cumsum(power) / max(power.sum(), 1e-300)
    marks = sorted({int(np.argmax(left <= share)) + 1 for share in SHARES if size} | {size})
    skew = float(np.linalg.norm(turn.T @ turn - np.eye(size)))
    return Rotation(np.ascontiguousarray(turn), marks, 2 * skew + 32 * (size + 1) ** 1.5 * np.finfo(float).eps)


@dataclass
class Task:
    """What is looked for: for each anchor some slots, each with the limits of its scores, of which the best are kept."""

    ids: np.ndarray
    labels: np.ndarray
    y: np.ndarray
    low: np.ndarray  # anchors x slots
    high: np.ndarray
    same: bool  # rows of the same label, or of others
    best: int
    rotation: Rotation


def lengths(turned: np.ndarray, marks: list[int]) -> list[np.ndarray]:
    """The residual norms after each mark."""
    return [np.sqrt((turned[:, m:] ** 2).sum(1)) for m in marks]


class Scan:
    """One task's pass over rows."""

    def __init__(self, task: Task):
        self.task, self.low = task, task.low.copy()
        self.turned = task.y @ task.rotation.turn
        self.rest, self.norm = lengths(self.turned, task.rotation.marks), np.sqrt((task.y**2).sum(1))
        self.whole = task.y.astype(np.int64)
        slots = self.low.size
        self.scores, self.names = np.full((slots, task.best), -LARGEST - 1), np.zeros((slots, task.best), np.int64)
        order = np.argsort(task.labels, kind="stable")
        kinds, start = np.unique(task.labels[order], return_index=True)
        self.of_label = dict(zip(kinds.tolist(), np.split(order, start[1:])))

    def take(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        turned = y @ self.task.rotation.turn
        rows = turned, lengths(turned, self.task.rotation.marks), np.sqrt((y**2).sum(1)), y.astype(np.int64)
        if self.task.same:
            for label in np.unique(labels).tolist():
                if label in self.of_label:
                    self._tiles(self.of_label[label], np.nonzero(labels == label)[0], ids, labels, rows)
        else:
            self._tiles(np.arange(len(self.task.ids)), np.arange(len(ids)), ids, labels, rows)

    def _tiles(self, anchors: np.ndarray, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: tuple) -> None:
        step = max(1, TILE // max(1, len(at)))
        for start in range(0, len(anchors), step):
            some = anchors[start : start + step]
            a, r = self._left(some, at, rows)
            fits = ids[r] != self.task.ids[a] if self.task.same else labels[r] != self.task.labels[a]
            a, r = a[fits], r[fits]
            for k in range(0, len(a), EXACT):
                ak, rk = a[k : k + EXACT], r[k : k + EXACT]
                self._offer(ak, ids[rk], np.einsum("ij,ij->i", self.whole[ak], rows[3][rk]))

    def _left(self, a: np.ndarray, r: np.ndarray, rows: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and rows of the pairs that may be within the limits."""
        turned, rest, norm, _ = rows
        least, most = self.low[a].min(1).astype(float), self.task.high[a].max(1).astype(float)
        part, before, pairs = np.zeros((len(a), len(r))), 0, None
        for k, mark in enumerate(self.task.rotation.marks):
            if pairs is None:
                part += self.turned[a, before:mark] @ turned[r, before:mark].T
                room = self.rest[k][a][:, None] * rest[k][r] + (self.task.rotation.slack * self.norm[a])[:, None] * norm[r]
                fits = (part + room >= least[:, None]) & (part - room <= most[:, None])
                if mark == turned.shape[1] or np.count_nonzero(fits) * 16 < fits.size:
                    i, j = np.nonzero(fits)
                    pairs, part = (a[i], r[j], least[i], most[i]), part[i, j]
            else:
                # Few pairs are left: they are added up one by one.
                pa_, pr, low, high = pairs
                part = part + np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.turned[pa_[s : s + EXACT], before:mark], turned[pr[s : s + EXACT], before:mark]) for s in range(0, len(pa_), EXACT))])
                room = self.rest[k][pa_] * rest[k][pr] + self.task.rotation.slack * self.norm[pa_] * norm[pr]
                fits = (part + room >= low) & (part - room <= high)
                pairs, part = tuple(x[fits] for x in pairs), part[fits]
            before = mark
        return pairs[0], pairs[1]

    def _offer(self, anchors: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Takes scores into the best of their anchors' slots and raises the limits."""
        slots, best = self.low.shape[1], self.task.best
        i, s = np.nonzero((scores[:, None] >= self.low[anchors]) & (scores[:, None] <= self.task.high[anchors]))
        if not len(i):
            return
        key = anchors[i] * slots + s
        touched = np.unique(key)
        had = self.scores[touched].ravel() >= -LARGEST
        keys = np.concatenate([key, np.repeat(touched, best)[had]])
        scores, names = np.concatenate([scores[i], self.scores[touched].ravel()[had]]), np.concatenate([names[i], self.names[touched].ravel()[had]])
        order = np.lexsort((names, -scores, keys))
        keys, scores, names = keys[order], scores[order], names[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        kept = place < best
        self.scores[keys[kept], place[kept]], self.names[keys[kept], place[kept]] = scores[kept], names[kept]
        limits = self.low.reshape(-1)
        limits[touched] = np.maximum(limits[touched], self.scores[touched, best - 1])

    def found(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.scores >= -LARGEST)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(self.names[slot, place]), pa.array(self.scores[slot, place])], ["slot", "id", "score"])


def best(rows: DataFrame, task: Task) -> DataFrame:
    """slot, id, score and rank (from 1) of the best rows for each slot (an anchor's number times the number of slots, plus the slot's)."""
    held = rows.sparkSession.sparkContext.broadcast(task)
    size = task.y.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            fits = np.nonzero(batch.column("y").value_lengths().to_numpy(zero_copy_only=False) == size)[0]
            if len(fits):
                scan = scan or Scan(held.value)
                batch = batch.take(pa.array(fits))
                y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(fits), size)
                scan.take(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), y)
        if scan:
            out = scan.found()
            for start in range(0, out.num_rows, 10_000):
                yield out.slice(start, 10_000)

    found = small_batches(rows).mapInArrow(run, "slot long, id long, score long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= task.best)


def _seeded(sample: DataFrame, task: Task) -> Task:
    """The task with limits that the sample's rows reach."""
    found = best(sample, task).filter(F.col("rank") == task.best).select("slot", "score").toPandas()
    limits = task.low.reshape(-1)
    slot = found["slot"].to_numpy(np.int64)
    limits[slot] = np.maximum(limits[slot], found["score"].to_numpy(np.int64))
    return task


def _share(x: np.ndarray, percent: int) -> np.ndarray:
    """floor(x * percent / 100) without overflow."""
    return x // 100 * percent + x % 100 * percent // 100


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. vectors(vec_id, embedding, label); anchors: which rows are anchors, by vec_id. An anchor's positives are its best
    rows of the same label, and a positive's negatives the best of other labels whose scores are from low to high percent of the positive's."""
    spark = vectors.sparkSession
    scratch, rows = Scratch(spark), whole(vectors, scale)
    total, span = rows.count(), 1 << 40
    cut = min(span, span * (2 * SAMPLE + 100) // max(1, total))
    sample = scratch.keep(rows.filter(F.pmod(F.xxhash64("vec_id", "y"), F.lit(span)) < cut).limit(SAMPLE), "sample")
    asked = scratch.keep(rows.filter(anchors).distinct().withColumn("size", F.size("y")), "anchors")
    paths = []
    for size, n in asked.groupBy("size").count().orderBy("size").collect():
        seen = [r["y"] for r in sample.filter(F.size("y") == size).select("y").collect()]
        turned = rotation(np.array(seen, float).reshape(len(seen), size))
        blocks = -(-n * 8 * max(1, size) // BLOCK)
        for number in range(blocks):
            part = asked.filter((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id", "label", "y"), F.lit(blocks)) == number)).select("vec_id", "label", "y")
            paths.append(_block(rows, sample, part, turned, scratch, f"block-{len(paths)}", positives, negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scratch.only(*paths)
    return spark.read.schema(schema).parquet(*(f"{scratch.root}/{p}" for p in paths)) if paths else spark.createDataFrame([], schema)


def _block(rows: DataFrame, sample: DataFrame, part: DataFrame, turned: Rotation, scratch: Scratch, name: str, positives: int, negatives: int, low: int, high: int) -> str:
    """Writes the result of one block of anchors."""
    spark, held = rows.sparkSession, part.toArrow()
    n, size = held.num_rows, len(turned.turn)
    ids, labels = (held.column(c).to_numpy() for c in ("vec_id", "label"))
    y = held.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, size)
    open_ = np.full((n, 1), -LARGEST), np.full((n, 1), LARGEST)
    first = best(rows, _seeded(sample, Task(ids, labels, y, *open_, True, positives, turned))).toPandas()
    # A slot without a positive has limits that nothing meets.
    names, scores = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    least, most = np.full((n, positives), LARGEST), np.full((n, positives), -LARGEST)
    at = first["slot"].to_numpy(np.int64), first["rank"].to_numpy(np.int64) - 1
    names[at], scores[at] = first["id"].to_numpy(np.int64), first["score"].to_numpy(np.int64)
    least[at], most[at] = -_share(-scores[at], low), _share(scores[at], high)
    second = best(rows, _seeded(sample, Task(ids, labels, y, least, most, False, negatives, turned)))
    told = pd.DataFrame({"slot": at[0] * positives + at[1], "anchor_id": ids[at[0]], "positive_id": names[at], "positive_score": scores[at]}).astype("int64")
    told = spark.createDataFrame(pa.Table.from_pandas(told, preserve_index=False))
    out = second.join(F.broadcast(told), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    scratch.keep(out, name)
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows with ids divisible by 50; rows with ids divisible by 7 take the next label of ten."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.y, r.y)::BIGINT AS score
    FROM v a JOIN v r ON len(a.y) = len(r.y) WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 3
"""
