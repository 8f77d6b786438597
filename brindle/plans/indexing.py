"""
files and all that is derived from them, the ids of chunks that went, and signed changes of the term statistics, so what it writes follows what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.redaction import counts_by_kind, with_redaction
from ..functions.text import header
from ..operators import keyword, vectors
from ..operators.chunking import chunk_files
from ..sources.files import Repo, read_files, skip_summary, walk
from ..sources.store import Segment, Snapshot, Store


def file_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, deleted, unreadable) of known and found files(path, sha256). A found file without a hash couldn't be read; what is
    known of it stays."""
    both = known.select("path", F.col("sha256").alias("before")).join(found.select("path", F.col("sha256").alias("now"), F.lit(True).alias("here")), "path", "full_outer")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("now").isNull(), "unreadable").when(F.col("before").isNull(), "new").when(F.col("before") == F.col("now"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def new_chunks(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Chunks of files, redacted, in the order of path and lines; and redactions by kind. They are written to a folder first: ranges are found by reading all rows once more, and so files aren't cut twice."""
    with_redaction(chunk_files(files)).write.parquet(folder)
    made = spark.read.parquet(folder)
    # Ids are handed out in ranges: a partition's rows are numbered within, after those of the partitions before.
    made = made.repartitionByRange("path", "start_line", "end_line", "symbol").sortWithinPartitions("path", "start_line", "end_line", "symbol", "text").withColumn("order", F.monotonically_increasing_id())
    return made.withColumn("header", header("path", "symbol", "kind"))


def numbered(made: DataFrame, watermark: int) -> DataFrame:
    part = F.shiftright("order", 33)
    counts = made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("order").bitwiseAND(F.lit((1 << 33) - 1))
    return made.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("chunk_id", F.lit(watermark) + 1 + F.col("start") + within).drop("part", "start", "order")


def put_keywords(segment: Segment, now: Snapshot, chunks: DataFrame, gone: tuple[int, int] = (0, 0), stem: bool = True) -> tuple[int, int]:
    """Writes the keyword tables of a segment's chunks; the totals of the store with them and without what is gone. Texts are read once, for the lists; what follows is made from these."""
    lists, totals = segment.put("lists", keyword.listed(chunks, stem)), now.state["totals"]
    own = keyword.totals(segment.put("lengths", keyword.lengths(chunks, lists)))
    after = totals[0] + own[0] - gone[0], totals[1] + own[1] - gone[1]
    segment.put("dictionary", keyword.dictionary(lists, after))
    return after


def index_files(store: Store, found: DataFrame, models: list[str], read_again: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Brings the store up to found files(path, repo, suffix, sha256, size, mtime, text); files that are known but not found go. Returns the report.
    read_again gives the rows of some paths without reading the others; only hashes are kept of the first reading."""
    now = store.snapshot()
    diff = file_diff(now.known_files(), found).cache()
    counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = {"indexed": counts.get("new", 0) + counts.get("changed", 0), "unchanged": counts.get("unchanged", 0), "deleted": counts.get("deleted", 0), "chunks_added": 0, "redactions": {}, "embedded": {}}
    if report["indexed"] or report["deleted"]:
        folder, segment = store.staged(), store.segment(now.state)
        try:
            _add(store, now, segment, diff, found, models, read_again, folder, report)
        except BaseException:
            segment.drop()
            raise
        finally:
            store.remove(folder)
    for model in models:
        # Chunks from before that lack a vector: of a model that is new, or after a run that failed.
        now = store.snapshot()
        lacking = vectors.missing(now.read("chunks"), now.read("embeddings"), model)
        more = lacking.count()
        report["embedded"][model] = report["embedded"].get(model, 0) + more
        if more:
            segment = store.segment(now.state)
            segment.put("embeddings", vectors.embed_chunks(lacking, model))
            store.publish(segment)
    store.fold()
    report["chunks_total"] = store.read("chunks").count()
    diff.unpersist()
    return report


def _add(store: Store, now: Snapshot, segment: Segment, diff: DataFrame, found: DataFrame, models: list[str], read_again: Callable[[DataFrame], DataFrame] | None, folder: str, report: dict) -> None:
    """Writes and publishes the segment of a run: what is new and changed comes, what is changed and deleted goes."""
    spark, totals, gone = store.spark, tuple(now.state["totals"]), (0, 0)
    fresh, leaving = diff.filter("status IN ('new', 'changed')").select("path"), diff.filter("status IN ('changed', 'deleted')").select("path")
    before = now.read("chunks").join(leaving, "path", "left_semi")
    ids = segment.put("dead", before.select("chunk_id"))
    if not ids.isEmpty():
        gone = keyword.totals(now.read("lengths").join(ids, "chunk_id", "left_semi"))
        segment.put("dictionary", keyword.taken_out(now.terms().join(now.few(ids, ids.count()), "chunk_id", "left_semi")))
    # Chunks and hashes come from the same reading. Chunks are numbered by the partition they are read from, so they are written before.
    (read_again(fresh) if read_again else found.join(fresh, "path", "left_semi")).filter("sha256 IS NOT NULL").write.parquet(f"{folder}/files")
    rows = spark.read.parquet(f"{folder}/files")
    new_chunks(spark, rows, f"{folder}/made").write.parquet(f"{folder}/chunks")
    store.remove(f"{folder}/made")
    made = spark.read.parquet(f"{folder}/chunks")
    report["chunks_added"] = made.count()
    report["redactions"] = {r["kind"]: r["hits"] for r in counts_by_kind(made).collect()}
    if report["chunks_added"]:
        chunks = segment.put("chunks", numbered(made, now.state["watermark"]))
        store.remove(f"{folder}/chunks")
        totals = put_keywords(segment, now, chunks, gone)
        for model in models:
            report["embedded"][model] = report["chunks_added"]
            segment.put("embeddings", vectors.embed_chunks(chunks, model))
    else:
        totals = totals[0] - gone[0], totals[1] - gone[1]
    left = diff.filter("status = 'deleted'").select("path", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"), F.lit(True).alias("gone"))
    segment.put("files", rows.select("path", "sha256", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), F.lit(False).alias("gone")).unionByName(left))
    # New chunks and their vectors come in one version, so that no reader finds the ones without the others.
    store.publish(segment, totals, now.state["watermark"] + report["chunks_added"])


def index_corpus(spark: SparkSession, repos: list[Repo], root: str, models: list[str] = ("hashing",)) -> dict:
    """Walks, chunks, redacts, stores and embeds the repositories. The report tells besides what was left out, and why."""
    listing = walk(spark, repos)
    some = lambda paths: read_files(listing.withColumn("path", F.concat_ws("/", "repo", "rel")).join(paths, "path", "left_semi"))
    report = index_files(Store(spark, root), read_files(listing), list(models), some)
    return report | {"skipped": [r.asDict() for r in skip_summary(listing).collect()]}
