"""The test tables in the shapes that the engine reads: documents as files and chunks, benchmark items as queries and questions."""

from __future__ import annotations

import tempfile
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header
from ..operators import vectors
from ..sources.store import Store
from .indexing import put_keywords


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(number: Column) -> Column:
    """source/tests/test_N.py, source/src/N.py or source/docs/N.py in turn, so that the prior and the cap have something to do."""
    third = F.pmod(number, F.lit(3))
    return F.concat("source", F.when(third == 0, "/tests/test_").when(third == 1, "/src/").otherwise("/docs/"), number.cast("string"), F.lit(".py"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, repo, suffix and text of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", path_of(F.col("doc_id")).alias("path"), F.col("source").alias("repo"), F.lit(".txt").alias("suffix"), F.coalesce("text", F.lit("")).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk whose id is the document's; four documents share a path, so that the cap has something to do."""
    docs = table(spark, sf_dir, "documents")
    path = path_of(F.floor(F.col("doc_id") / 4))
    return docs.select(F.col("doc_id").alias("chunk_id"), path.alias("path"), F.col("source").alias("repo"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("symbol"), F.lit("window").alias("kind"), F.lit(1).alias("start_line"), F.lit(60).alias("end_line"), F.coalesce("text", F.lit("")).alias("text"))


#: The same in SQL.
PATH_SQL = "source || CASE {n} % 3 WHEN 0 THEN '/tests/test_' WHEN 1 THEN '/src/' ELSE '/docs/' END || {n} || '.py'"
FILES_SQL = f"files AS (SELECT doc_id, {PATH_SQL.format(n='doc_id')} AS path, source AS repo, coalesce(text, '') AS text FROM documents)"
CHUNKS_SQL = f"chunks AS (SELECT doc_id AS chunk_id, {PATH_SQL.format(n='(doc_id // 4)')} AS path, source AS repo, 'doc' || doc_id AS symbol, 'window' AS kind, coalesce(text, '') AS text FROM documents)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


QUERIES_SQL = "queries AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where Spark runs on this machine alone."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    said = tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", said)
    return said


def stored(spark: SparkSession, sf_dir: str, stem: bool) -> Store:
    """An index of the documents as chunks: built by the first query that needs it, read by the others, as long as the files are the same; it goes when the driver
    ends. Vectors are those of the embeddings table where words aren't stemmed, and of the hashing model where they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files_ = path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    seen = [(name, s.getLen(), s.getModificationTime()) for name in ("documents", "embeddings") for s in files_.globStatus(path(f"{sf_dir}/{name}.parquet"))]
    root = f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}-{crc32(repr((sf_dir, seen, stem)).encode()):08x}"
    store = Store(spark, root)
    if not store.state()["version"]:
        build(spark, sf_dir, store, stem)
        shared = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        shared.deleteOnExit(path(root))
    return store


def build(spark: SparkSession, sf_dir: str, store: Store, stem: bool) -> None:
    now = store.snapshot()
    segment = store.segment(now.state)
    own = segment.put("chunks", chunks(spark, sf_dir).withColumn("header", header("path", "symbol", "kind")))
    totals = put_keywords(segment, now, own, stem=stem)
    if stem:
        rows = vectors.embed_chunks(own, "hashing")
    else:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<float>").alias("vector"), F.lit("given").alias("model"))
    segment.put("embeddings", rows)
    store.publish(segment, totals)
