"""Incremental intake of a growing folder of document files: python -m jobs.intake --config jobs/intake.json --input DIR --output DIR --checkpoint DIR

A file stream takes the files that came since the last run (its checkpoint knows which), a bounded number a batch, and ends. Of each document (repo and id) a batch takes the version that the
output doesn't have yet, cuts it into chunks, takes secrets out, and writes three tables, each by batch:

    files     batch, path, repo, suffix, sha256, text   the versions taken
    chunks    batch, repo, path, symbol, kind, start_line, end_line, text, redactions
    secrets   batch, kind, hits                         what was taken out of the batch's chunks

A document that comes again with the same text makes no rows; one with another text makes new ones, and current() gives the chunks of each document's last version.

A batch replaces just its own partitions, and what it takes as known are batches before it. So a batch that failed halfway, and runs again under its number, leaves what one run leaves; a run
without new files changes nothing. Output and checkpoint belong together: with a new checkpoint a new output folder is needed, and one run at a time writes to an output.

Defined results: a null text counts as empty, and an empty one makes a file without chunks; a row without an id goes by the hash of its text; a null repo is the empty one; of several versions of
a document in one batch that with the largest hash is taken; further columns don't matter.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.functions.redaction import with_redaction
from brindle.operators.chunking import chunk_files

from .common import load, session

log = logging.getLogger("jobs.intake")

DEFAULTS = {"id": "doc_id", "repo": "source", "text": "text", "suffix": ".txt", "files_per_batch": 1000}
SCHEMAS = {
    "files": "path string, suffix string, sha256 string, text string, batch long, repo string",
    "chunks": "path string, symbol string, kind string, start_line int, end_line int, text string, redactions map<string,int>, batch long, repo string",
    "secrets": "kind string, hits long, batch long",
}
PARTITIONS = {"files": ["batch", "repo"], "chunks": ["batch", "repo"], "secrets": ["batch"]}


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table of the output."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}")


def prepare(spark: SparkSession, output: str) -> None:
    """Makes the tables that aren't there yet, without rows."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITIONS[name]).parquet(f"{output}/{name}")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the last version of each document."""
    last = read(spark, output, "files").groupBy("path").agg(F.max("batch").alias("batch"))
    return read(spark, output, "chunks").join(last, ["path", "batch"], "left_semi")


def versions(rows: DataFrame, config: dict) -> DataFrame:
    """path, repo, suffix, sha256 and text of the rows of a batch, one for each path."""
    text = F.coalesce(F.col(config["text"]).cast("string"), F.lit(""))
    rows = rows.select(F.coalesce(F.col(config["repo"]).cast("string"), F.lit("")).alias("repo"), F.col(config["id"]).cast("string").alias("id"), text.alias("text"))
    rows = rows.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("path", F.concat("repo", F.lit("/"), F.coalesce("id", "sha256"), F.lit(config["suffix"])))
    # Repeats are dropped where they are read, so a path that many rows have sends few of them on.
    once = rows.groupBy("path").agg(F.max_by(F.struct("repo", "text", "sha256"), "sha256").alias("v"))
    return once.select("path", "v.repo", F.lit(config["suffix"]).alias("suffix"), "v.sha256", "v.text")


def write(df: DataFrame, output: str, name: str) -> None:
    """Replaces the partitions of the batch's number. Rows are brought together by repository first, a large one in several parts, so that a partition gets few files."""
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    df = df.select(*columns)
    if "repo" in columns:
        df = df.hint("rebalance", F.col("repo"))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{output}/{name}")


def take(rows: DataFrame, batch: int, output: str, config: dict) -> dict:
    """Brings one batch into the output; the counts of what it wrote."""
    spark, number = rows.sparkSession, F.lit(batch).cast("long").alias("batch")
    known = read(spark, output, "files").filter(F.col("batch") < batch).groupBy("path").agg(F.max_by("sha256", "batch").alias("known"))
    fresh = versions(rows, config).join(known, "path", "left").filter(F.col("known").isNull() | (F.col("known") != F.col("sha256")))
    write(fresh.select("*", number), output, "files")
    # What follows reads what was written: texts are taken from the input and shuffled once.
    taken = read(spark, output, "files").filter(F.col("batch") == batch)
    made = with_redaction(chunk_files(taken.select("path", "repo", "suffix", "text")))
    write(made.select("*", number), output, "chunks")
    chunks = read(spark, output, "chunks").filter(F.col("batch") == batch)
    hits = chunks.select(F.explode("redactions").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("hits"))
    write(hits.select("*", number), output, "secrets")
    counts = {"batch": batch, "documents": taken.count(), "chunks": chunks.count(), "secrets": {r["kind"]: r["hits"] for r in read(spark, output, "secrets").filter(F.col("batch") == batch).orderBy("kind").collect()}}
    log.info("batch %d: took %d documents, wrote %d chunks, took out %s", batch, counts["documents"], counts["chunks"], counts["secrets"] or "nothing")
    return counts


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None, schema: StructType | str | None = None) -> list[dict]:
    """Takes what is new in the input, a folder of Parquet files or a pattern; the counts of each batch. The schema is that of the files at hand where none is given."""
    config = DEFAULTS | (config or {})
    prepare(spark, output)
    schema = schema or spark.read.parquet(input).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(input)
    done: list[dict] = []
    stream = (
        files.writeStream.foreachBatch(lambda rows, batch: done.append(take(rows, batch, output, config)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    seen = sum(p["numInputRows"] for p in stream.recentProgress)
    log.info("%s: read %d rows in %d batches from %s", output, seen, len(done), input)
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description="Takes what is new in a folder of documents")
    for name in ("config", "input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    said = parser.parse_args()
    with session("intake") as spark:
        run(spark, said.input, said.output, said.checkpoint, load(spark, said.config, DEFAULTS))


if __name__ == "__main__":
    main()
