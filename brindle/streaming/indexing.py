"""Continuous indexing: a stream of file versions, each micro-batch brought into the store incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.indexing import index_files
from ..sources.store import Store


def index_stream(files: DataFrame, store: Store, models: list[str], checkpoint: str) -> StreamingQuery:
    """Takes what is at hand of a stream of files(path, repo, suffix, sha256, size, mtime, text). Of several versions of a path in a batch the latest counts; files
    that a batch doesn't mention stay. A batch that runs again after a failure finds its files unchanged."""

    def bring_in(batch: DataFrame, _: int) -> None:
        latest = Window.partitionBy("path").orderBy(F.desc("mtime"), "sha256")
        batch = batch.withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")
        known = store.read("files").join(batch, "path", "left_anti")
        columns = {c: F.lit(None).cast(batch.schema[c].dataType) for c in batch.columns if c not in known.columns}
        index_files(store, batch.unionByName(known.withColumns(columns).select(*batch.columns)), models)

    return files.writeStream.foreachBatch(bring_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
