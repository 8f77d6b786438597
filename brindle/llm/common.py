"""What the operators of this subpackage share: column picking, hold-out folds, shared storage, Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and text bytes that an Arrow loop hands on at a time, so that its outputs stay small however long the texts are.
STEP_ROWS, STEP_BYTES = 2048, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact case; columns that differ in case or repeat a name don't disturb it."""
    names = tuple(dict.fromkeys(names))
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def kept(docs: DataFrame, judge: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """The rows that judge lets pass, with all their columns. judge gets the documents under names that can't clash with its own, but for `text`, and the
    names that it has to keep."""
    flat = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    return judge(flat, tuple(flat.columns)).select(*flat.columns).toDF(*docs.columns)


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; null for null ids."""
    return F.crc32(F.col(column).cast("string")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine is used only where Spark runs on this machine alone."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    said = tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", said)
    return said


class Scratch:
    """Tables written in the shared folder to cut lineage: lost executors cost no more than the stage at hand. What isn't dropped before, as a result may still be
    read from it, goes when the driver ends."""

    live: list["Scratch"] = []

    def __init__(self, spark: SparkSession):
        self.names: set[str] = set()
        Scratch.live.append(self)
        self.spark, self.root = spark, f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def only(self, *names: str) -> None:
        """Drops all tables but those that a result is read from."""
        for name in self.names.difference(names):
            self.drop(name)


@contextmanager
def passing() -> Iterator[None]:
    """Around work whose result is written elsewhere: the scratch tables made within are dropped at its end."""
    before = len(Scratch.live)
    try:
        yield
    finally:
        for scratch in Scratch.live[before:]:
            scratch.drop()
        del Scratch.live[before:]


#: Bytes of text that learn at most: they come to the driver.
SAMPLE_BYTES = 64 << 20


def bounded_sample(rows: DataFrame, per_class: int, classes: int, size: int = SAMPLE_BYTES) -> tuple[list[str], list]:
    """Texts and classes of a bounded part of rows(doc_id, y, text): of the most frequent classes, so many texts each at most, those with the least hashes of id and text, and no
    more than so many bytes in all. A text that an id repeats counts once. The hashes are cut off by the class's number of texts first, so that no class, however
    frequent, is sorted whole, and nothing but the sample's texts comes to the driver."""
    span = 1 << 40
    rows = rows.filter("doc_id IS NOT NULL AND y IS NOT NULL AND text IS NOT NULL").withColumn("mark", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("y").agg(F.approx_count_distinct("mark").alias("n")).orderBy(F.desc("n"), "y").limit(classes).collect()
    if not counts:
        return [], []
    kind = rows.schema["y"].dataType.simpleString()
    cuts = rows.sparkSession.createDataFrame([(r["y"], min(span, span * (2 * per_class + 100) // max(1, r["n"]))) for r in counts], f"y {kind}, cut long")
    few = rows.join(F.broadcast(cuts), "y").filter(F.pmod("mark", F.lit(span)) < F.col("cut"))
    each = few.groupBy("y", F.pmod("mark", F.lit(span)).alias("place"), "mark").agg(F.max(F.octet_length("text")).alias("n"))
    order = Window.partitionBy("y").orderBy("place", "mark")
    each = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_class).orderBy("at", "y").collect()
    chosen, held = [], 0
    for r in each:
        if held + r["n"] <= size:
            chosen.append((r["y"], r["mark"]))
            held += r["n"]
    if not chosen:
        return [], []
    picked = rows.sparkSession.createDataFrame(chosen, f"y {kind}, mark long")
    found = rows.join(F.broadcast(picked), ["y", "mark"]).groupBy("y", "mark").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["mark"], r["y"]))
    return [r["text"] for r in found], [r["y"] for r in found]


#: A key that at least one row in so many has is hot, so there are so many hot keys at most.
HOT = 1024


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """left joined to right, which has a key once at most (inner or left join). Rows of hot keys are looked up in a broadcast table of at most `hot` rows, so that none of them is
    dealt by its key; the others are joined as usual. left is read three times, so it is a written table or cheap."""
    total = left.count()
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") * hot >= total).select(key)
    found = right.join(counts, key, "left_semi").select(*right.columns).collect()
    if not found:
        return left.join(right, key, how)
    few = F.broadcast(left.sparkSession.createDataFrame(found, right.schema))
    names = [c for c in left.columns + right.columns if c != key]
    some = left.join(few, key).select(key, *names)
    return some.unionByName(left.join(few.select(key), key, "left_anti").join(right, key, how).select(key, *names))


def small_batches(df: DataFrame) -> DataFrame:
    """Lets Spark hand Python batches of some megabytes rather than its 64 MB, as each core holds several at once. A smaller setting stays."""
    key, bound = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    said = df.sparkSession.conf.get(key).rstrip("b")
    if not said.isdigit() or int(said) > bound:
        df.sparkSession.conf.set(key, str(bound))
    return df


_STATE: dict = {}


def worker_state(key, make: Callable):
    """What a Python worker keeps between batches: one model or memo at a time, as workers are used again by other operators."""
    if key not in _STATE:
        _STATE.clear()
        give_back()
        _STATE[key] = make()
    return _STATE[key]


def give_back() -> None:
    """Returns memory that is free to the system, as workers live on, and the C library keeps what it has had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batch: pa.RecordBatch, column: str, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many rows and, but for single long texts, so many bytes of a column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


def each_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that applies work to one slice after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, size=size):
                yield work(part)

    return run
