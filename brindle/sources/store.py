"""

A run writes the rows it adds as a segment of their own, and the ids of chunks that go as its dead ids; what was there before stays as it is, so what is written follows the change. Reading a table unites its
segments and leaves out dead chunks. Of the file rows, the last one of each path counts. fold() writes the newest segments anew as one, as long as the next older one isn't much larger, so there are few
segments however many runs, and a row is written a logarithmic number of times; where a quarter of the chunks are dead, everything is.

A version is a file VERSION-n with the whole state; it gets its name by a rename that fails where another run has made that version. The highest is the current one, so a run that dies leaves folders that
nobody reads, and nothing else. A snapshot is one version: whoever reads through it sees no other, whatever is committed meanwhile. vacuum() keeps what versions of the last while need.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyword

SCHEMAS = {
    "files": "path string, sha256 string, size long, mtime double",
    "chunks": "chunk_id long, path string, symbol string, kind string, start_line int, end_line int, text string, header string, repo string",
    "postings": keyword.POSTINGS,  # of stores made before; since, lists hold them
    "lengths": "chunk_id long, length int",
    "lists": keyword.LISTS,
    "dictionary": "term string, field string, df long, best double, mean double",
    "stems": "word string, stem string, terms array<string>",  # of stores made before; not written any more
    "embeddings": "chunk_id long, dim int, vector array<float>, model string",
    "dead": "chunk_id long",
}
#: What the folders of files hold besides: the version that wrote a row, and whether the file is gone since.
LOG = SCHEMAS["files"] + ", version long, gone boolean"
PARTITIONS = {"chunks": ["repo"], "embeddings": ["model"]}
BY_CHUNK = ("chunks", "postings", "lengths", "embeddings")
EMPTY = {"version": 0, "watermark": 0, "totals": [0, 0], "segments": []}
#: A segment is folded with newer ones that have this part of its rows together; the dead part of the chunks that has everything written anew.
FOLD, DEAD = 0.5, 0.25
#: Ids that are broadcast to be joined, and that tasks hold as an array. Segments of fewer chunks have their lists brought together by ranges when they are folded.
JOINED, HELD, SMALL = 1 << 20, 1 << 23, 16 * keyword.RANGE


class ConcurrentCommit(RuntimeError):
    """Another run has changed the index since this one read it."""


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class Snapshot:
    """One version of the store. state: version, watermark (the highest chunk id ever given), totals (chunks, and terms in them), and the segments, oldest first."""

    def __init__(self, store: "Store", state: dict):
        self.store, self.spark, self.state = store, store.spark, state

    def read(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        """A table; of some segments only, if they are given."""
        own = self.state["segments"] if segments is None else segments
        if name == "postings":
            lists = [f for s in own if "postings" not in s["tables"] for f in s["tables"].get("lists", [])]
            parts = [self._load(lists, "lists").transform(keyword.postings_of)] if lists else []
            if stored := [f for s in own for f in s["tables"].get("postings", [])]:
                parts.append(self._load(stored, "postings"))
            rows = reduce(DataFrame.unionByName, parts or [self.spark.createDataFrame([], SCHEMAS[name])])
            return rows.join(self.few(self.read("dead"), self.dead), "chunk_id", "left_anti") if self.dead else rows
        folders = [f for s in own for f in s["tables"].get(name, [])]
        schema = LOG if name == "files" else SCHEMAS[name]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        load = self.spark.read.schema(schema).parquet
        # Folders with partitions of their own are read one by one; there are few.
        rows = reduce(DataFrame.unionByName, [load(f"{self.store.root}/{f}") for f in folders]) if name in PARTITIONS else load(*(f"{self.store.root}/{f}" for f in folders))
        if name == "files":
            last = rows.groupBy("path").agg(F.max_by(F.struct("sha256", "size", "mtime", "gone"), "version").alias("r")).filter("NOT r.gone")
            return last.select("path", "r.sha256", "r.size", "r.mtime")
        if name in BY_CHUNK and self.dead:
            rows = rows.join(self.few(self.read("dead"), self.dead), "chunk_id", "left_anti")
        return rows

    def _load(self, folders: list[str], name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.store.root}/{f}" for f in folders))

    @staticmethod
    def few(ids: DataFrame, count: int) -> DataFrame:
        """Ids, broadcast unless they are many, so that tables aren't shuffled to them."""
        return F.broadcast(ids) if count <= JOINED else ids

    def terms(self) -> DataFrame:
        """term, field and chunk_id of all lists, dead chunks too; positions aren't read."""
        return self.read("lists").select("term", "field", F.explode("ids").alias("chunk_id"))

    @property
    def dead(self) -> int:
        return sum(s["dead"] for s in self.state["segments"])

    def known_files(self) -> DataFrame:
        return self.read("files").select("path", "sha256")

    def vectors(self, model: str) -> DataFrame:
        return self.read("embeddings").filter(F.col("model") == model).select("chunk_id", "vector")

    def chunk(self, chunk_id: int) -> dict | None:
        row = self.read("chunks").filter(F.col("chunk_id") == chunk_id).first()
        return row.asDict() if row else None

    def chunks_by_id(self, ids: DataFrame) -> DataFrame:
        """The chunks of ids(chunk_id); ids that aren't there give nothing."""
        return self.read("chunks").join(ids.select("chunk_id").distinct(), "chunk_id")

    def repo_ids(self, repo: str) -> DataFrame:
        return self.read("chunks").filter(F.col("repo") == repo).select("chunk_id")

    def repos(self) -> DataFrame:
        return self.read("chunks").groupBy("repo").agg(F.count(F.lit(1)).alias("chunks")).orderBy("repo")


class Segment:
    """What a run adds. Its tables are written one after another and can be read back at once; others see them when the segment is published."""

    def __init__(self, store: "Store", since: dict):
        self.store, self.since, self.tables = store, since, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes rows of a table and gives them back as they are stored. Rows of files are those of paths that came or changed, or, with gone, of such that went."""
        schema = SCHEMAS[name]
        if name == "files":
            schema = LOG
            df = df.withColumns({"version": F.lit(self.since["version"] + 1).cast("long"), "gone": F.col("gone") if "gone" in df.columns else F.lit(False)})
        folder = f"{name}-{uuid.uuid4().hex}"
        self.tables.setdefault(name, []).append(folder)
        writer = df.select(*_columns(schema)).write.mode("error")
        (writer.partitionBy(*PARTITIONS[name]) if name in PARTITIONS else writer).parquet(f"{self.store.root}/{folder}")
        return self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{folder}").select(*_columns(schema))

    def drop(self) -> None:
        """Removes what was written, if the segment can't be published."""
        for folders in self.tables.values():
            for folder in folders:
                self.store.remove(f"{self.store.root}/{folder}")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, object]:
        """The versions that are there, with the status of their files."""
        if not self._fs.exists(self._path(self.root)):
            return {}
        found = {s.getPath().getName(): s for s in self._fs.listStatus(self._path(self.root))}
        return {int(name.removeprefix("VERSION-")): s for name, s in found.items() if name.startswith("VERSION-")}

    def state(self, version: int | None = None) -> dict:
        """The state of a version, by default the current one."""
        version = max(self._versions(), default=0) if version is None else version
        if not version:
            return json.loads(json.dumps(EMPTY))
        file = self._fs.open(self._path(f"{self.root}/VERSION-{version:012d}"))
        try:
            return json.loads(bytes(self._io.toByteArray(file)).decode())
        finally:
            file.close()

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.state())

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def segment(self, since: dict) -> Segment:
        return Segment(self, since)

    def staged(self) -> str:
        """A folder of its own for what a run writes on the way."""
        return f"{self.root}/staged-{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def publish(self, segment: Segment, totals: tuple[int, int] | None = None, watermark: int | None = None, instead: int = 0) -> dict:
        """Makes the next version: the state the segment was made from with the segment at its end, instead of so many of the last ones. Fails where another run has made that version, and so loses none
        of the other's rows; what the segment has written is removed then."""
        now = json.loads(json.dumps(segment.since))
        count = lambda name: sum(self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{f}").count() for f in segment.tables[name])
        rows = {name: count(name) for name in ("chunks", "embeddings", "dead") if name in segment.tables}
        own = {"tables": segment.tables, "rows": max(rows.get("chunks", 0), rows.get("embeddings", 0)), "chunks": rows.get("chunks", 0), "dead": rows.get("dead", 0)}
        now["segments"] = now["segments"][: len(now["segments"]) - instead] + [own]
        now["totals"] = list(totals or now["totals"])
        now["watermark"] = max(now["watermark"], watermark or 0)
        now["version"] += 1
        temporary = self._path(f"{self.root}/staged-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        # A rename that replaces nothing: one run only can make a version, and no reader finds half of one.
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        qualify = self._fs.makeQualified
        try:
            context.rename(qualify(temporary), qualify(self._path(f"{self.root}/VERSION-{now['version']:012d}")), options)
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            segment.drop()
            if "exist" not in str(error).lower():
                raise
            raise ConcurrentCommit(f"another run has committed version {now['version']} of {self.root}; read it and start again") from error
        return now

    def folding(self, state: dict) -> int:
        """How many of the newest segments are to be made one; 0 for none."""
        sizes = [s["rows"] + s["dead"] for s in state["segments"]]
        chunks, dead = (sum(s[k] for s in state["segments"]) for k in ("chunks", "dead"))
        if dead > DEAD * chunks:
            return len(sizes)
        n = 1
        while n < len(sizes) and sum(sizes[-n:]) >= FOLD * sizes[-n - 1]:
            n += 1
        return n if n > 1 else 0

    def fold(self) -> bool:
        """Makes the newest segments one, if it is time to."""
        now = self.snapshot()
        count = self.folding(now.state)
        if not count:
            return False
        some, segment = now.state["segments"][-count:], self.segment(now.state)
        every = count == len(now.state["segments"])
        try:
            for name in BY_CHUNK:
                if name != "postings" and any(name in s["tables"] for s in some):
                    segment.put(name, now.read(name, some))
            if any("lists" in s["tables"] for s in some):
                segment.put("lists", self._folded(now, some))
            if any("dictionary" in s["tables"] for s in some):
                segment.put("dictionary", keyword.added_up(now.read("dictionary", some), tuple(now.state["totals"]), every))
            log = [f for s in some for f in s["tables"].get("files", [])]
            if every:
                segment.put("files", now.read("files"))
            elif log:
                segment.tables["files"] = log  # small, and each row keeps its version
            if not every and any("dead" in s["tables"] for s in some):
                segment.put("dead", now.read("dead", some))
        except BaseException:
            segment.tables.pop("files", None)
            segment.drop()
            raise
        self.publish(segment, instead=count)
        return True

    def _folded(self, now: Snapshot, some: list[dict]) -> DataFrame:
        """The lists of segments without dead chunks. Those of large segments stay in their rows; those of small ones, which share ranges, are made anew of their postings."""
        some = [s for s in some if "lists" in s["tables"]]
        large = [s for s in some if s["chunks"] >= SMALL and "postings" not in s["tables"]] if now.dead <= HELD else []
        small, parts = [s for s in some if s not in large], []
        if large:
            dead = now.read("dead").toArrow().column("chunk_id").to_numpy() if now.dead else np.zeros(0, np.int64)
            parts.append(keyword.without(now.read("lists", large), np.sort(dead)))
        if small:
            parts.append(keyword.lists(keyword.KeywordIndex(now.read("postings", small), now.read("lengths", small), now.read("chunks", small))))
        return reduce(DataFrame.unionByName, parts)

    def vacuum(self, keep_seconds: float = 7 * 86400) -> None:
        """Removes versions that have been replaced for longer than that, and folders that no version needs which are as old."""
        versions, before = self._versions(), 1000 * (time.time() - keep_seconds)
        current = max(versions, default=0)
        kept = {v for v in versions if v == current or versions[min(n for n in versions if n > v)].getModificationTime() > before}
        needed = {f for v in kept for s in self.state(v)["segments"] for folders in s["tables"].values() for f in folders} | {f"VERSION-{v:012d}" for v in kept}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name not in needed and (name.startswith("VERSION-") or status.getModificationTime() <= before):
                self._fs.delete(status.getPath(), True)

    def known_files(self) -> DataFrame:
        return self.snapshot().known_files()

    def vectors(self, model: str) -> DataFrame:
        return self.snapshot().vectors(model)

    def chunk(self, chunk_id: int) -> dict | None:
        return self.snapshot().chunk(chunk_id)

    def chunks_by_id(self, ids: DataFrame) -> DataFrame:
        return self.snapshot().chunks_by_id(ids)

    def repo_ids(self, repo: str) -> DataFrame:
        return self.snapshot().repo_ids(repo)

    def repos(self) -> DataFrame:
        return self.snapshot().repos()
