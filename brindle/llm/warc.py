"""Operator 7: a deterministic sharded WARC writer, and its reader.

Order. Records are sorted by page_id, then by the digest of their payload, then by url, and shards are ranges of that order. The ranges follow from the data alone, not from
samples or from how the input was split: bytes are summed by the leading bits of page_id, ranges over a shard's bytes are summed again by more bits, all of a
level in one pass, and neighbours are joined up to a shard's bytes. An id whose rows are over a shard's bytes is split by digest. So the same pages give the same archives, byte
for byte, on any cluster. There are MAX_SHARDS shards' worth of bytes at most: a shard of more input is larger, so that the table of ranges has a bounded size.

Roles. Ids, sizes and digests are written once, without payloads. Digests are grouped, with partial sums first, to the smallest page_id of each payload; it is the response,
and others of the digest become revisits that refer to it. Digests that hold a given share of all rows are few and are looked up in a broadcast table; the rows of
others are joined. Payloads of fewer than a given number of bytes are all responses. Roles meet payloads in the shard's task, where both come sorted by id and
digest, so payloads are shuffled once.

Files. A file starts with a warcinfo record. Each record is a gzip member of its own. A shard's task writes its members one after another and starts a new file where the next one
would exceed the roll size in compressed bytes. A file ends with an empty member, so a cut file is told from a whole one. Files are written under a temporary name by
Spark's own writer and its commit protocol (lost executors and tasks that run twice leave nothing behind), described by a manifest of name, records, bytes and
SHA-256, and renamed by the driver, several at a time; the manifest is renamed last. A reader trusts only archives with a manifest, and checks size and digest of every file,
digest of every block and of every payload, and that a revisit names the record that its page's response has.

Defined results: null html is an empty payload; a null url is an empty one; page_id is a whole number (TypeError otherwise); rows that repeat the smallest page_id of a payload are
all responses, told apart by a number in their record ids, and the first is what revisits refer to; a row with a null page_id comes last and, where its payload has no other id, is a
response; an empty table gives an empty manifest; payloads of any length stay whole; other columns don't matter. A revisit has no payload: its digest and length are
those that its headers keep.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_unique, pick, small_batches, table

SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
MAX_SHARDS = 1 << 16
#: Leading bits of page_id by which bytes are summed at first, and bits more at each further level.
FIRST_BITS, MORE_BITS = 12, 4
LEVEL, RENAMES = 6, 16
EPOCH = "2000-01-01T00:00:00Z"
#: An empty gzip member. Its last byte is written as the line end of Spark's text writer.
END = bytes.fromhex("1f8b08000000000002ff03000000000000000000")


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line."""
    return " ".join(text.split())


def record_id(page_id, sha: str, times: int) -> str:
    """Of the rows with one id and payload, each has its own number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{sha}|{times}')}>"


def _headers(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = EPOCH) -> bytes:
    """The record that a file starts with."""
    return _headers(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: brindle\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url: str, payload: bytes, refers_to, is_revisit: bool, date: str = EPOCH, times: int = 0) -> bytes:
    """A WARC 1.1 record. Its headers follow from the page alone."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha, times)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}"]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha, 0)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response"]
    return _headers(lines, http if is_revisit else http + payload)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file, one member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        # Fed in pieces, as the rest of what is fed is copied at the end of each member.
        press, parts = zlib.decompressobj(31), []
        while not press.eof:
            if at >= len(view):
                raise ValueError("the file is cut")
            parts.append(press.decompress(view[at : at + 8192]))
            at = min(len(view), at + 8192)
        at -= len(press.unused_data)
        text = b"".join(parts)
        if not text:
            continue
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        yield headers, block


class _Files:
    """The shared file system, through Spark's own file layer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)

    def list(self, folder: str):
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(folder)))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a}")

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        file = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
        finally:
            file.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _cell(shift: int) -> Column:
    """The leading bits of page_id, in its order, without the last so many."""
    return F.shiftrightunsigned(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63))), shift)


class Ranges:
    """The shard of each row of a table (page_id, n, sha). leaves: (shift, cell, first shard, number of shards) of ranges of page_id in order."""

    def __init__(self, facts: DataFrame, shard_bytes: int):
        self.spark, self.leaves = facts.sparkSession, []
        ends = facts.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n"))).alias("nulls")).first()
        shard_bytes = max(shard_bytes, -(-ends["n"] // MAX_SHARDS))
        sums: list[tuple[int, int, int]] = []  # shift, cell and bytes
        if ends["low"] is not None:
            shift = max(0, (ends["low"] ^ ends["high"]).bit_length() - FIRST_BITS) if (ends["low"] < 0) == (ends["high"] < 0) else 64 - FIRST_BITS
            rows = facts.filter("page_id IS NOT NULL")
            while True:
                found = rows.groupBy(_cell(shift).alias("cell")).agg(F.sum("n").alias("n")).collect()
                large = [(r["cell"],) for r in found if r["n"] > shard_bytes and shift]
                sums += [(shift, r["cell"], r["n"]) for r in found if r["n"] <= shard_bytes or not shift]
                if not large:
                    break
                # Each of them has more than a shard's bytes, so they are fewer than MAX_SHARDS.
                rows = facts.withColumn("cell", _cell(shift)).join(F.broadcast(self.spark.createDataFrame(large, "cell long")), "cell", "left_semi").drop("cell")
                shift = max(0, shift - MORE_BITS)
        at, held = 0, 0
        for shift, cell, n in sorted(sums, key=lambda x: (x[1] % (1 << 64)) << x[0]):
            if held and held + n > shard_bytes:
                at, held = at + 1, 0
            parts = max(1, -(-n // shard_bytes))
            self.leaves.append((shift, cell, at, parts))
            at, held = at + parts - 1, held + n
        at += bool(self.leaves)
        self.nulls = (at, max(1, -(-(ends["nulls"] or 0) // shard_bytes)))
        self.count = at + (ends["nulls"] is not None) * self.nulls[1]

    def shard(self, df: DataFrame) -> DataFrame:
        """df with its shard. There are few levels, and each is a lookup in a table of bounded size."""
        first, parts = F.when(F.col("page_id").isNull(), self.nulls[0]), F.when(F.col("page_id").isNull(), self.nulls[1])
        names = []
        for shift in sorted({x[0] for x in self.leaves}):
            names += [f"cell_{shift}", f"first_{shift}", f"parts_{shift}"]
            level = self.spark.createDataFrame([x[1:] for x in self.leaves if x[0] == shift], f"cell_{shift} long, first_{shift} int, parts_{shift} int")
            df = df.withColumn(names[-3], _cell(shift)).join(F.broadcast(level), names[-3], "left")
            first, parts = F.coalesce(first, F.col(names[-2])), F.coalesce(parts, F.col(names[-1]))
        lead = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
        return df.withColumn("shard", (first + F.when(parts > 1, F.shiftright(lead * parts, 32)).otherwise(0)).cast("int")).drop(*names)


def roles(facts: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """page_id, sha and refers_to of the rows that another page's equal payload stands for, each once. facts: page_id, n, sha."""
    first = facts.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).filter("times > 1 AND refers_to IS NOT NULL")
    first = scratch.keep(first.select("sha", "refers_to"), "first")
    return join_unique(facts.select("page_id", "sha"), first, "sha").filter(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select("page_id", "sha", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = EPOCH) -> list[dict]:
    """Writes the archives and their manifest to a folder that isn't there yet; returns the manifest."""
    spark = pages.sparkSession
    pages = pick(pages, "page_id", "url", "html")
    if pages.schema["page_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"page_id is a whole number, not {pages.schema['page_id'].dataType.simpleString()}")
    files, temporary, scratch = _Files(spark, folder), f"{folder}-{uuid.uuid4().hex}.tmp", Scratch(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sha"))
    facts = scratch.keep(pages.select("page_id", F.octet_length("payload").cast("long").alias("n"), "sha"), "facts")
    ranges = Ranges(facts, shard_bytes)
    none = F.lit(None)
    rows = pages.withColumn("refers_to", none.cast("long")).unionByName(roles(facts, scratch, least_bytes).select("page_id", F.lit("").alias("url"), none.cast("binary").alias("payload"), "sha", "refers_to"))
    # A row's roles, which have no payload, come before it.
    dealt = small_batches(ranges.shard(rows).repartitionById(max(1, ranges.count), "shard").sortWithinPartitions(F.col("page_id").asc_nulls_last(), "sha", F.col("payload").isNotNull(), "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, roll, before = [], 0, 0, 0, None  # before: shard, page_id and digest of the row before
        role, times = None, 0

        def file(shard: int) -> pa.RecordBatch:
            data = b"".join(held) + END
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([roll], pa.int32()), pa.array([count], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data[:-1]], pa.binary())], ["shard", "roll", "records", "sha256", "data"])

        for batch in batches:
            for page, url, payload, refers, *key in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to", "shard", "page_id", "sha"))):
                if key != before:
                    role, times, before = None, 0, key
                if payload is None:
                    role = refers
                    continue
                one = member(record(page, url, payload, role, role is not None, date, times))
                times += 1
                if count and size + len(one) > roll_bytes:
                    yield file(key[0])
                    count, roll = 0, roll + 1
                if not count:
                    held = [member(info(f"pages-{key[0]:05d}-{roll:05d}.warc.gz", date))]
                    size = len(held[0])
                held.append(one)
                size, count = size + len(one), count + 1
        if count:
            yield file(before[0])

    made = dealt.mapInArrow(run, "shard int, roll int, records long, sha256 string, data binary")
    # One row is one file: a line of text whose line end completes the last gzip member. The folder names carry the manifest's columns.
    lines = made.select(F.col("data").cast("string").alias("value"), F.concat_ws("-", F.format_string("%05d", "shard"), F.format_string("%05d", "roll"), "records", "sha256").alias("file"))

    def place(name: str) -> dict:
        ((part, size),) = ((n, s) for n, s in files.list(f"{temporary}/{name}") if n.startswith("part-"))
        at, roll, records, sha = name[5:].split("-")
        entry = {"file": f"pages-{at}-{roll}.warc.gz", "records": int(records), "bytes": size, "sha256": sha}
        files.rename(f"{temporary}/{name}/{part}", f"{temporary}/{entry['file']}")
        files.delete(f"{temporary}/{name}")
        return entry

    try:
        lines.write.partitionBy("file").option("maxRecordsPerFile", 1).option("lineSep", "\0").text(temporary)
        with ThreadPoolExecutor(RENAMES) as several:
            manifest = list(several.map(place, [n for n, _ in files.list(temporary) if n.startswith("file=")]))
        files.write(f"{temporary}/manifest.json.tmp", json.dumps({"files": manifest}))
        files.rename(f"{temporary}/manifest.json.tmp", f"{temporary}/manifest.json")
        files.rename(temporary, folder)
    except BaseException:
        files.delete(temporary)
        raise
    finally:
        scratch.drop()
    return manifest


def read(spark: SparkSession, folder: str, page_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload (null for revisits) of every record."""
    manifest = json.loads(_Files(spark, folder).read(f"{folder}/manifest.json"))["files"]
    schema = f"page_id {page_type}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {page_type}, payload binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    there = {name for name, _ in _Files(spark, folder).list(folder)}
    if missing := [m["file"] for m in manifest if m["file"] not in there]:
        raise ValueError(f"{folder} lacks {len(missing)} files of its manifest, {missing[0]} first")
    known = spark.sparkContext.broadcast({m["file"]: m for m in manifest})
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64() if page_type == "bigint" else pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64() if page_type == "bigint" else pa.int32(), pa.binary()]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                entry = known.value.get(path.rsplit("/", 1)[-1])
                if entry is None:
                    continue
                if len(data) != entry["bytes"] or hashlib.sha256(data).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{path} differs from the manifest")
                rows, size = [], 0
                for headers, block in parse(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page, refers, sha = headers["X-Page-ID"], headers.get("X-Refers-To-Page"), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if revisit := headers["WARC-Type"] == "revisit":
                        n, sound = int(http.rsplit(b"Content-Length: ", 1)[1]), headers["WARC-Refers-To"] == record_id(refers, sha, 0)
                    else:
                        n, sound = len(payload), digest(payload) == sha
                    if not sound:
                        raise ValueError(f"record {headers['WARC-Record-ID']} isn't what its headers say")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], sha, n, int(refers) if refers else None, None if revisit else payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return found.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark).root}/warc"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
