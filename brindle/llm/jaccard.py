"""Operator 9: n-gram Jaccard join by parity sketches.

Two documents link when the Jaccard similarity of their sets of word shingles is at least 75 %. With a and b shingles, b the fewer, linked sets differ in
at most (a + b) / 7 shingles, which is at most b / 3, and at most 2 a / 7.

Pieces. Shingles are hashed to bits of a parity sketch: a bit is the exclusive-or of the shingles that hit it, so a shingle in one set only flips one bit of
the sketch, and the Hamming distance of two sketches is at most the symmetric difference. The sketch is cut into pieces, their number set by the band of sizes,
and a piece is so wide that its content is told by the exclusive-or of its shingles' 64-bit words. D shingles that the other set lacks change D pieces at most;
if each document lists the D + 1 of its pieces that come first in one fixed order of all pieces, D being a quarter of its shingles, two linked documents list a
piece in common. The order puts pieces of rare shingles first, so that passages, boilerplate and large groups of copies make few common pieces; any order
gives the same links. Bands are powers of four; a document within a third of the next band is listed in both.

Positions. Take the first piece that two linked documents have in common, at position i of the list of the document with a shingles. The i pieces before are missing
from the other document, so i is at most (4 a - 3 b) / 7: a listed piece can be shared so with partners of up to (4 a - 7 i) / 3 shingles, and it carries this
limit. Only pairs within each other's limits are taken. So documents that share a passage, but have text of their own, make no pair, however many there are,
and neither do copies that have drifted too far. A piece changes, too, if a shingle that only the other set has is hashed to the same place; there are so many
places that such pieces are within SLACK.

Stages.
1. Every row gets its set's size, 128-bit fingerprint and sketch, and shingles are counted over all rows in a fixed number of slots: a slot far above the mean
   holds a common one. Equal sets become one node.
2. Nodes' pieces are dealt by piece. Pieces of a single node, and those beyond the limits of any partner, go.
3. Every node is verified against one leader, of its pieces' nodes with the widest limits that with which it shares most: first by the Hamming distance of their sketches,
   of two bits a shingle, then, for the few that are left, by their sets, which are taken from the texts again rather than stored for all.
4. Pieces whose nodes aren't all connected by now give their other pairs of different components, those already tried left out, where one of the two is outside
   the leader's component; these are verified, too. So a group of near copies takes one verification a node, and no link between components is missed.
5. Components are joined to the rows by fingerprint.

Defined results: a text with fewer than five words is one shingle, its whole sequence; null texts and texts without words have no shingles and link with
nothing; equal sets link; rows with the same doc_id are one document; a row with a null doc_id links with nothing and has a null component; texts of any
length are read whole; an empty table gives no rows; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_unique, kept, pick, slices, small_batches, table, worker_state
from .components import components
from .shingles import mix, shingles

_U = np.uint64
NUMERATOR, DENOMINATOR = 75, 100
#: Counters of shingles, in blocks that are added up apart. A byte of each is broadcast.
SLOTS, BLOCKS = 1 << 22, 64
SMALLEST, LARGEST = 256, 1 << 16  # bits of the sketch that is compared
BYTES = 1 << 20
FILTER_BITS = 1 << 27


def _ints(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s, 1).sum(dtype=np.uint64)), int(mix(s, 2).sum(dtype=np.uint64))


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a row's id, size, fingerprint and sketch. kind 1: the counts of a block of slots in this task, compressed."""
    worker_state("jaccard", dict)
    slots, names = np.zeros(SLOTS, np.uint32), ["kind", "doc_id", "n", "f1", "f2", "sketch"]
    kind = None
    for batch in batches:
        for part in slices(batch, "text", size=BYTES):
            sets = shingles(_texts(part))
            kind = part.column("doc_id").type
            at, n = np.unique(np.concatenate(sets) & _U(SLOTS - 1), return_counts=True)
            slots[at.astype(np.int64)] += n.astype(np.uint32)
            prints = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _ints(prints[:, 0].copy()), _ints(prints[:, 1].copy()), pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary())], names)
    if kind is not None:
        parts = [(k, zlib.compress(block.astype("<u4").tobytes(), 1)) for k, block in enumerate(slots.reshape(BLOCKS, -1)) if block.any()]
        zero = pa.array(np.zeros(len(parts), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(parts), np.int32)), pa.nulls(len(parts), kind), pa.array([k for k, _ in parts], pa.int64()), zero, zero, pa.array([z for _, z in parts], pa.binary())], names)


def _levels(mean: float):
    """Adds up the counts of each block of slots and tells how far a slot is above what chance gives: 0 up to four deviations of the mean, then one for each doubling."""
    least = mean + 4 * math.sqrt(mean) + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(batch.column("n").to_pylist(), batch.column("sketch").to_pylist()):
                block = np.frombuffer(zlib.decompress(z), "<u4").astype(np.int64)
                sums[k] = sums[k] + block if k in sums else block
        for k, total in sums.items():
            over = np.maximum(total - mean, 1.0) / (least - mean)
            level = np.where(total < least, 0, np.minimum(40, 1 + np.floor(2 * np.log2(np.maximum(over, 1.0))))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["n", "levels"])

    return run


def bands(n: int) -> list[tuple[int, int]]:
    """(band, pieces) in which a set of n shingles is listed."""
    band = (n.bit_length() - 1) // 2
    top = 4 ** (band + 1)
    return [(k, min(1 << 31, 4 ** (k + 1) << 16)) for k in ([band, band + 1] if 4 * n >= 3 * top else [band])]


def slack(n: int) -> int:
    """Places at which a piece may be changed by a shingle of the other set only. There are 65536 n places or more, and less than n / 7 such shingles for the n / 4
    pieces listed: a thousandth of one up to 2048 shingles, so one is allowed for, and one more with each 1024 shingles."""
    return 1 + n // 1024


def pieces(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces that a set lists, and the largest partner for each: with n shingles the n // 4 + 1 first in order, and as many more as the slack
    allows. levels: how common each shingle is."""
    n = len(s)
    keys, need = [], n // 4 + 1 + slack(n)
    for band, count in bands(n):
        piece = ((s >> _U(32)) * _U(count)) >> _U(32)
        order = np.argsort(piece, kind="stable")
        piece = piece[order]
        first = np.nonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))[0]
        content = np.bitwise_xor.reduceat(mix(s[order], 3), first)
        level = np.minimum.reduceat(levels[order], first)
        key = mix(content ^ mix(piece[first] + _U(band << 40), 4))
        rank = np.argsort((level.astype(np.uint64) << _U(58)) | (key >> _U(6)))
        keys.append(key[rank[:need]])
    return np.concatenate(keys), np.concatenate([(4 * n - 7 * (np.arange(len(k)) - slack(n))) // 3 for k in keys])


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch of a width that is a power of two; halves of a wider one fold by exclusive-or into a narrower one."""
    width = min(LARGEST, max(SMALLEST, 1 << (2 * len(s) - 1).bit_length()))
    at = (mix(s, 6) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(a: int, b: int, distance: int) -> bool:
    """Whether sets of these sizes that differ in at least so many shingles can link."""
    return DENOMINATOR * (a + b - distance) >= NUMERATOR * (a + b + distance) and DENOMINATOR * min(a, b) >= NUMERATOR * max(a, b)


def links(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared)


class _Join:
    def __init__(self, docs: DataFrame):
        self.docs = small_batches(pick(docs, "doc_id", "text"))
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)

    def measured(self) -> None:
        schema = f"kind int, doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, n long, f1 long, f2 long, sketch binary"
        found = self.scratch.keep(self.docs.mapInArrow(_measure, schema), "measured")
        self.rows, self.sketches = found.filter("kind = 0").drop("kind", "sketch"), found.filter("kind = 0 AND n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "sketch")
        nodes = self.rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
        self.nodes = self.scratch.keep(nodes, "nodes")
        total = self.rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        # Blocks of slots are dealt out and added up one after another, so that a task holds a sum and not all tasks' counts.
        dealt = found.filter("kind = 1").select("n", "sketch").repartition(BLOCKS, "n")
        levels = np.zeros((BLOCKS, SLOTS // BLOCKS), np.uint8)
        for row in dealt.mapInArrow(_levels(total["n"] / SLOTS), "n long, levels binary").collect():
            levels[row["n"]] = np.frombuffer(row["levels"], np.uint8)
        levels = levels.reshape(-1)
        self.levels = self.spark.sparkContext.broadcast(levels)

    def listed(self) -> None:
        """Pieces shared by several nodes that may pair: key, node, n, most, pieces."""
        held = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state("jaccard", dict)
            seen: set[int] = set()
            for batch in batches:
                for part in slices(batch, "text", rows=512, size=BYTES):
                    found, prints, sizes = [], [], []
                    for s in shingles(_texts(part)):
                        f = fingerprint(s)[0]
                        if len(s) and f not in seen:
                            seen.add(f)
                            found.append(pieces(s, held.value[(s & _U(SLOTS - 1)).astype(np.int64)]))
                            prints.append(np.full(len(found[-1][0]), f, np.uint64))
                            sizes.append(np.full(len(found[-1][0]), len(s), np.int32))
                    if found:
                        yield pa.RecordBatch.from_arrays([_ints(np.concatenate([k for k, _ in found])), _ints(np.concatenate(prints)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate([m for _, m in found]).astype(np.int32))], ["key", "f1", "n", "most"])

        listed = self.docs.filter("doc_id IS NOT NULL").mapInArrow(run, "key long, f1 long, n int, most int")
        several = self._several(listed, "f1").distinct().join(self.nodes.select("f1", "n", "node"), ["f1", "n"]).select("key", "node", "n", "most")
        # Documents with long passages in common share many pieces with the same others. Pieces of equal nodes become one, with the widest limits.
        keyed = Window.partitionBy("key")
        members = F.xxhash64(F.bit_xor(F.xxhash64("node")).over(keyed), F.bit_xor(F.xxhash64(F.lit("second"), "node")).over(keyed), F.count(F.lit(1)).over(keyed))
        shared = several.withColumn("members", members).groupBy(F.col("members").alias("key"), "node", "n").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("pieces"))
        self.shared = self.scratch.keep(shared, "shared")

    @staticmethod
    def _several(rows: DataFrame, column: str) -> DataFrame:
        """Rows of keys with more than one value of a column, and with a partner within limits."""
        keyed = Window.partitionBy("key")
        rows = rows.withColumns({"low": F.min(column).over(keyed), "high": F.max(column).over(keyed), "smallest": F.min("n").over(keyed), "widest": F.max("most").over(keyed)})
        return rows.filter("low <> high AND smallest <= most AND n <= widest").drop("low", "high", "smallest", "widest")

    def members(self, nodes: DataFrame, name: str) -> DataFrame:
        """The sets of some nodes, from the texts. A bitmap of FILTER_BITS bits, so of a bounded size whatever the input, is broadcast and drops most other
        rows before they are split into words; a join drops the rest."""
        nodes = self.scratch.keep(nodes.distinct(), f"{name}-nodes")
        bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
        words = nodes.select(F.shiftright(bit("node"), 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {FILTER_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        docs = self.docs.filter("doc_id IS NOT NULL").withColumn("w", F.shiftright(bit("doc_id"), 6)).join(F.broadcast(words), "w")
        docs = docs.filter(F.expr(f"(shiftrightunsigned(b, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) & 63 as int)) & 1) = 1")).select("doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", rows=512, size=BYTES):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingles(_texts(part))], pa.binary())], ["node", "members"])

        sets = docs.mapInArrow(run, f"node {self.docs.schema['doc_id'].dataType.simpleString()}, members binary").filter("octet_length(members) > 0")
        return self.scratch.keep(sets.join(nodes, "node", "left_semi"), f"{name}-sets")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs(x, y) that link."""

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = {k: b.column(k).to_pylist() for k in ("nx", "ny", "sx", "sy")}
                ok = [may_link(p, q, hamming(s, t)) for p, q, s, t in zip(*c.values())]
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

        def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [links(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(b.column("mx").to_pylist(), b.column("my").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        a, b = (self.near.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "xy")
        close = self.scratch.keep(pairs.join(a, "x").join(b, "y").mapInArrow(near, f"x {kind}, y {kind}").distinct(), f"{name}-near")
        sets = self.members(close.select(F.col("x").alias("node")).unionByName(close.select(F.col("y").alias("node"))), name)
        a, b = (sets.select(F.col("node").alias(k), F.col("members").alias(f"m{k}")) for k in "xy")
        found = self.scratch.keep(close.join(a, "x").join(b, "y").mapInArrow(equal, f"x {kind}, y {kind}"), name)
        self.scratch.drop(f"{name}-sets")
        return found

    def same_ids(self) -> DataFrame:
        """Links (u, v) between an id and the nodes of its rows, for ids whose rows have unlike sets: they are one document."""
        rows = self.rows.filter("n > 0 AND doc_id IS NOT NULL")
        several = rows.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).filter("low <> high").select("doc_id")
        return rows.join(several, "doc_id", "left_semi").join(self.nodes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()

    def run(self) -> DataFrame:
        self.measured()
        self.listed()
        same = self.scratch.keep(self.same_ids(), "same")
        same = None if same.isEmpty() else same
        if self.shared.isEmpty():
            found = None if same is None else components(same, self.scratch, "c0")
        else:
            needed = self.shared.select("node").distinct()
            sketches = self.sketches.withColumnRenamed("doc_id", "node").join(needed, "node", "left_semi")
            self.near = self.scratch.keep(sketches, "sketches")
            found = self._linked(same)
        ids = self.nodes.select("f1", "f2", "n", "node", "rows")
        if found is None:
            classes = ids.filter("rows > 1").withColumn("component", F.col("node"))
        else:
            classes = ids.join(found, "node", "left").filter("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
        classes = self.scratch.keep(classes.select("f1", "f2", "n", "component"), "classes")
        self.scratch.only("measured", "classes")
        # Copies of one text, and texts without words, may be a large part of the rows: they are looked up, or go past.
        sets = lambda df: df.withColumn("set", F.struct("f1", "f2", "n")).drop("f1", "f2")
        out = join_unique(sets(self.rows.filter("n > 0")).select("doc_id", "n", "set"), sets(classes).drop("n"), "set", "left").select("doc_id", "n", "component")
        out = out.unionByName(self.rows.filter("n = 0").select("doc_id", "n"), allowMissingColumns=True)
        # Copies of a null id must not take a component from the rows that have one.
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

    def _linked(self, same: DataFrame | None) -> DataFrame:
        keyed = Window.partitionBy("key")
        first_of = F.min(F.struct((F.col("n") - F.col("most")).alias("tight"), "node", "n", "most")).over(keyed)
        least = self.shared.withColumn("low", first_of).filter("node <> low.node AND n <= low.most AND low.n <= most")
        leader = least.groupBy("node", F.col("low.node").alias("leader")).agg(F.sum("pieces").alias("k")).groupBy("node").agg(F.min_by("leader", F.struct(-F.col("k"), "leader")).alias("leader"))
        tried = self.scratch.keep(leader.select(F.col("node").alias("x"), F.col("leader").alias("y")), "tried")
        first = self.verified(tried, "first")
        links_of = lambda df: df.select(F.col("x").alias("u"), F.col("y").alias("v"))
        known = links_of(first) if same is None else links_of(first).unionByName(same)
        found = self.scratch.keep(components(known, self.scratch, "c1"), "component1")
        rows = self.shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = F.min(F.struct((F.col("n") - F.col("most")).alias("tight"), "node", "component")).over(keyed)["component"]
        rows = self._several(rows, "component").withColumn("outside", F.col("component") != main)
        rows = self.scratch.keep(self._several(rows, "component"), "apart")
        x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "most", "component", "outside"))) for k in "xy")
        met = x.filter("outside_x").join(y, "key").filter("component_x <> component_y AND n_x <= most_y AND n_y <= most_x AND (NOT outside_y OR node_x < node_y)")
        pairs = met.select(F.greatest("node_x", "node_y").alias("x"), F.least("node_x", "node_y").alias("y")).distinct()
        pairs = pairs.join(tried.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), ["x", "y"], "left_anti")
        second = self.verified(pairs, "second")
        if second.isEmpty():
            return found
        return components(known.unionByName(links_of(second)), self.scratch, "c2")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _Join(docs).run()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def _own_keys(docs: DataFrame, names: tuple[str, ...], at: str, scratch: Scratch) -> DataFrame:
    """The documents with a column `key` that no unlike texts share: the id (column `at`), or a hash of id and text where several rows have the id. Of rows with
    the same id and text, if it has a word, the one with the least other columns stays."""
    whole = docs.schema[at].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    own = F.col(at).cast("long" if whole else "string")
    several = scratch.keep(docs.filter(F.col(at).isNotNull()).groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"), "several")
    if several.isEmpty():
        return docs.withColumn("key", own)
    # With a frequent placeholder for an id, the rows stay where they are.
    marked = join_unique(docs.withColumn("id", own), several.withColumn("again", F.lit(True)), "id", "left")
    mark = F.xxhash64(F.lit("row"), "id", "text")
    marked = marked.withColumn("key", F.when(F.col("again"), mark if whole else F.concat_ws("#", "id", F.hex(mark))).otherwise(F.col("id"))).drop("id")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.coalesce("again", F.lit(False))
    ordered = [n for n in names if "map<" not in docs.schema[n].dataType.simpleString()]
    once = marked.filter(worded).groupBy("key").agg(F.min_by(F.struct(*names), F.struct(*ordered)).alias("least")).select(*(F.col("least")[n].alias(n) for n in names), "key")
    return scratch.keep(marked.filter(~worded).select(*names, "key").unionByName(once), "keyed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id. Rows that link with nothing stay, and so do rows without an id or without a word. Rows that share an
    id, but aren't alike, are documents of their own; of rows with equal id and text the one with the least other columns stays; rows of an id that several rows
    have are ordered by a hash of id and text, which counts as their id."""
    scratch = Scratch(spark)

    def judge(flat: DataFrame, names: tuple[str, ...]) -> DataFrame:
        keyed = _own_keys(flat, names, f"c{docs.columns.index('doc_id')}", scratch)
        first = join(keyed.select(F.col("key").alias("doc_id"), "text")).filter("component_id = doc_id").select(F.col("doc_id").alias("key")).distinct()
        return keyed.join(first, "key", "left_semi").unionByName(keyed.filter("key IS NULL"))

    return kept(docs, judge)
