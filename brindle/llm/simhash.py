"""Operator 12: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint. A-Z are lower-cased, words are runs of bytes other than blanks (0x20 and 0x09 to 0x0D); every shingle of WORDS words, joined by a blank and repeats included, is hashed by
XXH64 with seed 42. A bit of the fingerprint is 1 where more than half the hashes have it.

Covering. Bit position i gets a vector b(i) of radius + 1 bits, not zero. For every other such vector v a mask holds the positions with an odd b(i) & v. Two fingerprints that differ in at
most `radius` positions have a v that is orthogonal to the vectors of all these positions (they span radius dimensions at most), so the two agree on the whole of v's mask: every pair within
the radius collides in some of the 2 ** (radius + 1) - 1 tables, for certain, whatever the data.

Buckets. Equal fingerprints become one node first. A bucket is a table and a masked fingerprint. One with up to LIST nodes compares them. In a larger one no pairs are made: its
nodes can only differ in the bits outside the mask, and x and y are within 3 of each other just if some spot z of these bits is within 1 of y and within 2 of x. So each node goes to the spots
within 2 (466 at most); where a spot has a node within 1, that node is within 3 of every node at the spot, and all are linked to it. This finds just the pairs within the radius, up to
connection, in steps that grow with the nodes, however large a bucket. A spot holds as many nodes as there are spots around it at most.

Links are checked by their Hamming distance; components come from alternating star steps, and get back to the rows through their fingerprints.

Defined results: null texts and texts without words have the fingerprint zero and link like any other; fewer words than WORDS are one shingle, their whole sequence; repeated rows give
equal rows; rows without an id keep their fingerprint and may connect others, and their component is the smallest id that they reach, null if there is none; an empty table gives no rows; columns
besides doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import HOT, Scratch, join_unique, pick, slices, small_batches, table
from .components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Nodes that a bucket compares one by one.
LIST = 128
#: Hashes that are counted at once.
PIECE = 1 << 16


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    end = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
    start = [0, *(at + 1 for at in end[:-1])]
    ones, n, digest = np.zeros(64, np.int64), len(words) - size + 1, xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        found = [digest(joined[a:b], SEED) for a, b in zip(start[at : min(n, at + PIECE)], end[at + size - 1 :])]
        ones += np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (fp, as a signed long) of every row."""
    docs = pick(docs, "doc_id", "text")
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary())
                found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(kind), pa.array(found)], ["doc_id", "fp"])

    return small_batches(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of a covering of 64 bits, as unsigned numbers."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spots(radius: int = RADIUS) -> list[tuple[int, int, bool]]:
    """Table, change and whether it is a near one, for all changes of up to the larger half of the radius in bits outside a table's mask; near ones are up to the smaller half."""
    out = []
    for number, mask in enumerate(masks(radius)):
        free = [i for i in range(64) if not mask >> i & 1]
        out += [(number, signed(sum(1 << i for i in c)), k <= radius // 2) for k in range(radius - radius // 2 + 1) for c in combinations(free, k)]
    return out


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, most: int = LIST) -> DataFrame:
    """u and v of linked nodes(fp), a written table of distinct fingerprints: all links that compared buckets have, and enough to connect what larger ones link."""
    tables = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(masks(radius))]
    keys = nodes.select("fp", F.explode(F.array(*tables)).alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    several = scratch.keep(several, "buckets")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    twos = several.filter("n = 2").select("u", "v").filter(apart <= radius)
    # Rows of the largest buckets are looked up, so that none of these is dealt by its key.
    many, wide = several.filter("n > 2").select("key", "n"), nodes.count() * len(tables)
    few = nodes.sparkSession.createDataFrame(many.filter(F.col("n") * HOT >= wide).collect(), many.schema)
    dealt = keys.join(F.broadcast(few.select("key")), "key", "left_anti").join(many.filter(F.col("n") * HOT < wide), "key")
    members = scratch.keep(dealt.select("key", "fp", "n").unionByName(keys.join(F.broadcast(few), "key").select("key", "fp", "n")), "members")

    lists = members.filter(F.col("n") <= most).groupBy("key").agg(F.collect_list("fp").alias("all"))
    near = lambda x: F.filter("all", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    pairs = F.flatten(F.transform("all", lambda x: F.transform(near(x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    compared = lists.select(F.explode(pairs).alias("p")).select("p.u", "p.v")

    changes = nodes.sparkSession.createDataFrame(spots(radius), "t int, change long, near boolean")
    large = members.filter(F.col("n") > most).select(F.col("key.t").alias("t"), "fp").join(F.broadcast(changes), "t")
    met = large.groupBy("t", F.col("fp").bitwiseXOR(F.col("change")).alias("spot")).agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("v"), F.collect_list("fp").alias("all"))
    starred = met.filter("v IS NOT NULL AND size(all) > 1").select(F.explode("all").alias("u"), "v").filter((F.col("u") != F.col("v")) & (apart <= radius))
    return twos.unionByName(compared).unionByName(starred).distinct()


def join(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits and component_id of every row."""
    if not 0 < radius < 6:
        raise ValueError("the radius must be from 1 to 5")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(scratch.keep(links(nodes, scratch, radius), "links"), scratch, "c").withColumnRenamed("node", "fp")
    found = scratch.keep(found.join(nodes, "fp"), "found")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = join_unique(found.select("component", "fp"), least, "component").select("fp", "component_id")
    classes = nodes.join(linked.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    classes = scratch.keep(classes, "classes")
    scratch.only("rows", "classes")
    out = join_unique(rows, classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
