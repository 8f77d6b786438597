"""Operator 2: sharding by extendible hashing, in DataFrame operations only.

A row belongs to the bucket of its hash's leading bits. A bucket over the byte limit is split on its next bit, and only such a bucket, until every bucket
holds at most the limit or a single row. The directory is built in pages of eight bits: the 256 sums of a page give the depth of each of its entries, and
only the rows under entries that are still too large are summed again in the next page. Pages are aggregated before they are shuffled, hold 256 entries
at most, and are joined to rows of (id, hash, bytes); texts are read once and never shuffled.

The hash covers id and text, so a repeated or missing id doesn't make a bucket that can't be split. Rows equal in both can't be told apart by any bit;
where they exceed the limit, they go to numbered overflow pages of the bucket.

Defined results: a null text has no bytes; a null id counts as an empty one; a row over the limit is a shard of its own; repeated rows may share a shard;
an empty table gives no rows; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, table

BITS, PAGE = 56, 8
LIMIT = 1 << 20


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, 56 bits of hash, bytes, and a number for the row."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    return pick(docs, "doc_id", "text").select("doc_id", F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))


def _halves(finer: Column, size: int) -> Column:
    """The sums of a level from those of the next finer one."""
    pair = lambda i, k: finer[i * 2][k] + finer[i * 2 + 1][k]
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(pair(i, "b").alias("b"), pair(i, "n").alias("n")))


def directory(rows: DataFrame, base_bits: int, limit: int) -> DataFrame:
    """base, entry and depth of one round's pages; the depth is over base_bits + 8 where an entry must be split further."""
    base = F.shiftright("hash", BITS - base_bits) if base_bits else F.lit(0).cast("long")
    entry = F.shiftright("hash", BITS - base_bits - PAGE).bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int")
    sums = rows.groupBy(base.alias("base"), entry.alias("entry")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    page = sums.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("entry", F.struct("b", "n")))).alias("m"))
    zero = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    page = page.withColumn("l8", F.transform(F.sequence(F.lit(0), F.lit((1 << PAGE) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero)))
    for d in range(PAGE - 1, -1, -1):
        page = page.withColumn(f"l{d}", _halves(F.col(f"l{d + 1}"), 1 << d))
    page = page.withColumn("entry", F.explode(F.map_keys("m")))
    depth = F.lit(base_bits + PAGE + 1)
    for d in range(PAGE, -1, -1):
        at = F.col(f"l{d}")[F.shiftright("entry", PAGE - d)]
        depth = F.when((at["b"] <= limit) | (at["n"] <= 1), F.lit(base_bits + d)).otherwise(depth)
    return page.select("base", "entry", depth.alias("depth"))


def shards(docs: DataFrame, limit: int = LIMIT, bits: int = BITS) -> DataFrame:
    """doc_id, n_bytes, and the shard: its depth in bits, prefix, and overflow page."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows, parts = scratch.keep(entries(docs), "rows"), []
    for base_bits in range(0, bits, PAGE):
        found = scratch.keep(directory(rows, base_bits, limit), f"directory{base_bits}")
        base = F.shiftright("hash", BITS - base_bits) if base_bits else F.lit(0).cast("long")
        entry = F.shiftright("hash", BITS - base_bits - PAGE).bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int")
        placed = rows.withColumns({"base": base, "entry": entry}).join(found, ["base", "entry"]).select("doc_id", "hash", "n_bytes", "row", "depth")
        parts.append(placed.filter(F.col("depth") <= base_bits + PAGE).withColumn("page", F.lit(0).cast("long")))
        if found.filter(F.col("depth") > base_bits + PAGE).isEmpty():
            break
        rows = placed.filter(F.col("depth") > base_bits + PAGE).drop("depth")
    else:
        parts.append(_overflow(rows.withColumn("depth", F.lit(bits)), limit, bits))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    prefix = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright(hash, {BITS} - depth)"))
    return out.select("doc_id", "n_bytes", "depth", prefix.alias("prefix"), "page", F.concat_ws("-", "depth", prefix, "page").alias("shard"))


def _overflow(rows: DataFrame, limit: int, bits: int) -> DataFrame:
    """Numbers the pages of buckets that no bit splits. A row's rank is that within its input partition plus the rows of earlier partitions, so that no
    task gets a whole bucket."""
    rows = rows.withColumns({"bucket": F.expr(f"shiftright(hash, {BITS - bits})"), "part": F.shiftright("row", 33)})
    keys = ["bucket", "part"]
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most")).select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.max("most").over(Window.partitionBy("bucket")).alias("most"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).join(starts, keys)
    page = F.floor((F.col("start") + F.col("rank") - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("most"), F.lit(1)))))
    return ranked.select("doc_id", "hash", "n_bytes", "row", "depth", page.cast("long").alias("page"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH e AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 14))::BIGINT AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, d::INT AS depth, CASE WHEN d = 0 THEN 0 ELSE h >> ({BITS} - d)::INT END AS prefix FROM e, range(0, {BITS + 1}) t(d)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM levels GROUP BY ALL),
fit AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM levels JOIN sums USING (depth, prefix) WHERE b <= {LIMIT} OR n <= 1 GROUP BY ALL)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, depth, prefix, 0::BIGINT AS page, depth || '-' || prefix || '-0' AS shard
FROM (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE h >> ({BITS} - depth) END AS prefix FROM fit)
"""
