"""Operator 8: chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation many times, each time with a few more turns. Every turn gets the hash of its conversation's prefix up to it: the
exclusive-or of hashes of (position, role, text), 128 bits wide. A conversation whose last prefix is a proper prefix of any other conversation is a
snapshot; an anti-join drops it. Of equal conversations the one with the smallest conv_id stays. The rest are rendered.

No task needs a conversation's turns together before the rendering: positions and prefixes are added up within blocks of BLOCK turn numbers, and over
the blocks' sums. Exact copies and prefixes are aggregated before they are joined, so a first turn or a conversation that fills the log isn't a hot key.

Defined results: turns are ordered by turn number (null first), then role, then text; repeated rows are turns of their own; null roles and texts count as
empty; rows without conv_id belong to no conversation and give no row; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, table

BLOCK = 256


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position from 1, and the prefix hashes p1, p2 up to and x1, x2 of each turn."""
    turns = pick(turns, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 60))).alias("block"))
    keys = ["conv_id", "block"]
    inside = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = turns.withColumn("place", F.row_number().over(inside)).select(*keys, "place", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    placed = ranked.join(starts, keys).withColumn("position", F.col("start") + F.col("place"))
    placed = placed.select(*keys, "position", F.xxhash64("position", "a", "b").alias("x1"), F.xxhash64("b", "a", "position").alias("x2"))
    sums = placed.groupBy(*keys).agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = sums.select(*keys, *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")))
    running = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before, keys)
    return joined.select("conv_id", "position", *(F.bit_xor(f"x{i}").over(running).bitwiseXOR(F.col(f"s{i}")).alias(f"p{i}") for i in (1, 2)), "x1", "x2")


def maximal(turns: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that no other one continues."""
    # Written once, as hashes only: it is read for the ends and for what is continued.
    nodes = (scratch or Scratch(turns.sparkSession)).keep(prefixes(turns, block), "prefixes")
    last = F.max_by(F.struct("p1", "p2"), "position")
    ends = nodes.groupBy("conv_id").agg(F.max("position").alias("n_turns"), last.alias("p")).groupBy("n_turns", "p").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    continued = nodes.filter("position > 1").select((F.col("position") - 1).alias("n_turns"), F.struct(F.col("p1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("p2")).alias("p")).distinct()
    return ends.join(continued, ["n_turns", "p"], "left_anti").select("conv_id", "n_turns", "copies")


def rendering(role: str | Column, text: str | Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of the maximal conversations."""
    scratch = Scratch(turns.sparkSession)
    kept = scratch.keep(maximal(turns, block, scratch), "kept")
    scratch.only("kept")
    rows = pick(turns, "conv_id", "turn", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")
    parts = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    # A conversation's text is one value of the result, so its turns must come together here.
    ordered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    lines = F.transform("ts", lambda t: rendering(t["role"], t["text"]))
    return kept.join(ordered.select("conv_id", F.array_join(lines, "").alias("rendered")), "conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS pref FROM r),
ends AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, pref FROM p WHERE pos = n GROUP BY n, pref),
kept AS (SELECT * FROM ends WHERE pref NOT IN (SELECT pref FROM p WHERE pos < n))
SELECT k.conv_id, k.n_turns, k.copies,
       string_agg('<|im_start|>' || r.role || chr(10) || r.text || '<|im_end|>' || chr(10), '' ORDER BY r.pos) AS rendered
FROM kept k JOIN r USING (conv_id) GROUP BY k.conv_id, k.n_turns, k.copies
"""
