"""

questions: qid, id, question, expected_paths, expected_spans (null or array), expected_all (null or array of groups). hits: qid, rank from 1, path, start_line, end_line.
"""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_path, parse_span

DEPTH = 10
SCHEMA = "qid int, id string, kind string, question string, expected_paths array<string>, expected_spans array<string>, expected_all array<array<string>>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    return spark.createDataFrame([(i, q["id"], q.get("kind"), q["question"], q["expected_paths"], q.get("expected_spans"), q.get("expected_all")) for i, q in enumerate(rows)], SCHEMA)


def expected(questions: DataFrame) -> DataFrame:
    """qid, g and p: the expected files of each group of a question, by their normal paths. A question without groups has its expected files as the only one."""
    groups = questions.select("qid", F.posexplode(F.when(F.size("expected_all") > 0, F.col("expected_all")).otherwise(F.array("expected_paths"))).alias("g", "paths"))
    return groups.select("qid", "g", F.explode_outer("paths").alias("p")).select("qid", "g", normal_path("p").alias("p")).distinct()


def file_ranks(questions: DataFrame, hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """qid and file_rank: the rank by which every group of expected files has been hit, null if one never is. wanted(qid, g, p) tells the files where there are too many
    of them for an array in each question; a question that it doesn't have is never hit."""
    wanted = expected(questions) if wanted is None else wanted
    first = wanted.join(hits.select("qid", "rank", normal_path("path").alias("p")), ["qid", "p"]).groupBy("qid", "g").agg(F.min("rank").alias("r"))
    ranks = wanted.select("qid", "g").distinct().join(first, ["qid", "g"], "left").groupBy("qid")
    found = ranks.agg(F.when(F.bool_or(F.col("r").isNull()), None).otherwise(F.max("r")).alias("file_rank"))
    return questions.select("qid").join(found, "qid", "left")


def span_ranks(questions: DataFrame, hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """qid and span_rank: the first hit that overlaps an expected span; the file rank for questions without spans."""
    spanned = F.size(F.coalesce("expected_spans", F.array().cast("array<string>"))) > 0
    spans = questions.filter(spanned).select("qid", F.explode("expected_spans").alias("s")).select("qid", parse_span("s").alias("s")).select("qid", F.col("s.path").alias("p"), "s.first", "s.last")
    met = spans.join(hits.withColumn("p", normal_path("path")), ["qid", "p"]).filter("start_line <= last AND end_line >= first").groupBy("qid").agg(F.min("rank").alias("r"))
    own = questions.select("qid", spanned.alias("spanned")).join(met, "qid", "left").join(file_ranks(questions, hits, wanted), "qid")
    return own.select("qid", F.when(F.col("spanned"), F.col("r")).otherwise(F.col("file_rank")).alias("span_rank"))


def ranks(questions: DataFrame, hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    return questions.select("qid", "id").join(file_ranks(questions, hits, wanted), "qid").join(span_ranks(questions, hits, wanted), "qid")


def metrics(scored: DataFrame) -> DataFrame:
    """One row of recall, mean reciprocal rank and misses of ranks(qid, id, file_rank, span_rank), at file level and (fn_) at function level."""
    out = []
    for column, name in (("file_rank", ""), ("span_rank", "fn_")):
        r = F.col(column)
        out += [F.coalesce(F.avg(F.when(r <= n, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"{name}recall_{n}") for n in (5, 10)]
        out.append(F.coalesce(F.avg(F.coalesce(1 / r, F.lit(0.0))), F.lit(0.0)).alias(f"{name}mrr"))
        missed = F.when(r.isNull() | (r > 5), F.struct("qid", "id"))
        out.append(F.transform(F.sort_array(F.collect_list(missed)), lambda m: m["id"]).alias(f"{name}misses"))
    return scored.agg(*out)
