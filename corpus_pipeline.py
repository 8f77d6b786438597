"""From documents to token ids: toxic documents go, then those whose language isn't told, then all but one of each group of near duplicates, then those that hold a
benchmark item; the rest are encoded.

Each stage is an operator of brindle.llm and takes (spark, docs, sf_dir). run() writes each stage's result as Parquet in the shared folder and reads it again; what a stage wrote on the way is
dropped.

Defined results: texts are read whole, however long. A null or empty text isn't toxic, but has no language, so it goes at the second stage, as do texts without a letter. Rows without a
doc_id are judged like others and never count as copies. Of rows of one text, or of linked texts, the one with the least doc_id stays; rows that share a doc_id, but not a text, are
documents of their own. All stages but the last keep all columns, also those whose names differ in case only or are names of the stages' own results; the last gives doc_id, lang, source, ids
and n_tokens, whatever else there is. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import byte_bpe, decontaminate, jaccard, language_id, toxicity
from brindle.llm.common import Scratch, passing, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", language_id.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: The stages' classifiers, sketches and tokenizer can't be told in SQL; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
