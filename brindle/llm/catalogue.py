"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, chat, decontaminate, jaccard, language_id, licenses, media, negatives, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_sharding": sharding.query,
    "op3_toxicity": toxicity.query,
    "op4_licenses": licenses.query,
    "op5_media": media.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_warc": warc.query,
    "op8_chat": chat.query,
    "op9_jaccard": jaccard.query,
    "op10_language_id": language_id.query,
    "op11_negatives": negatives.query,
    "op12_simhash": simhash.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_sharding": sharding.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_negatives": negatives.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
