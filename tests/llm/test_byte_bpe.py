import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
OWN = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    import numpy as np

    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab ", max_size=300) | st.text(alphabet="aé\n'll 1", max_size=200))
def test_agrees_with_tiktoken(text):
    assert ids_of(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000, "".join(random.Random(1).choices("abcdefgh", k=20000)), "日本語" * 3000])
def test_long_matches(text):
    assert ids_of(text) == THEIRS.encode_ordinary(text)


def test_queue_is_empty_after_a_match():
    OWN.merge(b"unbreakablewordsaaaa" * 10)
    assert not OWN.buckets and not any(OWN.low)


def test_digests_on_odd_rows(spark):
    texts = [None, "", "Hello  world, l'été!", "x" * 30000, "Hello  world, l'été!"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "z", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int")
    rows = {(r.doc_id): r for r in byte_bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        r, ids = rows[i if i != 3 else None], THEIRS.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(df, PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, tmp_path):
    texts = {1: "Hello  world, l'été!", 2: None, 3: "naïve\n\n 日本"}
    spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, N_TOKENS string").write.parquet(str(tmp_path / "documents.parquet"))
    out = byte_bpe.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = THEIRS.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
