import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from brindle.llm import byte_bpe, decontaminate, language_id, toxicity

from .test_decontaminate import brute as found_items
from .test_jaccard import brute as components
from .test_language_id import SYLLABLES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw, rows, labels = random.Random(6), [], []
    items = [(i, " ".join("".join(draw.choices("etaoinshrdlu", k=6)) for _ in range(20))) for i in range(5)]
    for i in range(400):
        lang = draw.choice(list(SYLLABLES))
        w = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(5, 80))]
        if bad := i % 5 == 0:
            w[draw.randrange(len(w))] = draw.choice(["idiot", "moron", "worthless"])
        if i % 11 == 0:
            w += draw.choice(items)[1].split()
        rows.append((i, " ".join(w) + ".", lang))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, t + " more", k) for i, t, k in rows[:60]] + [(2000 + i, t, k) for i, t, k in rows[:30]] + [(3000, None, None), (3001, "", "en"), (3002, "12 34", "en"), (None, "the and of the", "en")]
    out = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}), out / "documents.parquet")
    pq.write_table(pa.table({k: pa.array([r[j] for r in labels], pa.int64() if j == 0 else pa.int32()) for j, k in enumerate(("doc_id", "quality", "toxic"))}), out / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}), out / "benchmark.parquet")
    return str(out), rows, items


def test_run_against_plain_stages(spark, folder):
    path, rows, items = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels))
    kept = [r for r in rows if model.probability(toxicity.Scorer(model).values([r[1]])[0]) < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(kept) < 200
    frame = spark.createDataFrame([(*r, "s", 1) for r in kept], docs.schema)
    told = language_id.train(*language_id.sample(frame))
    scores = [language_id.Scorer(told).score(r[1]) for r in kept]
    kept = [r for r, (_, _, rejected) in zip(kept, scores) if not rejected]
    component = {i: c for i, _, c in components([r[:2] for r in kept])}
    kept = [r for r in kept if r[0] is None or component[r[0]] == r[0]]
    kept = [r for r in kept if not found_items(items, r[1], decontaminate.RATE)]
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    want = sorted(((r[0] if r[0] is not None else -1), theirs.encode_ordinary(r[1])) for r in kept)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want and len(want) > 100


def test_stages_return_the_columns_of_documents(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), path).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
