import random
from zlib import crc32

import numpy as np
import pytest

from brindle.llm import language_id

SYLLABLES = {"en": ["the", "and", "ing", "er", "th", "of"], "de": ["der", "und", "sch", "ung", "ä", "ü"], "fr": ["le", "que", "é", "eau", "ion", "ç"]}


def corpus(n, seed):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        text = " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(2, 40)))
        out.append((i, text + ".", lang))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(300, 1)
    return language_id.train([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(model):
    scorer = language_id.Scorer(model)
    rows = corpus(300, 2)
    assert sum(scorer.score(t)[0] == k for _, t, k in rows) / len(rows) > 0.97


def test_what_is_unlike_all_known_languages_is_rejected(model):
    scorer = language_id.Scorer(model)
    strange = ["これは日本語の文章です。とても長い文を書いています。", "Сегодня хорошая погода, и мы идём гулять в парк с друзьями.", "Zkw qpxjv mbwz kjx zzq wvk pkz jjm bwx qqk vmz"]
    assert all(scorer.score(t)[2] for t in strange)
    assert sum(scorer.score(t)[2] for _, t, _ in corpus(1000, 5)) <= 20
    assert 0.01 < model.temperature < 20 and model.least == language_id.LEAST


def test_confidence_is_calibrated():
    """Of texts with half of their words from another language, the likelier language is about as often right as its confidence says."""
    draw = random.Random(4)
    rows = []
    for i in range(1200):
        a, b = draw.sample(list(SYLLABLES), 2)
        words = ["".join(draw.choices(SYLLABLES[a if draw.random() < 0.7 else b], k=2)) for _ in range(3)]
        rows.append((" ".join(words), a))
    model = language_id.train([t for t, _ in rows[:900]], [k for _, k in rows[:900]])
    found = [(language_id.Scorer(model).score(t), k) for t, k in rows[900:]]
    assert abs(sum(x[1] for x, _ in found) / len(found) - sum(x[0] == k for x, k in found) / len(found)) < 0.1


def test_memo_equals_average_of_embeddings(model):
    import numpy as np

    text = "the under queue the"
    at = [r for w in text.split() for r in language_id.subwords(w)]
    z = (model.logits[at].mean(0) + model.bias) / model.temperature
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = language_id.Scorer(model).score(text)
    assert got[0] == model.languages[int(want.argmax())] and abs(got[1] - want.max()) < 1e-9


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 %% --"), (None, "the and of"), (5, "und der schung " * 30000), (6, "the" * 20000), (7, "the and"), (7, "the and")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, TEXT int")
    out = language_id.identify(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "de"), (6, "en"), (7, "en"), (7, "en")]
    assert all(r.rejected for r in out if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}


def test_sample_leaves_out_the_held_out_fold(spark):
    rows = corpus(80, 3)
    df = spark.createDataFrame([*rows, (900, "the", None), (None, "the", "en")], "doc_id long, text string, lang string")
    texts, found = language_id.sample(df)
    assert dict(zip(texts, found)).items() <= {(t, k) for _, t, k in rows}
    assert sorted(texts) == sorted(t for i, t, _ in rows if crc32(str(i).encode()) % 4 != 2)


def test_sample_is_bounded_however_often_an_id_or_language_is_there(spark, monkeypatch):
    from pyspark.sql import functions as F

    from brindle.llm.common import bounded_sample

    many = spark.range(20000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5000).cast("string")).alias("text"), F.lit("a").alias("y"))
    rows = many.unionByName(spark.createDataFrame([(i, f"rare {i}", "b") for i in range(30)] + [(1, None, "b"), (None, "x", "b"), (2, "x", None)], "doc_id long, text string, y string"))
    texts, y = bounded_sample(rows, 20, 5)
    assert y.count("a") == 20 and y.count("b") == 20 and len(set(texts)) == 40
    assert bounded_sample(rows, 20, 1)[1] == ["a"] * 20
    assert sum(len(t) for t in bounded_sample(rows, 20, 5, 60)[0]) <= 60
    assert bounded_sample(rows.limit(0), 20, 5) == ([], [])
    assert bounded_sample(rows, 20, 5) == bounded_sample(rows.repartition(7), 20, 5)


def test_query(spark, tmp_path):
    """Folds and columns of the registered query; the fold held out is told from the others' texts."""
    rows = corpus(400, 6) + [(900, None, "en"), (901, "12", None), (None, "the and of", "en")]
    spark.createDataFrame([(*r, "s", "x") for r in rows], "doc_id long, text string, lang string, source string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    out = language_id.query(spark, str(tmp_path))
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == len(rows) and found[900].lang_pred == found[901].lang_pred == "und"
    assert all(r.held_out == (i is not None and crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(found[i].lang_pred, k) for i, _, k in rows[:400] if found[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_new_words_are_summed_up_together():
    draw = np.random.default_rng(5)
    model = language_id.Model(["a", "b", "c"], draw.normal(size=(language_id.BUCKETS, 3)), np.zeros(3), 1.0, 0.0, np.full(language_id.SIZES, -np.inf))
    plane = "".join(chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000)
    for text in ("Größe e\u0301te\u0301 na\u00efve x\u00b2 2nd \u0301a _b_ \u0130I", plane, plane[:0x9000], "\U00010400bc d", "a" * 50_000 + " b"):
        words = language_id.WORD.findall(text.lower())
        assert language_id.words_of(text) == words
        memo = language_id._Memo(model)
        memo.add(list(dict.fromkeys(words)))
        for w in dict.fromkeys(words):
            at = language_id.subwords(w)
            assert np.allclose(memo.rows[memo[w]], [*model.logits[at].sum(0), len(at)], rtol=1e-9) and len(memo.rows) >= len(memo)
    ends = "<word>"
    grams = {ends, *(ends[i : i + n] for n in language_id.GRAMS for i in range(len(ends) - n + 1))}
    assert language_id.subwords("word") == [language_id.crc32(g.encode()) & (language_id.BUCKETS - 1) for g in sorted(grams)]
