import random

import numpy as np
import pytest

from brindle.llm import toxicity

INSULTS = ["idiot", "moron", "worthless", "pathetic", "scum", "dummkopf"]


def corpus(n, seed):
    draw = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(["the", "and", "in", "er", "on", "at", "to", "ed", "sh", "wh"], k=draw.randint(1, 3))) for _ in range(draw.randint(3, 60))]
        if bad := i % 4 == 0:
            words[draw.randrange(len(words))] = draw.choice(INSULTS)
        texts.append(" ".join(words).capitalize() + ".")
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*corpus(600, 1))


def scores(model, texts):
    return [model.probability(v) for v in toxicity.Scorer(model).values(texts)]


def test_held_out_accuracy(model):
    texts, labels = corpus(400, 2)
    found = np.array(scores(model, texts)) >= toxicity.THRESHOLD
    assert (found == np.array(labels, bool)).mean() > 0.99


def test_gaps_and_inserted_characters(model):
    assert all(x >= 0.7 for x in scores(model, ["You i.d.i.o.t!", "so w o r t h l e s s", "what a worthlesss thing", "MORON.", "wortxhless", "path.etic", "m0r0n", "mo ron", "w0rthle55", "the and pathqetic in on"]))
    assert all(x < 0.3 for x in scores(model, ["The and in.", "", None, "%%% ***", "a b c", "これは日本語の文章です", "---\n***", "Сегодня хорошая погода"]))


def test_inserted_characters_cost_less_than_other_words(model):
    near = toxicity.Scorer(model).values(["wxoxrxtxhxlxexsxs", "wxortxhlexss", "pxathextixc", "ixdixot"])
    far = toxicity.Scorer(model).values(["thandshinged", "onerattoed", "whinerand", "xxxxxx", "qzqzqz"])
    assert min(near) > max(far) + 0.3


def test_the_sentence_counts():
    """A word of toxic and of clean sentences is told by its sentence."""
    draw = random.Random(7)
    filler = lambda n: " ".join("".join(draw.choices(["the", "and", "in", "er", "on", "at"], k=2)) for _ in range(n))
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        own = "you really are pure trash" if toxic else "please take out the trash" if i % 3 == 1 else "please take out the garden hose"
        texts.append(f"{filler(12)}. {own}. {filler(12)}.")
        labels.append(int(toxic))
    model = toxicity.train(texts, labels)
    assert min(scores(model, ["You really are pure trash."])) >= 0.7 and max(scores(model, ["Please take out the trash.", filler(12)])) < 0.3


def test_all_at_once_is_what_sentences_says():
    draw, weights = random.Random(2), np.random.default_rng(1)
    model = toxicity.Model(*(weights.normal(size=1 << toxicity.BUCKETS_LOG).astype(np.float32) for _ in range(2)), -1.0, 1.0, 0.0)

    def plain(text):
        tokens = toxicity.tokens_of(text)
        own = lambda t: max(toxicity.weigh(u, model.weights)[0]) if (u := toxicity.units_of(t)) else -np.inf
        mean = lambda ts: sum(v := [np.mean(toxicity.weigh(u, model.context)[0]) for t in ts if (u := toxicity.units_of(t))]) / max(1, len(v))
        best = max((max(map(own, a + b)) + mean(a) for a, b in toxicity.sentences(tokens, [toxicity.Token.of(t) for t in tokens])), default=-np.inf)
        return best + model.bias if np.isfinite(best) else -1.0

    texts = [None, "", "  ", "a b c", "a. b. c", "w o r t h l e s s x", "%% ** -", "x" * 80 + " yy", "one\n\ntwo lo ser stu pid"]
    for _ in range(60):
        texts.append("".join(draw.choice(["lo", "ser", "a", "b", "the", "idiot", "W0rd", "&&", "long" * draw.randint(1, 12), "x."]) + draw.choice([" ", " ", " ", "  ", ". ", "\n", "! ", " \r\n", ".\n"]) for _ in range(draw.randint(0, 150))))
    assert np.allclose(toxicity.Scorer(model).values(texts), list(map(plain, texts)), atol=1e-6)
    assert [len(a) for a, _ in toxicity.sentences(["w"] * 70, [toxicity.Token.of("w")] * 70)] == [32, 32, 32, 22]


def test_probabilities_are_calibrated_on_texts_set_aside(model):
    texts, labels = corpus(800, 9)
    p = np.array(scores(model, texts))
    assert abs(p.mean() - np.mean(labels)) < 0.05


def test_weights_equal_the_kernel_expansion():
    units, marks = ["idiot", "id", "worthless"], ["idiot", "idxot", "zz"]
    dense = toxicity.kernel(units, marks)
    for j, mark in enumerate(marks):
        weights = np.zeros(1 << toxicity.BUCKETS_LOG)
        for _, bucket, x in toxicity.features([mark]):
            np.add.at(weights, bucket, x)
        assert np.allclose(toxicity.weigh(units, weights)[0], dense[:, j], atol=1e-5)


def test_kernel_against_brute_force():
    def phi(word):
        word, out = f"\2{word}\3", {}
        for offsets, weight in toxicity.PATTERNS:
            for i in range(len(word) - offsets[-1]):
                key = tuple(word[i + o] for o in offsets)
                out[key] = out.get(key, 0) + weight
        own = sum(max(0, len(word) - o[-1]) * w * w for o, w in toxicity.PATTERNS)
        return {k: v / own**0.5 for k, v in out.items()}

    for a, b in (("idiot", "idxiot"), ("abc", "xyz"), ("aaaa", "aab")):
        want = sum(v * phi(b).get(k, 0) for k, v in phi(a).items())
        assert abs(toxicity.kernel([a], [b])[0, 0] - want) < 1e-4


def test_odd_rows(spark, model):
    long = "the and " * 40000
    rows = [(1, None), (2, ""), (None, "you idiot"), (4, long), (5, long + "moron"), (5, long + "moron"), (6, "x" * 9000)]
    df = spark.createDataFrame([(i, t, "a", 0.5) for i, t in rows], "doc_id long, text string, predicted string, TEXT double")
    out = {(r.doc_id, r.predicted) for r in toxicity.score(df, model).collect()}
    assert out == {(1, 0), (2, 0), (None, 1), (4, 0), (5, 1), (6, 0)}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}


def test_sample_leaves_out_the_held_out_fold(spark):
    from zlib import crc32

    texts, labels = corpus(60, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got, _ = toxicity.sample(docs, marks)
    assert sorted(got) == sorted(t for i, t in enumerate(texts) if crc32(str(i).encode()) % 3 != 1)
    assert toxicity.train(*toxicity.sample(docs, marks.limit(0))) is None


def test_query(spark, tmp_path):
    """Folds and columns of the registered query; the fold held out is told from the others' labels."""
    from zlib import crc32

    texts, labels = corpus(450, 5)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", "en"), (None, "the and", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, predicted string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert all(r.held_out == (i is not None and crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [(found[i].predicted, y) for i, y in enumerate(labels) if found[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert found[900].score == found[901].score and found[900].predicted == 0
