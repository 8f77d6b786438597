import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import jaccard
from brindle.llm.shingles import shingles


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, set_of(t)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            shared = len(s & t)
            if s and t and 100 * shared >= 75 * (len(s) + len(t) - shared):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((i, len(set_of(t)), None if i is None else find(i)) for i, t in rows), key=key)


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdé", k=draw.randint(1, 4))) for _ in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = draw.random()
        if kind < 0.6 and texts:
            w = list(draw.choice(texts))
            for _ in range(draw.choice([0, 1, 2, 3, 5, 9])):
                if w:
                    p = draw.randrange(len(w))
                    w[p : p + draw.randint(0, 1)] = [draw.choice(vocabulary)] * draw.randint(0, 2)
        else:
            w = [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 3, 4, 5, 6, 20, 60, 200, 700]))]
            if draw.random() < 0.5:
                w = w + passage
        texts.append(w)
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(x.upper() if draw.random() < 0.2 and x.isascii() else x for x in w)))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n int, TEXT string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(500, None), (501, ""), (502, " \n"), (None, "a b c d e f"), (503, "a b c d e f"), (503, "a b c d e f"), (503, "u v w x y z"), (507, "u v w x y z"), (508, "one of its kind here now"), (508, "and another one of its own"), (504, "q"), (505, "Q"), (506, "w " * 30000)]
    assert result(spark, rows) == brute(rows)


def test_common_words_come_last_and_links_stay(spark, monkeypatch):
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(40))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 150, 3)]
    assert result(spark, rows) == brute(rows)


def test_empty_and_unlinked(spark):
    assert result(spark, [(1, "a b c d e"), (2, "f g h i j k")]) == [(1, 1, 1), (2, 2, 2)]
    assert result(spark, [(3, "a b c d e"), (3, "f g h i j k"), (2, "f g h i j k")]) == [(2, 2, 2), (3, 1, 2), (3, 2, 2)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=60), min_size=1, max_size=6))
def test_set_sizes(texts):
    assert [len(s) for s in shingles([t.encode() for t in texts])] == [len(set_of(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_linked_sets_list_a_piece_in_common(shared, only_x, only_y, seed):
    draw = np.random.default_rng(seed)
    numbers = np.unique(draw.integers(0, 2**63, shared + only_x + only_y, np.uint64))
    draw.shuffle(numbers)
    x, y = np.unique(numbers[: shared + only_x]), np.unique(np.concatenate([numbers[:shared], numbers[shared + only_x :]]))
    level = lambda s: (s % np.uint64(5)).astype(np.uint8)
    if jaccard.links(x, y):
        of_x, of_y = (dict(zip(k.tolist(), e.tolist())) for k, e in (jaccard.pieces(s, level(s)) for s in (x, y)))
        assert any(of_x[k] >= len(y) and of_y[k] >= len(x) for k in of_x.keys() & of_y.keys())
        assert jaccard.may_link(len(x), len(y), jaccard.hamming(jaccard.sketch(x), jaccard.sketch(y)))
    assert jaccard.hamming(jaccard.sketch(x), jaccard.sketch(y)) <= len(np.setxor1d(x, y))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus(4, 60) + [(None, "a b c d e f"), (700, ""), (700, "")]
    docs = frame(spark, rows)
    kept = jaccard.stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = [c for i, _, c in brute(rows) if i is not None and c == i]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_stage_keeps_unlike_texts_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, "a b c d e f g"), (1, "u v w x y z q"), (1, "u v w x y z q"), (2, "U v w  x y z q"), (3, "one of its kind here now"), (4, long), (5, long + " more"), (None, "a b c d e f g"), (6, None), (6, None)]
    found = [sorted(((r.doc_id, r.text) for r in jaccard.stage(spark, frame(spark, rows).repartition(n), "").collect()), key=repr) for n in (1, 6)]
    assert found[0] == found[1]
    # The text of ids 1 and 2 stays once: which of them comes first is told by the hash that stands for the repeated id.
    alike = [(i, t) for i, t in found[0] if t and t.lower().split() == "u v w x y z q".split()]
    assert len(alike) == 1
    rest = [r for r in found[0] if r not in alike]
    assert sorted(rest, key=repr) == sorted([(1, "a b c d e f g"), (3, "one of its kind here now"), (4, long), (None, "a b c d e f g"), (6, None), (6, None)], key=repr)


def test_stage_takes_the_least_of_equal_rows_whatever_its_columns_are_called(spark):
    rows = [(1, "a b c d e f", "z", 5), (1, "a b c d e f", "y", 6), (2, "k l m n o p", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, DOC_ID long")
    assert sorted(map(tuple, jaccard.stage(spark, docs, "").collect())) == [rows[1], rows[2]]
    plain = spark.createDataFrame(rows[1:], docs.schema)
    assert sorted(map(tuple, jaccard.stage(spark, plain, "").collect())) == rows[1:]
    assert jaccard.stage(spark, docs.limit(0), "").count() == 0


def test_query(spark, tmp_path):
    rows = corpus(5, 50)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = jaccard.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == brute(rows)
