"""Mining against all pairs in plain Python, and the registered query against its SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import negatives
from tests.llm.oracle import both

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, asked, positives=5, count=3, low=50, high=95):
    """All rows of the result, from all products."""
    whole = []
    for name, x, label in rows:
        if name is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        y = [math.floor(v * 256) for v in x]
        if sum(v * v for v in y) < 1 << 62:
            whole.append((name, y, label))
    out, done = [], set()
    for a in whole:
        if not asked(a[0]) or (mark := (a[0], tuple(a[1]), a[2])) in done:
            continue
        done.add(mark)
        scored = [(-sum(p * q for p, q in zip(a[1], r[1])), r[0], r[2]) for r in whole if len(r[1]) == len(a[1])]
        near = sorted(r[:2] for r in scored if r[2] == a[2] and r[1] != a[0])[:positives]
        for p, name in near:
            hard = sorted(r[:2] for r in scored if r[2] != a[2] and low * -p <= 100 * -r[0] <= high * -p)[:count]
            out += [(a[0], name, k + 1, n, -p, -s) for k, (s, n) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every=5, **more):
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed,size,spread", [(1, 6, 1.0), (2, 33, 0.05), (3, 1, 4.0)])
def test_all_pairs_give_the_same(spark, monkeypatch, seed, size, spread):
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "BLOCK", 8 * size * 7)  # several blocks
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + pick.gauss(0, spread) for c in pick.choice(centres)], pick.randrange(4)) for i in range(240)]
    rows += [(300 + i, rows[i][1], (rows[i][2] + i) % 4) for i in range(20)]  # ties
    want = plain(rows, lambda n: n % 5 == 0)
    assert len(want) > 100
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "EXACT", 3)
    assert mined(spark, rows, positives=2, negatives=4, low=20, high=90) == plain(rows, lambda n: n % 5 == 0, 2, 4, 20, 90)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 2), (1, [1.0, 0.4], 1), (1, [1.0, 0.4], 1), (2, [0.7, 0.4], 2), (3, [0.7, 0.4], 3), (None, [1.0, 0.5], 1)]
    rows += [(5, None, 1), (10, [1.0, None], 1), (15, [nan, 1.0], 1), (20, [inf, 1.0], 1), (25, [1.0, 1.0], None), (30, [1e12, 1.0], 1), (35, [1e300, 1.0], 1)]
    rows += [(40, [], 1), (41, [], 1), (42, [], 2), (45, [1.0, 2.0, 3.0], 1), (46, [1.0, 2.0, 2.5], 1), (47, [1.0, 1.0, 2.5], 2), (50, [-1.0, -1.0], 1), (55, [0.0, 0.0], 9)]
    want = plain(rows, lambda n: n % 5 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows[-1:]) == [] and mined(spark, []) == []
    extra = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{SCHEMA}, slot int, VEC_ID string, y int")
    found = negatives.mine(extra, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_pairs_are_dropped_early_but_none_that_fits():
    pick = np.random.default_rng(3)
    y = np.floor(256 * pick.normal(size=(400, 24)) * np.linspace(3, 0.05, 24))
    turned = negatives.rotation(y[:100])
    assert np.allclose(turned.turn.T @ turned.turn, np.eye(24)) and 1 < len(turned.marks) <= 4
    anchors, scores = y[:50], (y[:50] @ y.T).astype(np.int64)
    limits = np.sort(scores, 1)[:, [-20]]
    scan = negatives.Scan(negatives.Task(np.arange(50), np.zeros(50, np.int64), anchors, limits, np.full((50, 1), 1 << 62), False, 3, turned))
    rows = y @ turned.turn, negatives.lengths(y @ turned.turn, turned.marks), np.sqrt((y**2).sum(1)), y.astype(np.int64)
    a, r = scan._left(np.arange(50), np.arange(400), rows)
    assert set(zip(*np.nonzero(scores >= limits))) <= set(zip(a, r))
    assert len(a) < 1.1 * 50 * 20


def test_query_gives_what_sql_gives(spark):
    found = negatives.query(spark, SF)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.schema["rank"].dataType.simpleString() == "int"
    got, want = both(spark, found, negatives.ORACLE, embeddings=spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert want and got == want
