"""Vector search by cells against all products."""

import numpy as np
import pytest

from brindle.operators import cells, vectors


def frames(spark, v, q):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    return df, spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "qid string, vector array<double>")


def ranked(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells_give_what_all_vectors_give(spark, tmp_path, spread):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    v = np.concatenate([c + spread * draw.normal(size=(60, 16)) for c in centres])
    v[100:110] = v[99]  # ties
    v[200] = 0
    q = np.concatenate([v[::90] + 0.01, draw.normal(size=(4, 16)), np.zeros((1, 16))])
    df, asked = frames(spark, v, q)
    held, told = cells.build(df, f"{tmp_path}/c", 24), []
    assert held.sizes.sum() == len(v) and len(held.names) <= 24
    for size in (1, 7, 2000):
        assert ranked(cells.search(held, asked, size, told=told)) == ranked(vectors.search(df, asked, size))
    assert ranked(cells.search(held, asked, 5, digits=2)) == ranked(vectors.search(df, asked, 5, digits=2))
    if spread < 1:
        near = asked.filter("qid < 'q7'")
        cells.search(held, near, 7, told=told)
        assert told[-1] < 0.5
    assert told[2] == 1.0


def test_cells_that_no_query_asks_for_are_not_read(spark, tmp_path):
    draw = np.random.default_rng(3)
    v = np.concatenate([c + 0.01 * draw.normal(size=(50, 8)) for c in 3 * np.eye(8)])
    df, asked = frames(spark, v, v[:1])
    held = cells.build(df, f"{tmp_path}/c", 8)
    found = cells.search(held, asked, 5)
    read = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line]
    assert read and all("cell" in line.split("PartitionFilters: [")[1].split("]")[0] for line in read)
    assert ranked(found) == ranked(vectors.search(df, asked, 5))


def test_odd_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "chunk_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "qid int, vector array<double>")
    held = cells.build(df, f"{tmp_path}/c")
    assert ranked(cells.search(held, asked, 3)) == [(1, 0, 1, 1.0), (1, 1, 3, 1.0)]
    assert cells.build(df.filter("vector IS NULL"), f"{tmp_path}/d") is None and cells.search(None, asked, 3).count() == 0
    with pytest.raises(ValueError):
        cells.search(held, spark.createDataFrame([(1, [1.0])], "qid int, vector array<double>"), 3)
