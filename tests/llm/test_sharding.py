import random

import pytest

from brindle.llm import sharding

from .oracle import both

SCHEMA = "doc_id long, text string, depth int"


def rows(n=400):
    draw = random.Random(5)
    return [(i, "é" * draw.randint(0, 400), 1) for i in range(n)] + [(None, "a" * 50, 1), (None, None, 1), (n, "", 1), (n + 1, "x" * 9000, 1), (3, "again", 1)]


@pytest.mark.parametrize("limit", [600, 5000, 1 << 30])
def test_against_sql(spark, limit):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got, want = both(spark, sharding.shards(docs, limit), sharding.ORACLE.replace(str(sharding.LIMIT), str(limit)), documents=docs)
    assert got == want
    by = {}
    for r in sharding.shards(docs, limit).collect():
        by.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(x) <= limit or len(x) == 1 for x in by.values())


def test_rows_that_no_bit_splits(spark):
    docs = spark.createDataFrame([(7, "z" * 100, 1)] * 90 + [(i, "y" * 100, 1) for i in range(30)], SCHEMA)
    by = {}
    for r in sharding.shards(docs, 1000).collect():
        by.setdefault(r.shard, []).append(r.n_bytes)
    assert sum(map(len, by.values())) == 120 and max(map(sum, by.values())) <= 1000


def test_empty(spark):
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).count() == 0
