"""Fingerprints bit by bit, the covering for all changes within the radius, and groups by brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash
from brindle.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def plain(text):
    """The fingerprint, hash by hash and bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    made = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in made]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def groups(marks, radius=3):
    """The least index of each index's component, from all pairs."""
    marks, root = np.array(marks, np.uint64), list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in np.nonzero(np.bitwise_count(marks[i + 1 :] ^ marks[i]) <= radius)[0]:
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(marks))]


def expected(rows):
    marks = [plain(t) for _, t in rows]
    least = {}
    at = groups(marks)
    for (doc, _), g in zip(rows, at):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((doc, f"{m:016x}", least.get(g)) for (doc, _), m, g in zip(rows, marks, at)), key=str)


def test_fingerprints_bit_by_bit():
    for text in ["", " \t\n", "One", "one TWO", "one\x0btwo three", "ÀB İx é", "a " * 70_000, "x y z x y z x y z", "\x1f \x1c a", "word" * 1000 + " b c d"]:
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_change_within_the_radius_misses_some_mask(radius):
    found = simhash.masks(radius)
    assert len(set(found)) == (1 << radius + 1) - 1
    for k in range(1, radius + 1):
        for change in combinations(range(64), k):
            bits = sum(1 << i for i in change)
            assert any(bits & m == 0 for m in found)


@pytest.mark.parametrize("most", [2, 5, 128])
def test_links_connect_what_brute_force_connects(spark, most):
    pick = random.Random(most)
    centres = [pick.getrandbits(64) for _ in range(6)]
    marks = {0, (1 << 64) - 1, 1, 1 << 63}
    for centre in centres:
        for _ in range(60):
            marks.add(centre ^ sum(1 << i for i in pick.sample(range(64), pick.randrange(5))))
    marks = sorted(marks)
    scratch = Scratch(spark)
    nodes = scratch.keep(spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long"), "nodes")
    found = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(nodes, scratch, 3, most).collect()]
    assert found and all(0 < (u ^ v).bit_count() <= 3 for u, v in found)
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for u, v in found:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert [find(m) for m in marks] == [marks[g] for g in groups(marks)]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(5, None), (3, ""), (None, " "), (9, "one"), (9, "one"), (2, "ONE"), (None, "two words"), (7, long), (4, long + " end"), (8, "a b c d"), (8, "q r s t u")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, FP int, Component_id int")
    got = sorted((tuple(r) for r in simhash.join(docs).collect()), key=str)
    assert got == expected(rows)
    assert simhash.join(docs.filter("doc_id > 99")).collect() == []
    with pytest.raises(ValueError):
        simhash.join(docs, 0)


def test_rows_without_id_connect_others(spark, monkeypatch):
    marks = {"a": 0b0, "b": 0b111, "c": 0b111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    docs = spark.createDataFrame([(2, marks["a"]), (None, marks["b"]), (1, marks["c"])], "doc_id long, fp long")
    assert sorted(r["component_id"] for r in simhash.join(docs).collect()) == [1, 1, 1]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = simhash.query(spark, SF)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)
