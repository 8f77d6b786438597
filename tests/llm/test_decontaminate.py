import random
import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import decontaminate as d


def least(item, text):
    """Least edit distance between an item and any substring of a text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def brute(items, text, rate):
    text = d.normal(text)
    out = {}
    for _, item in items:
        if (item := d.normal(item)) and text and (x := least(item, text)) <= int(rate * len(item)):
            out[item] = x
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab ", min_size=1, max_size=40), st.text("ab ", max_size=60), st.sampled_from([0.0, 0.1, 0.25, 0.4]))
def test_against_brute_force(item, text, rate):
    items = [(1, item)]
    assert d.Matcher(items, rate).find(text) == brute(items, text, rate)


def test_edited_passages():
    draw = random.Random(1)
    make = lambda n: " ".join("".join(draw.choices("etaoinshr", k=draw.randint(1, 7))) for _ in range(n))
    items = [(i, make(draw.randint(3, 40))) for i in range(12)]
    for _ in range(60):
        _, item = draw.choice(items)
        w = list(item)
        for _ in range(draw.randint(0, 2 + len(w) // 8)):
            p = draw.randrange(len(w))
            w[p : p + draw.randint(0, 1)] = draw.choice(["", "x", "é"])
        text = make(30) + "\n " + "".join(w).upper() + "  " + make(30) + " " + item[: len(item) // 2]
        assert d.Matcher(items, 0.1).find(text) == brute(items, text, 0.1)


def test_pieces_are_budget_plus_one():
    item = "a" * 97
    for k in range(0, 20):
        parts = sorted((x.start, x.end) for x in d.leaves(item, k))
        assert len(parts) == k + 1 and parts[0][0] == 0 and parts[-1][1] == 97 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int"


def test_rows_and_stage(spark):
    passage = "the quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(1, passage), (2, passage.upper()), (3, None), (4, " "), (5, "never seen anywhere at all, this one")], "item_id long, text string")
    rows = [(1, "well " + passage), (2, None), (3, ""), (None, passage), (4, "x" * 200000 + passage.replace("quick", "quikc")), (5, passage), (5, passage), (6, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.item_id, r.distance) for r in d.matches(docs, items).collect()))
    assert got == sorted([(i, k, x) for i, x in ((0, 0), (1, 0), (4, 2), (5, 0), (5, 0)) for k in (1, 2)])
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6]
    assert d.matches(docs, items.limit(0)).count() == 0 and d.clean(docs, items.limit(0)).count() == 8
    assert d.matches(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 100)
    items = spark.createDataFrame([(i, f"item number {i} with words of its own") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so item number {i} with words of its own it is") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in d.clean(docs, items.filter("item_id < 15"), 0.0).collect()} == {i for i in range(20) if not any(f"item number {j} with" in f"item number {i} with" for j in range(15))}
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, items, 0.0).collect()}
    assert got == {(i, j) for i in range(20) for j in range(20) if f"item number {j} with" in f"item number {i} with"}


def test_short_items_are_found_anywhere_or_as_words_only():
    items = [(1, "a"), (2, "cat sat"), (3, "the cat sat on"), (4, "Cat"), (5, "\u72ac")]
    m = d.Matcher(items, d.RATE)
    assert m.find("\u732bcat\u72ac") == {"a": 0, "cat": 0, "\u72ac": 0} and m.find("concat sats") == {"a": 0, "cat": 0, "cat sat": 0}
    m = d.Matcher(items, d.RATE, short=10)
    assert m.find("banana cataract") == {} and m.find("concat sats") == {} and m.find("A banana") == {"a": 0}
    assert m.find("the cat sat!") == {"cat": 0, "cat sat": 0} and m.find("xxthe cat saton") == {"cat": 0, "the cat sat on": 1}


def test_a_full_block_takes_little_memory():
    code = """
import random, resource
from brindle.llm import decontaminate as d
draw, items, size = random.Random(1), [], 0
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
while size < d.BLOCK:
    items.append((len(items), " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 9))) for _ in range(36))))
    size += len(items[-1][1])
m = d.Matcher(items, d.RATE)
assert m.find(items[7][1]) == {d.normal(items[7][1]): 0}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    taken = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert taken < 300


def test_clashing_names_and_query(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, "x " + passage, 2, "f"), (2, "clean", 3, "g")], "doc_id long, text string, DOC_ID long, found string")
    items = spark.createDataFrame([(7, passage, 1)], "item_id long, text string, TEXT int")
    assert [tuple(r) for r in d.clean(docs, items).collect()] == [(2, "clean", 3, "g")]
    spark.createDataFrame([(1, "x " + passage, "f"), (2, "clean", "g")], "doc_id long, text string, found string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = d.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "item_id", "distance", "length"] and [tuple(r) for r in out.collect()] == [(1, 7, 0, len(passage))]
