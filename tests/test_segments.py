"""The store's segments: what a run writes, folding, statistics kept by changes, snapshots, crashes and vacuuming."""

import os
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import keyword
from brindle.plans import indexing, search
from brindle.sources.store import BY_CHUNK, Store

SCHEMA = "path string, repo string, suffix string, sha256 string, size long, mtime double, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def found(spark, texts):
    rows = [(f"r/{name}.txt", "r", ".txt", None, len(t), 1.0, t) for name, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).withColumn("sha256", F.sha2("text", 256))


def written(root):
    """Bytes under each name of the store's folder."""
    size = lambda at: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs) if os.path.isdir(at) else os.path.getsize(at)
    return {name: size(os.path.join(root, name)) for name in os.listdir(root) if not name.startswith(".")} if os.path.isdir(root) else {}


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, store, texts):
    """The store has just what one made at once has, but for chunk ids; statistics and lists fit the postings, and searches give the same."""
    now, fresh = store.snapshot(), Store(spark, f"{store.root}-fresh-{random.random()}")
    indexing.index_files(fresh, found(spark, texts), ["hashing"])
    other = fresh.snapshot()
    of = lambda s, name, *columns: table(s.read(name).join(s.read("chunks").select("chunk_id", "path", "start_line"), "chunk_id").select("path", "start_line", *columns))
    assert table(now.known_files()) == table(other.known_files())
    assert of(now, "postings", "term", "field", "positions") == of(other, "postings", "term", "field", "positions")
    words = now.read("stems").select("word")
    assert words.count() == words.distinct().count()  # none is stemmed twice
    assert of(now, "lengths", "length") == of(other, "lengths", "length")
    assert of(now, "embeddings", "model", "vector") == of(other, "embeddings", "model", "vector")
    for name in BY_CHUNK:
        assert now.read(name).select("chunk_id").distinct().count() == len(now.read("chunks").collect())
    assert tuple(now.state["totals"]) == keyword.totals(now.read("lengths")) == tuple(other.state["totals"])
    df = lambda s: table(keyword.added_up(s.read("dictionary"), tuple(s.state["totals"]), whole=True).select("term", "field", "df"))
    assert df(now) == df(other) == table(now.read("postings").groupBy("term", "field").count())
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "kappa"), (2, "zeta theta iota txt")], "qid int, query string")
    hits = lambda s: table(search.search(search.open_store(s), queries, 5, "bm25").select("qid", "path", "start_line", F.round("score", 9)))
    assert hits(store) == hits(fresh)


def test_random_runs_give_what_one_run_gives(spark, tmp_path):
    pick, texts, store = random.Random(2), {}, Store(spark, str(tmp_path / "s"))
    text = lambda: "\n".join(" ".join(pick.choices(WORDS, k=6)) for _ in range(pick.choice([1, 3, 75])))
    seen = []
    for number in range(5):
        for name in pick.sample("abcdefgh", 6 if not number else 2):
            texts[name] = text()
        for name in pick.sample(sorted(texts), 0 if number < 2 else 1):
            del texts[name]
        indexing.index_files(store, found(spark, texts), ["hashing"])
        seen.append(len(store.state()["segments"]))
    check(spark, store, texts)
    assert max(seen) <= 4
    indexing.index_files(store, found(spark, {}), ["hashing"])
    assert all(store.read(t).count() == 0 for t in ("files", *BY_CHUNK)) and store.state()["totals"] == [0, 0]


def test_what_is_written_follows_the_change(spark, tmp_path):
    pick = random.Random(1)
    grown = {}
    for n in (40, 400):
        texts = {f"f{i}": " ".join(pick.choices(WORDS, k=400)) for i in range(n)}
        store = Store(spark, str(tmp_path / f"s{n}"))
        indexing.index_files(store, found(spark, texts), ["hashing"])
        before = written(store.root)
        texts["f1"] = "alpha beta"
        report = indexing.index_files(store, found(spark, texts), ["hashing"])
        assert (report["indexed"], report["unchanged"], report["chunks_total"]) == (1, n - 1, n)
        after = written(store.root)
        assert before.keys() <= after.keys() and all(after[k] == v for k, v in before.items())
        grown[n] = sum(v for k, v in after.items() if k not in before)
        assert len(store.state()["segments"]) == 2
    assert grown[400] < 1.3 * grown[40]


def test_folding():
    store, some = Store.__new__(Store), lambda *rows: {"segments": [{"rows": r, "chunks": r, "dead": d} for r, d in rows]}
    assert store.folding(some()) == store.folding(some((10, 0))) == 0
    assert store.folding(some((1000, 0), (10, 1))) == 0
    assert store.folding(some((1000, 0), (10, 0), (6, 0))) == 2
    assert store.folding(some((16, 0), (10, 0), (6, 0))) == 3
    assert store.folding(some((1000, 0), (10, 0), (1, 300))) == 3


def test_a_run_that_dies_blocks_nobody(spark, tmp_path, monkeypatch):
    store, texts = Store(spark, str(tmp_path / "s")), {"a": "alpha", "b": "beta"}
    indexing.index_files(store, found(spark, texts), ["hashing"])
    before = set(written(store.root))
    texts["c"] = "gamma"

    class Killed(BaseException):
        pass

    def die(*args, **more):
        raise Killed

    for step in ("publish", "remove"):
        with monkeypatch.context() as patch:
            patch.setattr(Store, step, die)
            with pytest.raises(Killed):
                indexing.index_files(store, found(spark, texts), ["hashing"])
        assert store.state()["version"] in (1, 2)
    indexing.index_files(store, found(spark, texts), ["hashing"])
    check(spark, store, texts)
    # What was left behind goes when it is old enough, and nothing else.
    left = set(written(store.root))
    store.vacuum()
    assert set(written(store.root)) == left and before < left
    store.vacuum(0)
    state = store.state()
    assert set(written(store.root)) == {f for s in state["segments"] for fs in s["tables"].values() for f in fs} | {f"VERSION-{state['version']:012d}"}
    check(spark, store, texts)


def test_a_failing_run_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    indexing.index_files(store, found(spark, {"a": "alpha"}), ["hashing"])
    before = set(written(store.root))
    with monkeypatch.context() as patch:
        patch.setattr(keyword, "dictionary", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            indexing.index_files(store, found(spark, {"a": "beta"}), ["hashing"])
    assert set(written(store.root)) == before


def test_a_snapshot_sees_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    indexing.index_files(store, found(spark, {"a": "alpha one", "b": "alpha two"}), ["hashing"])
    corpus, queries = search.open_store(store), spark.createDataFrame([(0, "alpha")], "qid int, query string")
    ask = lambda c: {r["path"] for r in search.search(c, queries, 5, "hybrid").collect()}
    first = ask(corpus)
    for texts in ({"c": "alpha three"}, {"c": "alpha four", "d": "alpha"}):
        indexing.index_files(store, found(spark, texts), ["hashing"])
        store.vacuum()
        assert ask(corpus) == first == {"r/a.txt", "r/b.txt"}
    assert ask(search.open_store(store)) == {"r/c.txt", "r/d.txt"}


def test_lists_hold_the_postings_and_large_ones_stay_in_their_rows_when_folded(spark, tmp_path, monkeypatch):
    """No table of postings is written; a large segment's lists lose their dead chunks without a shuffle, those of small ones are brought together."""
    pick, store = random.Random(3), Store(spark, str(tmp_path / "s"))
    texts = {f"f{i}": " ".join(pick.choices(WORDS, k=30)) for i in range(12)}
    indexing.index_files(store, found(spark, texts), ["hashing"])
    assert not [name for name in written(store.root) if name.startswith("postings")]
    plans, without = [], keyword.without
    with monkeypatch.context() as patch:
        patch.setattr("brindle.sources.store.SMALL", 5)
        patch.setattr(keyword, "without", lambda rows, dead: plans.append(without(rows, dead)) or plans[-1])
        texts |= {f"f{i}": "alpha beta" for i in range(3)} | {f"g{i}": "kappa" for i in range(4)}
        del texts["f11"]
        indexing.index_files(store, found(spark, texts), ["hashing"])
    assert len(store.state()["segments"]) == 1 and len(plans) == 1
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    lists = store.read("lists").collect()
    assert all(len(r["ids"]) == len(r["hits"]) == len(r["lengths"]) == len(r["positions"]) > 0 and r["hits"] == [len(p) for p in r["positions"]] for r in lists)
    check(spark, store, texts)


def test_postings_of_stores_made_before_are_read_and_folded(spark, tmp_path):
    """A segment with a table of postings, and lists without positions."""
    pick, store = random.Random(9), Store(spark, str(tmp_path / "s"))
    texts = {f"f{i}": " ".join(pick.choices(WORDS, k=9)) for i in range(6)}
    indexing.index_files(store, found(spark, texts), ["hashing"])
    now = store.snapshot()
    old = store.segment(now.state)
    for name in ("chunks", "lengths", "embeddings", "files", "dictionary", "postings"):
        old.put(name, now.read(name))
    old.put("lists", now.read("lists").withColumn("positions", F.lit(None).cast("array<array<int>>")))
    store.publish(old, instead=1)
    check(spark, store, texts)
    texts |= {f"g{i}": "alpha kappa" for i in range(5)}
    del texts["f1"]
    indexing.index_files(store, found(spark, texts), ["hashing"])
    assert len(store.state()["segments"]) == 1 and "postings" not in store.state()["segments"][0]["tables"]
    check(spark, store, texts)
