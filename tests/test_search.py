import random
import sqlite3
import sys
import types
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluation, keyword, ranking, vectors
from brindle.plans import search as plans


def as_list(spark, ids, scores=None):
    return spark.createDataFrame([(0, i, float(s), r) for r, (i, s) in enumerate(zip(ids, scores or range(len(ids), 0, -1)))], "qid int, chunk_id long, score double, rank int")


def order(df):
    return [r.chunk_id for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("lists, k, weights, want", [([[1, 2, 3], [3, 1, 2]], 0, None, [1, 3, 2]), ([[10, 20], []], 0, None, [10, 20]), ([[100, 200], [300, 200]], 60, None, [200, 100, 300]), ([[1, 2], [2, 1]], 60, [0.5, 1.0], [2, 1])])
def test_fusion(spark, lists, k, weights, want):
    assert order(ranking.fuse([as_list(spark, x) for x in lists], k, weights)) == want


def paths(spark, of):
    return spark.createDataFrame(list(of.items()), "chunk_id long, path string")


def test_prior_and_cap(spark):
    both = paths(spark, {1: "a/tests/test_x.py", 2: "a/src/x.py"})
    assert order(ranking.with_prior(as_list(spark, [1, 2], [1.0, 0.8]), both)) == [2, 1]
    files = paths(spark, {1: "A", 2: "A", 3: "A", 4: "B"})
    ranked = ranking.with_prior(as_list(spark, [1, 2, 3, 4, 9]), files)
    assert order(ranking.capped(ranked, 10)) == [1, 2, 4] and order(ranking.capped(ranked, 2)) == [1, 2] and order(ranking.capped(ranked, 10, 1)) == [1, 4]


NAMES = {"red": 1, "blue": 2, "grey": 3, "gold": 4, "sand": 5}


@pytest.mark.parametrize("incoming, scores, head, k, want", [
    ("red blue grey gold sand", [0.6, 0.5, 0.4, 0.9, 0.0], 20, 9, "red gold blue grey sand"),
    ("sand grey gold", [0.4, 0.5, 0.9], 20, 9, "sand gold grey"),
    ("sand grey gold", [0.8, 0.1, 0.6], 1, 9, "sand grey gold"),
    ("red blue grey", [0.1, 0.5, 0.9], 20, 1, "red"),
])
def test_rerank(spark, incoming, scores, head, k, want):
    ids = [NAMES[n] for n in incoming.split()]
    relevance = spark.createDataFrame([(0, i, s) for i, s in zip(ids, scores)], "qid int, chunk_id long, relevance double")
    where = paths(spark, {i: f"src/{n}.py" for n, i in NAMES.items()})
    assert order(ranking.rerank(as_list(spark, ids), relevance, where, k, head)) == [NAMES[n] for n in want.split()]


def test_rerank_with_prior(spark):
    ids = [NAMES[n] for n in "sand grey gold".split()]
    relevance = spark.createDataFrame([(0, i, s) for i, s in zip(ids, [0.8, 0.1, 0.6])], "qid int, chunk_id long, relevance double")
    where = paths(spark, {5: "tests/sand.py", 3: "src/o.py", 4: "src/r.py"})
    assert order(ranking.rerank(as_list(spark, ids), relevance, where, 9)) == [5, 4, 3]


def test_bm25_against_sqlite(spark):
    draw = random.Random(3)
    vocabulary = ["alpha", "beta", "foo_bar", "foo", "bar", "Café", "cafe", "the", "zzz", "common", "naïve", "日本語", "²x", "HTTPServer"]
    rows = [(i, f"repo/src/{draw.choice(['retry', 'http', 'foo_bar'])}{i}.py", "repo", draw.choice(["Big.Class", "foo", "bar_baz"]), "function", " ".join(["common"] + draw.choices(vocabulary, k=draw.randint(0, 25)))) for i in range(1, 60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, repo string, symbol string, kind string, text string")
    index = keyword.build(chunks, stem=False)
    asked = ["alpha beta", "common", "foo_bar", "cafe common alpha", "___", "", "nothing here", "http retry function repo", "naive 日本語"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    found = {(r.qid, r.chunk_id): r.score for r in keyword.scores(index, queries, stem=False).collect()}
    from brindle.functions.text import header_tokens

    heads = {r.chunk_id: r.h for r in chunks.select("chunk_id", header_tokens("path", "symbol", "kind", "repo").alias("h")).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(header, body)")
    con.executemany("INSERT INTO f(rowid, header, body) VALUES (?, ?, ?)", [(r[0], heads[r[0]], r[5]) for r in rows])
    want = {}
    for qid, q in enumerate(asked):
        tokens = [t for t in dict.fromkeys(q.lower().split()) if t not in ("the", "here")]
        if tokens:
            match = " OR ".join(f'{f}:"{t}"' for f in ("header", "body") for t in tokens)
            want |= {(qid, i): -s for i, s in con.execute("SELECT rowid, bm25(f, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
    assert found.keys() == want.keys() and want
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_stems_from_a_dictionary_are_those_of_texts(spark):
    from brindle.functions.stemming import stemmed

    draw = random.Random(4)
    odd = ["running", "Runs", "the", "foo_bars", "__", "___init___", "_", "Бегущие", "бежали", "naïve's", "x²", "caf\u00e9s", "日本語", "don't", "and"]
    rows = [(i, "r/a.py", "r", "s", "function", draw.choice([" ", "\n", ", "]).join(draw.choices(odd, k=draw.randrange(30)))) for i in range(80)] + [(90, "r/b.py", "r", "s", "function", "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, repo string, symbol string, kind string, text string")
    want = keyword.postings(chunks.select("chunk_id", keyword.terms(stemmed("text")).alias("terms")))
    table = lambda df: sorted((r["chunk_id"], r["term"], tuple(r["positions"])) for r in df.collect())
    index = keyword.build(chunks)
    assert table(index.postings.filter("field = 'body'")) == table(want)
    lengths = {r["chunk_id"]: r["length"] for r in index.lengths.collect()}
    own = index.postings.groupBy("chunk_id").agg(F.sum(F.size("positions")).alias("n")).collect()
    assert lengths == {r["chunk_id"]: r["n"] for r in own} and len(lengths) == 81


def with_lists(index):
    rows, totals = keyword.lists(index).cache(), keyword.totals(index.lengths)
    return replace(index, lists=rows, dictionary=keyword.dictionary(rows, totals), totals=totals)


@pytest.mark.parametrize("repo", [None, "repo1"])
def test_bounded_search_gives_what_full_scores_give(spark, monkeypatch, repo):
    monkeypatch.setattr(keyword, "RANGE", 16)
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["foo_bar", "foo", "bar", "naïve", "naive"]
    rows = [(i, f"p{i % 9}/x{i}.py", f"repo{i % 3}", "s", "function", " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(65)], k=draw.choice([3, 30, 90])))) for i in range(0, 900, 3)]
    rows += [(1000 + i, "p/y.py", "repo1", "s", "function", "w1 w2 w3") for i in range(20)] + [(2000, "p/z.py", "repo1", "s", "function", "")]
    index = keyword.build(spark.createDataFrame(rows, "chunk_id long, path string, repo string, symbol string, kind string, text string"), stem=False)
    asked = [" ".join(draw.sample(vocabulary, k)) for k in (1, 2, 5, 12, 30)] + ["foo_bar", "foo_bar w0 w1", "w0", "repo1", "nothing", "", "naïve naive w40", "the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    bounded = with_lists(index)
    for size in (1, 7, 5000):
        get = lambda i: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 6)) for r in keyword.search(i, queries, size, repo, stem=False, digits=6).collect())
        want = get(index)
        assert want and get(bounded) == want
    monkeypatch.setattr(keyword, "HELD", 3)  # nothing is held by the driver
    assert get(bounded) == want


def test_bounded_search_opens_few_lists_of_frequent_terms(spark):
    from brindle.plans import carriers

    sf = "/root/testdata/sf0.1"
    made = keyword.build(carriers.chunks(spark, sf), stem=False)
    index = with_lists(replace(made, postings=made.postings.cache(), lengths=made.lengths.cache()))
    marked = keyword.Bounded(index, carriers.queries(spark, sf), 48, stem=False).marked()
    frequent = marked.filter(F.col("df") >= index.totals[0] / 10)
    found = frequent.agg(F.sum("df").alias("all"), F.sum(F.when(~F.col("closed"), F.col("df"))).alias("opened")).first()
    assert found["all"] > 2_000_000 and found["opened"] * 5 < found["all"]
    spark.catalog.clearCache()


def test_dense_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(1)
    v, q = vectors.unit(draw.normal(size=(200, 8))), vectors.unit(draw.normal(size=(7, 8)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid int, vector array<double>")
    out = {}
    for r in vectors.search(df, asked, 10).collect():
        out.setdefault(r.qid, {})[r["rank"]] = r.chunk_id
    for i in range(7):
        assert [out[i][r] for r in range(10)] == np.argsort(-(v @ q[i]), kind="stable")[:10].tolist()


def test_vectors_that_cant_be_compared(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 1.0])], "qid int, vector array<double>")
    assert sorted((r.qid, r.chunk_id, r["rank"]) for r in vectors.search(rows, asked, 1).collect()) == [(0, 1, 0), (2, 3, 0), (3, 1, 0), (4, 1, 0)]
    with pytest.raises(Exception, match="chunk 7 has 3 numbers"):
        vectors.search(rows.unionByName(spark.createDataFrame([(7, [1.0, 2.0, 3.0])], rows.schema)), asked, 1).collect()
    assert vectors.search(rows, asked.limit(0), 1).count() == 0 and vectors.search(rows.limit(0), asked, 1).count() == 0


def test_best_rows_are_kept_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 3).cast("int").alias("qid"), F.col("id").alias("chunk_id"), (F.col("id") % 17).cast("double").alias("score"))
    paths_ = spark.range(1000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("src/"), (F.col("id") % 9).cast("string")).alias("path"))
    for found in (keyword.pool(scored, 5), ranking.capped(ranking.with_prior(keyword.pool(scored, 5), paths_), 3), ranking.fuse([keyword.pool(scored, 5)])):
        assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_published_models_by_name(monkeypatch):
    """The libraries aren't at hand: stand-ins with their interfaces show what is asked of them."""
    asked = []
    made = lambda **parts: type("M", (), {"__init__": lambda self, *a, **k: asked.append((a, k)), **parts})
    modules = {
        "sentence_transformers": {"SentenceTransformer": made(encode=lambda self, texts, **k: [[3.0, 4.0]] * len(texts)), "CrossEncoder": made(predict=lambda self, pairs, **k: [float(len(p)) for _, p in pairs])},
        "torch": {"nn": type("N", (), {"Identity": object})},
        "fastembed": {"TextEmbedding": made(embed=lambda self, texts, batch_size: ([float(batch_size), 0.0] for _ in texts))},
        "fastembed.rerank": {},
        "fastembed.rerank.cross_encoder": {"TextCrossEncoder": made(rerank=lambda self, q, ps, batch_size: [len(q) + len(p) for p in ps])},
    }
    for name, parts in modules.items():
        module = types.ModuleType(name)
        module.__dict__.update(parts)
        monkeypatch.setitem(sys.modules, name, module)
    assert vectors.factory_of("hashing")().embed(["a"]).shape == (1, 64)
    assert vectors.factory_of("x/multilingual-e5-large@st-cuda")().embed(["a", "b"]).tolist() == [[3.0, 4.0]] * 2 and asked[-1] == (("x/multilingual-e5-large",), {"device": "cuda"})
    assert [vectors.factory_of(n)().embed(["a"])[0][0] for n in ("x/bge-small", "x/e5", "other")] == [32, 16, 16]
    assert ranking.scorer("x/reranker@st-cuda")(["q", "q"], ["a", "bb"]) == [1.0, 2.0] and asked[-1][1]["max_length"] == 512
    n = len(asked)
    assert ranking.scorer("x/mini")(["q", "rr", "q"], ["a", "b", "ccc"]) == [2.0, 3.0, 4.0] and ranking.scorer("x/mini")(["q"], ["a"]) == [2.0] and len(asked) == n + 1
    assert ranking.scorer("x/mini")([], []) == []
    ranking.register_scorer("mine", lambda: lambda queries, passages: [0.5] * len(queries))
    assert ranking.scorer("mine")(["a"], ["b"]) == [0.5] and ranking.scorer("overlap")(["big cats"], ["a big cat"]) == [3.0]
    ranking.unload_scorers()
    vectors.unload()


def test_models():
    assert vectors.parse_model("a/b@st-cuda") == ("a/b", "cuda") and vectors.parse_model("a/b") == ("a/b", "cpu")
    assert vectors.prefix("x/multilingual-e5-large@st-cuda", True) == "query: " and vectors.prefix("x/e5", False) == "passage: " and vectors.prefix("bge", True) == ""
    assert (vectors.unit(np.zeros((1, 3))) == 0).all()
    vectors.unload()


Q = {"expected_paths": ["r/a.py", "r/b.py"], "expected_spans": ["r/a.py:100-120"], "expected_all": None}


@pytest.mark.parametrize("question, hits, file_rank, span_rank", [
    (Q, [("r/x.py", 1, 9), ("r/b.py", 1, 9), ("r/a.py", 1, 9)], 2, None),
    (Q, [("r/a.py", 1, 50), ("r/b.py", 100, 120), ("r/a.py", 110, 130)], 1, 3),
    (Q, [("r/a.py", 90, 200)], 1, 1),
    (Q | {"expected_paths": ["r/a.py"], "expected_spans": None}, [("r/x.py", 1, 2), ("R\\A.py", 1, 2)], 2, 2),
    (Q | {"expected_spans": None, "expected_all": [["r/a.py"], ["r/b.py", "r/c.py"]]}, [("r/c.py", 1, 2), ("r/x.py", 1, 2), ("r/a.py", 1, 2)], 3, 3),
    (Q | {"expected_spans": None, "expected_all": [["r/a.py"], ["r/b.py", "r/c.py"]]}, [("r/c.py", 1, 2), ("r/b.py", 1, 2)], None, None),
    (Q | {"expected_spans": [], "expected_all": []}, [("r/x.py", 1, 9), ("r/b.py", 1, 9)], 2, 2),
])
def test_ranks_and_metrics(spark, question, hits, file_rank, span_rank):
    qs = spark.createDataFrame([(0, "q", None, "?", question["expected_paths"], question["expected_spans"], question["expected_all"])], evaluation.SCHEMA)
    hs = spark.createDataFrame([(0, i + 1, *h) for i, h in enumerate(hits)], "qid int, rank int, path string, start_line int, end_line int")
    scored = evaluation.ranks(qs, hs)
    row = scored.first()
    assert (row.file_rank, row.span_rank) == (file_rank, span_rank)
    m = evaluation.metrics(scored).first()
    assert m.recall_5 == float(file_rank is not None) and m.mrr == (1 / file_rank if file_rank else 0) and m.fn_misses == ([] if span_rank else ["q"])


def test_unknown_mode():
    with pytest.raises(ValueError):
        plans.search(None, None, mode="nope")


def test_whole_items_are_asked(spark):
    import __spark_entry__
    from brindle.plans import carriers, catalogue

    sf_dir = __spark_entry__.SMOKE_DIR
    texts = {r.item_id: r.text for r in carriers.table(spark, sf_dir, "benchmark").collect()}
    assert {r.qid: r["query"] for r in carriers.queries(spark, sf_dir).collect()} == texts
    assert {(r.qid, r.chunk_id) for r in __spark_entry__.entry(spark).collect()} == {(r.qid, r.chunk_id) for r in catalogue.QUERIES["hybrid_topk"](spark, sf_dir).collect()}


def test_statistics_have_every_term_and_field(spark):
    import __spark_entry__
    from brindle.plans import carriers, catalogue

    rows = catalogue.QUERIES["bm25_stats"](spark, __spark_entry__.SMOKE_DIR).collect()
    terms = {(r.field, r.term): r.df for r in rows}
    assert len(terms) == len(rows) and {f for f, _ in terms} == {"header", "body"} and min(terms.values()) == 1
    n = carriers.table(spark, __spark_entry__.SMOKE_DIR, "documents").count()
    assert terms["header", "window"] == n and all(r.n_chunks == n for r in rows)


def test_the_index_is_built_once_and_searches_read_it(spark):
    import __spark_entry__
    from brindle.plans import carriers, catalogue

    store = carriers.stored(spark, __spark_entry__.SMOKE_DIR, stem=False)
    version = store.state()["version"]
    plan = catalogue.QUERIES["bm25_topk"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert store.state()["version"] == version and "documents.parquet" not in plan and "ArrowEvalPython" not in plan


def test_postings_are_inverted_without_a_shuffle_of_terms(spark, monkeypatch):
    """A row of lengths with each posting, blocks of few words, and texts whose letters change in lower case."""
    monkeypatch.setattr(keyword, "BLOCK", 7)
    monkeypatch.setattr(keyword, "RANGE", 4)
    texts = ["İstanbul Åre ÉCOLE école", "", "a1 b_c ΑΣ'Α ΟΔΟΣ straße", "x " * 30, "日本語 ²x Ǆ ﬁn ẞ", "Kİ̇ é é", "___"]
    rows = [(i * 3, f"p/{i}.py", "r", "s", "window", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, repo string, symbol string, kind string, text string")
    plain = F.translate("text", "".join(a for a, _ in keyword._MARKED), "".join(b for _, b in keyword._MARKED))
    want = keyword.postings(chunks.select("chunk_id", F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1).alias("terms")))
    index = keyword.build(chunks, stem=False)
    table = lambda df: sorted((r["chunk_id"], r["term"], tuple(r["positions"])) for r in df.collect())
    assert table(index.postings.filter("field = 'body'")) == table(want)
    made = keyword.inverted(chunks, stem=False)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()  # terms aren't shuffled
    lengths = {r["chunk_id"]: r["length"] for r in index.lengths.collect()}
    assert len(lengths) == len(rows) and all(lengths[r["chunk_id"]] == r["length"] for r in made.collect())
    held = {(r["term"], r["field"], i, h, n) for dealt in (True, False) for r in keyword.lists(index, dealt).collect() for i, h, n in zip(r["ids"], r["hits"], r["lengths"]) if i // 4 == r["range"]}
    assert held == {(r["term"], r["field"], r["chunk_id"], len(r["positions"]), r["length"]) for r in made.collect()}


def test_results_are_worked_out_once(spark):
    """What follows a search reads its rows, not the index again."""
    chunks = spark.createDataFrame([(i, f"p{i}.py", "r", "s", "window", f"w{i % 3} w{i}") for i in range(9)], "chunk_id long, path string, repo string, symbol string, kind string, text string")
    found = keyword.search(with_lists(keyword.build(chunks, stem=False)), spark.createDataFrame([(0, "w1 w2")], "qid int, query string"), 3, stem=False)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [0, 1, 2]


def test_scores_are_added_up_by_ranges_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Blocks of few queries, dead chunks, a query without a number, and ties at the end of the list."""
    monkeypatch.setattr(keyword, "RANGE", 16)
    monkeypatch.setattr(keyword, "QUERY_BLOCK", 2)
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(20)] + ["foo_bar", "foo", "bar"]
    rows = [(i, f"p/x{i}.py", "r", "s", "function", " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(23)], k=draw.choice([3, 30])))) for i in range(200)] + [(300 + i, "p/y.py", "r", "s", "function", "w2 w3") for i in range(40)]
    made = keyword.build(spark.createDataFrame(rows, "chunk_id long, path string, repo string, symbol string, kind string, text string"), stem=False)
    dead = spark.createDataFrame([(i,) for i in range(0, 340, 7)], "chunk_id long")
    index = replace(with_lists(made), dead=dead)
    asked = [(0, "w0 w1 w9"), (1, "w2 w3"), (2, "foo_bar w2"), (None, "w5 w0"), (5, "w19")]
    queries = spark.createDataFrame(asked, "qid int, query string")
    found = keyword.Bounded(index, queries, 6, stem=False, digits=6).found()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "qid" in line and "chunk_id" in line]
    own = lambda df: sorted(((r.qid, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect()), key=str)
    want = own(keyword.pool(keyword.scores(made, queries, stem=False).join(dead, "chunk_id", "left_anti"), 6, 6))
    assert len(want) > 20 and own(found) == want


def test_the_hashing_model_stems_a_word_once(monkeypatch):
    from zlib import crc32

    from brindle.functions.stemming import stem_text

    texts = ["Running runs, the RAN and running", "", "the", "Бегущие бежали naïve İstanbul", "runs running x_1 " * 9]
    want = []
    for text in texts:
        row = [0.0] * 64
        for word in stem_text(text).split():
            row[crc32(word.encode()) % 64] += 1 if crc32(word.encode()) >> 31 else -1
        want.append(row)
    asked, stem = [], vectors.stem_token
    monkeypatch.setattr(vectors, "stem_token", lambda w: asked.append(w) or stem(w))
    model = vectors.HashingModel()
    assert model.embed(texts).tolist() == want and len(asked) == len(set(asked)) and "the" not in asked
    model.embed(texts)
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(vectors, "KNOWN", 2)  # few words are remembered
    assert vectors.HashingModel().embed(texts).tolist() == want
