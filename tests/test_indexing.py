import json
import os

import pytest
from pyspark.sql import functions as F

from brindle.plans import cli, search, tools
from brindle.plans.indexing import index_corpus, new_chunks
from brindle.sources import files
from brindle.sources.store import ConcurrentCommit, Store

CODE = '"""a module."""\n\n\ndef retry_request():\n    return 1\n'


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "demo"
    root.mkdir()
    (root / "a.py").write_text(CODE)
    return root


def test_index_again_change_delete(spark, tmp_path, repo):
    root, repos = str(tmp_path / "index"), [files.Repo("demo", str(repo))]
    first = index_corpus(spark, repos, root)
    assert (first["indexed"], first["embedded"]["hashing"]) == (1, first["chunks_added"]) and first["chunks_added"] == 2
    again = index_corpus(spark, repos, root)
    assert (again["indexed"], again["unchanged"], again["chunks_added"], again["embedded"]["hashing"]) == (0, 1, 0, 0)
    store = Store(spark, root)
    ids = {r.chunk_id for r in store.read("chunks").collect()}
    (repo / "a.py").write_text(CODE + "\n\ndef more():\n    return 'api_key = \"abcdefghijklmnop\"'\n")
    changed = index_corpus(spark, repos, root)
    assert changed["indexed"] == 1 and changed["embedded"]["hashing"] == changed["chunks_added"] == 3 and changed["redactions"] == {"credential": 1}
    now = {r.chunk_id for r in store.read("chunks").collect()}
    assert not now & ids and min(now) > max(ids)
    assert {r.path for r in store.read("files").collect()} == {"demo/a.py"}
    assert {r.chunk_id for r in store.read("postings").collect()} == now
    assert index_corpus(spark, repos, root, ["hashing", "hashing@st-cuda"])["embedded"] == {"hashing": 0, "hashing@st-cuda": 3}
    (repo / "a.py").unlink()
    assert index_corpus(spark, repos, root)["deleted"] == 1
    assert all(store.read(t).count() == 0 for t in ("files", "chunks", "postings", "lengths", "embeddings"))
    store.vacuum(0)
    assert store.read("chunks").count() == 0


def test_tools_and_command_line(spark, tmp_path, repo, capsys):
    (repo / "b.md").write_text("# Sites\nHow deployers publish\n")
    (repo / "my_secret.py").write_text("x = 1\n")
    root = str(tmp_path / "index")
    (tmp_path / "corpus.yaml").write_text("repos:\n  - name: demo\n    path: demo\n")
    (tmp_path / "q.yaml").write_text("- id: one\n  question: where is a request retried\n  expected_paths: [demo/a.py]\n  expected_spans: ['demo/a.py:4-5']\n")
    base = ["--index", root, "--corpus", str(tmp_path / "corpus.yaml")]
    assert cli.main([*base, "index"], spark) == 0
    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    first = said()
    assert first[-1]["index"]["indexed"] == 2 and {"repo": "demo", "is_dir": False, "reason": "secret_like_name", "n": 1} in [x.get("skipped") for x in first]
    assert cli.main([*base, "search", "retry request", "--mode", "bm25"], spark) == 0
    hits = said()
    assert hits[0]["path"] == "demo/a.py" and [h["rank"] for h in hits] == list(range(len(hits)))
    assert cli.main([*base, "search", "retry request", "--mode", "hybrid+rerank", "--reranker", "overlap"], spark) == 0 and said()
    assert cli.main([*base, "search", "zzz", "--mode", "bm25"], spark) == 0 and said() == []
    assert cli.main([*base, "eval", str(tmp_path / "q.yaml"), "--out", str(tmp_path / "r.md")], spark) == 0
    scored = [x for x in said() if "set" in x]
    assert [x["mode"] for x in scored] == list(search.MODES) and scored[0]["recall_5"] == scored[0]["fn_recall_5"] == 1.0
    written = (tmp_path / "r.md").read_text()
    assert "|fn_mrr|" in written and "|figure|bm25|dense|hybrid|hybrid+rerank|" in written
    assert cli.main([*base, "eval", str(tmp_path / "q.yaml"), "--no-rerank"], spark) == 0
    assert "hybrid+rerank" not in [x.get("mode") for x in said()]
    found = tools.search_code(spark, root, "retry request", rerank=True)
    assert found[0]["path"] == "demo/a.py" and set(found[0]) == {"chunk_id", "path", "repo", "symbol", "kind", "start_line", "end_line", "snippet", "score"}
    assert tools.search_code(spark, root, "retry request", repo="nope") == []
    whole = tools.read_chunk(spark, root, found[0]["chunk_id"])
    assert whole["path"] == "demo/a.py" and whole["header"].startswith("demo/a.py | ")
    assert tools.read_chunk(spark, root, 10**9) == {} and tools.list_repos(spark, root) == [{"repo": "demo", "chunks": 3}]


def test_walk(spark, tmp_path):
    top = tmp_path / "tree"
    sizes = {"a.py": 1, "A.PY": 1, "my_secret.md": 1, ".env.py": 1, "x.pem": 1, ".gitignore": 1, "img.png": 1, "_client.py": 1, "__init__.py": 1, "fit.txt": files.MAX_SIZE, "big.txt": files.MAX_SIZE + 1, "src/ok.py": 1, ".txt": 1, "no.": 1, "..py": 1, "...md": 1, "a..txt": 1}
    hidden = [".venv/x.py", "Build/x.py", "src/vendor_libs/x/y.py", "gen_generated/x.py"]
    for name, n in (sizes | dict.fromkeys(hidden, 1)).items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x" * n)
    listing = files.walk(spark, [files.Repo("r", str(top))])
    got = {r.rel: r.reason for r in listing.collect() if not r.is_dir}
    assert got == {"a.py": None, "A.PY": None, "my_secret.md": "secret_like_name", ".env.py": "secret_like_name", "x.pem": "secret_like_name", ".gitignore": "extension_not_included", "img.png": "extension_not_included", "_client.py": None, "__init__.py": None, "fit.txt": None, "big.txt": "too_large", "src/ok.py": None, ".txt": "extension_not_included", "no.": "extension_not_included", "..py": None, "...md": None, "a..txt": None}
    assert {r.rel: r.reason for r in listing.collect() if r.is_dir} == {".venv": "skip_dir_name", "Build": "skip_dir_name", "src/vendor_libs": "vendored_or_generated", "gen_generated": "vendored_or_generated"}
    counts = {(r.is_dir, r.reason): r.n for r in files.skip_summary(listing).collect()}
    assert counts[(True, "skip_dir_name")] == 2 and counts[(False, "secret_like_name")] == 3
    read = {r.path: r for r in files.read_files(listing).collect()}
    assert set(read) == {f"r/{n}" for n, why in got.items() if why is None} and read["r/A.PY"].suffix == ".PY"


def test_corpus_file(tmp_path):
    at = tmp_path / "corpus.yaml"
    at.write_text(f"repos:\n  - name: one\n    path: below/one\n  - name: two\n    path: {tmp_path}/two\n")
    assert files.load_corpus(str(at)) == [files.Repo("one", str(tmp_path / "below/one")), files.Repo("two", str(tmp_path / "two"))]
    for empty in ("", "repos:\n", "repos: []\n"):
        at.write_text(empty)
        assert files.load_corpus(str(at)) == []
    at.write_text("repos:\n  - name: one\n    root: x\n")
    with pytest.raises(ValueError, match="`name` and `path`"):
        files.load_corpus(str(at))


def test_deeply_nested_code_goes_in_windows(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.py").write_text("x = " + "-" * 20000 + "1\n")
    (tmp_path / "deep/b.py").write_text("x = " + "(" * 3000 + ")" * 3000 + "\n")
    report = index_corpus(spark, [files.Repo("deep", str(tmp_path / "deep"))], str(tmp_path / "i"))
    assert report["indexed"] == 2 and {r.kind for r in Store(spark, str(tmp_path / "i")).read("chunks").collect()} == {"window"}


def test_runs_that_cross_lose_nothing(spark, tmp_path, repo):
    root = str(tmp_path / "index")
    index_corpus(spark, [files.Repo("demo", str(repo))], root)
    store = Store(spark, root)
    before = store.state()
    (repo / "b.md").write_text("# Sites\n")
    index_corpus(spark, [files.Repo("demo", str(repo))], root)
    late = store.segment(before)
    late.put("dead", spark.createDataFrame([(1,)], "chunk_id long"))
    with pytest.raises(ConcurrentCommit):
        store.publish(late)
    assert store.read("files").count() == 2 and not [f for f in os.listdir(root) if f in late.tables["dead"]]
    assert not [f for f in os.listdir(root) if f.startswith("staged")]


def test_point_reads(spark, tmp_path, repo):
    root = str(tmp_path / "index")
    index_corpus(spark, [files.Repo("demo", str(repo))], root)
    store = Store(spark, root)
    ids = [r.chunk_id for r in store.read("chunks").select("chunk_id").collect()]
    asked = spark.createDataFrame([(i,) for i in (*ids, ids[0], 10**9)], "chunk_id long")
    assert sorted(r.chunk_id for r in store.chunks_by_id(asked).collect()) == sorted(ids)
    assert sorted(r.chunk_id for r in store.repo_ids("demo").collect()) == sorted(ids) and store.repo_ids("nope").count() == 0
    assert {len(r.vector) for r in store.vectors("hashing").collect()} == {64}


def test_decode():
    assert files.decode("\ufeffhé".encode()) == "hé" and files.decode("Привет".encode("cp1251")) == "Привет" and files.decode(b"a\x98\xff") == "a\ufffd\ufffd"


def test_stream(spark, tmp_path):
    from brindle.streaming.indexing import index_stream

    schema = "path string, repo string, suffix string, sha256 string, size long, mtime double, text string"
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    put = lambda rows: spark.createDataFrame([(p, "r", ".txt", None, len(t), m, t) for p, t, m in rows], schema).withColumn("sha256", F.sha2("text", 256)).write.mode("append").json(source)
    run = lambda: index_stream(spark.readStream.schema(schema).json(source), store, ["hashing"], str(tmp_path / "cp")).awaitTermination()
    put([("r/a.txt", "one", 1.0), ("r/a.txt", "two", 2.0), ("r/b.txt", "bee", 1.0)])
    run()
    assert {r.path: r.text for r in store.read("chunks").collect()} == {"r/a.txt": "two", "r/b.txt": "bee"}
    put([("r/b.txt", "bees", 3.0)])
    run()
    assert {r.path: r.text for r in store.read("chunks").collect()} == {"r/a.txt": "two", "r/b.txt": "bees"}
    assert store.read("embeddings").count() == 2


def test_files_are_cut_once(spark, tmp_path):
    """The ranges that chunks are dealt by are found in stored chunks, not by cutting and redacting all files once more."""
    rows = spark.createDataFrame([(f"f{i:02d}.py", "r", "\n".join(f"line {k} of {i}" for k in range(70)), ".txt") for i in range(9)], "path string, repo string, text string, suffix string")
    made = new_chunks(spark, rows, str(tmp_path / "made"))
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.path, r.start_line) for r in made.orderBy("order").collect()] == [(f"f{i:02d}.py", k) for i in range(9) for k in (1, 51)]
