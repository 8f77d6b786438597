import random

from brindle.llm import licenses as lic

SCHEMA = "doc_id long, path string, text string, license int"


def plain(text, index):
    """The likest part, every line, paragraph and whole text compared."""
    parts = [text or "", *(text or "").split("\n"), *lic.PARAGRAPH.split(text or "")]
    best = max((index.best(p.lower()) for p in parts), key=lambda x: (x[0], -x[1]))
    whole = index.best((text or "").lower())[0] >= index.threshold
    return (index.names[best[1]], best[0], whole) if best[0] >= index.threshold else (None, False)


def texts():
    draw = random.Random(4)
    vocabulary = ["the", "and", "is", "in", "this", "under", "work", "file", *("".join(draw.choices("abcdefg", k=5)) for _ in range(200))]
    out = [None, "", " ", "the the this", "under the license"]
    for i in range(300):
        lines = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 12))) for _ in range(draw.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(draw.randrange(len(lines) + 1), draw.choice(lic.TEMPLATES)[1].replace("2.0", draw.choice(["2.0", "2.1"])))
        if i % 7 == 0:
            w = draw.choice(lic.TEMPLATES)[1].split()
            lines += ["", " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), ""]
        out.append("\n".join(lines))
    return out


def test_filter_changes_nothing(spark):
    data = texts()
    df = spark.createDataFrame([(i, f"a/{i}", t, 0) for i, t in enumerate(data)], SCHEMA)
    frequency, n = lic.frequencies(df, sorted({w for _, t in lic.TEMPLATES for w in lic.words(t)}))
    assert n == len(data) and frequency["the"] == sum("the" in lic.words(t or "") for t in data)
    index = lic.Index(lic.TEMPLATES, frequency, n, lic.THRESHOLD)
    assert index.telling and len(index.telling) < len(index.idf)
    for r in lic.detect(df).collect():
        want = plain(data[r.doc_id], index)
        assert (r.license, r.score, r.licence_file) == want if want[0] else r.license is None and not r.licence_file


def test_every_template_is_told():
    index = lic.Index(lic.TEMPLATES, {w: 50 for w in ("the", "this", "is", "of", "and", "to")}, 1000, lic.THRESHOLD)
    for name, text in lic.TEMPLATES:
        assert index.scan("first line of code\n# " + text.upper() + "\nx = 1")[:2] == (name, 1.0)


def test_nearest_ancestor(spark):
    rows = [(1, "a/LICENSE", "MIT", 0.9, True), (2, "a/b/LICENSE", "ISC", 0.8, True), (3, "a/b/COPYING", "MPL-2.0", 0.95, True), (4, "a/b/c/d/x.py", None, 0.1, False), (5, "a/z/y.py", None, 0.0, False), (6, "a/b/own.py", "GPL-3.0", 0.7, False), (7, "q/x", None, 0.0, False), (8, None, None, 0.0, False), (9, "top", None, 0.0, False)]
    schema = "doc_id long, path string, license string, score double, licence_file boolean, folder int"
    out = {r.doc_id: (r.license, r.how, r.origin) for r in lic.inherit(spark.createDataFrame([(*r, 1) for r in rows], schema)).collect()}
    assert out == {1: ("MIT", "file", "a/LICENSE"), 2: ("ISC", "file", "a/b/LICENSE"), 3: ("MPL-2.0", "file", "a/b/COPYING"), 4: ("MPL-2.0", "inherited", "a/b/COPYING"), 5: ("MIT", "inherited", "a/LICENSE"), 6: ("GPL-3.0", "header", "a/b/own.py"), 7: (None, "none", None), 8: (None, "none", None), 9: (None, "none", None)}
    root = [*rows, (10, "LICENSE", "CC0-1.0", 1.0, True)]
    out = {r.doc_id: r.license for r in lic.inherit(spark.createDataFrame([(*r, 1) for r in root], schema)).collect()}
    assert (out[7], out[8], out[9], out[5]) == ("CC0-1.0", "CC0-1.0", "CC0-1.0", "MIT")


def test_odd_rows(spark):
    rows = [(1, "a/1", "x " * 100000 + "\nReleased under the MIT License.\n", 0), (None, "a/2", None, 0), (2, None, "", 0), (3, "a/1", "word", 0), (3, "a/1", "word", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lic.inherit(lic.detect(df)).collect()
    assert len(out) == 5 and sorted((r.doc_id or 0, r.how) for r in out) == [(0, "none"), (1, "header"), (2, "none"), (3, "none"), (3, "none")]
    assert lic.inherit(lic.detect(df.limit(0))).count() == 0


def test_full_texts_are_licence_files_and_pass_on(spark):
    """Real licence texts, signed and wrapped anew, each in a directory with a file that has no header."""
    prose = " ".join(f"word{i}" for i in range(300))
    rows, want = [], {}
    for i, p in enumerate(sorted(lic.TEXTS.glob("*.txt"))):
        text = "Copyright (c) 2019-2021 Some Holder and Others\n\n" + "\n\n".join(" ".join(x.split()) for x in p.read_text().split("\n\n"))
        rows += [(2 * i, f"r/{p.stem}/notice", text, 0), (2 * i + 1, f"r/{p.stem}/src/a.py", prose + str(i), 0)]
        want |= {2 * i: (p.stem, "file"), 2 * i + 1: (p.stem, "inherited")}
    mit = (lic.TEXTS / "MIT.txt").read_text()
    rows += [(900, "h/a.py", mit + "\n".join(f"value{i} = call{i}(other{i})" for i in range(400)), 0), (901, "h/b.py", prose, 0)]
    rows += [(902, "n/LICENSE-MIT", "Released under the MIT License.\n" + prose, 0), (903, "n/b.py", prose, 0), (904, "n/license.py", "Released under the MIT License.\n" + prose, 0)]
    want |= {900: ("MIT", "header"), 901: (None, "none"), 902: ("MIT", "file"), 903: ("MIT", "inherited"), 904: ("MIT", "header")}
    out = {r.doc_id: (r.license, r.how) for r in lic.inherit(lic.detect(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out == want


def test_full_text_alone_and_title():
    gpl = (lic.TEXTS / "GPL-3.0.txt").read_text()
    for files in (1, 5000):
        index = lic.Index(lic.TEMPLATES, {w: 1 for w in lic.words(gpl)}, files, lic.THRESHOLD)
        assert index.scan(gpl)[::2] == ("GPL-3.0", True)
        assert index.scan(gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1))[::2] == ("AGPL-3.0", True)


def test_bare_reservation_comes_last():
    index = lic.Index(lic.TEMPLATES, {}, 1000, lic.THRESHOLD)
    assert index.scan("first line\nAll rights reserved.\nlast line") == ("Proprietary", 1.0, False)
    assert index.scan("# All rights reserved.\n# Licensed under the Apache License, Version 2.1.\n" + "x = y\n" * 500)[0] == "Apache-2.0"
    assert index.scan("All the other rights are for others to have and to hold\nreserved")[0] is None
    index = lic.Index(lic.TEMPLATES, {"all": 900, "rights": 800}, 1000, lic.THRESHOLD)
    assert index.scan("some line\nreserved\nlast line")[0] is None and index.scan("some line\nall rights reserved\nlast")[0] == "Proprietary"


def test_against_vectors_of_its_own():
    """TF-IDF vectors, cosines and ties by numpy, over all templates, lines, paragraphs and whole texts."""
    import re
    from collections import Counter

    import numpy as np

    data = [t for t in texts() if t]
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    assert all(split(t) == lic.words(t) for t in data)
    vocabulary = sorted({w for t in data for w in split(t)} | {w for _, t in lic.TEMPLATES for w in split(t)})
    at = {w: i for i, w in enumerate(vocabulary)}
    df = Counter(w for t in data for w in set(split(t)))
    known = {w for _, t in lic.TEMPLATES for w in split(t)}
    idf = np.array([np.log((1 + len(data)) / (1 + df[w])) if w in known else np.log(1 + len(data)) for w in vocabulary])

    def vector(text):
        v = np.zeros(len(vocabulary))
        for w in split(text):
            v[at[w]] += 1
        v *= idf
        return v / (np.linalg.norm(v) or 1)

    templates = np.array([vector(t) for _, t in lic.TEMPLATES])
    index = lic.Index(lic.TEMPLATES, {w: df[w] for w in known}, len(data), lic.THRESHOLD, [], None)
    for text in data:
        cosines = np.array([templates @ vector(p) for p in {text, *text.split("\n"), *re.split(r"\n\s*\n", text)}])
        best = cosines.max()
        name, score, _ = index.scan(text)
        if best < lic.THRESHOLD - 1e-6:
            assert name is None
        else:
            assert abs(score - best) < 1e-5
            assert name in {lic.TEMPLATES[j][0] for j in np.nonzero(cosines.max(0) >= best - 1e-6)[0]}


def test_inheritance_against_sql(spark):
    import duckdb
    import pandas as pd

    draw = random.Random(8)
    folders = ["", "a", "a/b", "a/b/c", "d", "d/e", "ab", "a/bc"]
    rows = []
    for i in range(400):
        told = draw.random() < 0.1
        license_ = draw.choice(["MIT", "ISC", "GPL-3.0"]) if told or draw.random() < 0.2 else None
        folder = "a/b/c" if i % 3 else draw.choice(folders)  # a third of the rows and more in one folder
        rows.append((i, f"{folder}/f{i}" if folder else f"f{i}", license_, draw.randint(60, 99) / 100 if license_ else 0.1, told))
    found = pd.DataFrame(rows, columns=["doc_id", "path", "license", "score", "licence_file"])
    want = duckdb.sql("""
        WITH f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM found),
        told AS (SELECT folder, license, path, row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) AS n FROM f WHERE licence_file),
        near AS (SELECT f.doc_id, t.license, t.path, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(t.folder) DESC) AS n
                 FROM f JOIN told t ON t.n = 1 AND (t.folder = '' OR f.folder = t.folder OR starts_with(f.folder, t.folder || '/')))
        SELECT f.doc_id, coalesce(f.license, near.license) AS license, CASE WHEN licence_file THEN 'file' WHEN f.license IS NOT NULL THEN 'header' WHEN near.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
               CASE WHEN f.license IS NOT NULL THEN f.path ELSE near.path END AS origin
        FROM f LEFT JOIN near ON near.doc_id = f.doc_id AND near.n = 1 ORDER BY f.doc_id""").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, path string, license string, score double, licence_file boolean")
    got = sorted((r.doc_id, r.license, r.how, r.origin) for r in lic.inherit(df).collect())
    assert got == want


def test_query(spark, tmp_path):
    """Paths of the registered query, on a table with a clashing column name."""
    rows = [(i, "Released under the MIT License." if i % 4 == 0 else f"text number {i}", "en" if i % 2 else None, "s1", "x") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, license string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in lic.query(spark, str(tmp_path)).collect()}
    assert len(out) == 40 and out[0].path == "s1/0.txt" and out[1].path == "s1/en/1.txt" and out[2].path == "s1/und/d2/2.txt"
    assert all((out[i].license == "MIT") == (i % 4 == 0) or out[i].how == "inherited" for i in out)
