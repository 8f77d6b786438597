import base64
import glob
import gzip
import hashlib
import random

import pytest

from brindle.llm import common, warc

SCHEMA = "page_id long, url string, html string, payload string"


def pages(n=300):
    draw = random.Random(2)
    rows = [(i * 7 - 50, f"http://a/{i}", draw.choice(["", "same", "é" * 40, None, f"own {i}" * draw.randint(1, 60)]), "x") for i in range(n)]
    return rows + [(5000, None, "big" * 90000, "x"), (5001, "http://b\r\nc", "twice", "x"), (5001, "http://b\r\nc", "twice", "x"), (None, "u", "same", "x"), (None, "u", "alone", "x"), (9**15, "far", "own 3", "x")]


def expected(rows, least=0):
    first = {}
    for i, _, html, _ in rows:
        p = html or ""
        if i is not None and len(p.encode()) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and f != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, tmp_path, least):
    data = pages()
    manifest = warc.write(spark.createDataFrame(data, SCHEMA).repartition(5), str(tmp_path / "a"), least, shard_bytes=20000, roll_bytes=3000)
    back = warc.read(spark, str(tmp_path / "a"))
    assert rows_of(back) == expected(data, least)
    assert len(manifest) > 5 and sum(m["records"] for m in manifest) == len(data)
    assert all(m["bytes"] <= 3000 + len(warc.END) or m["records"] == 1 for m in manifest)
    texts = {(i, (h or "")) for i, _, h, _ in data}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in back.filter("record_type = 'response'").collect())


def test_same_bytes_however_the_input_is_split(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    made = [warc.write(df.repartition(n), str(tmp_path / f"w{n}"), shard_bytes=20000, roll_bytes=3000) for n in (1, 7)]
    assert made[0] == made[1]


def test_files_are_gzip_in_order_of_ids(spark, tmp_path):
    warc.write(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "g"), shard_bytes=20000, roll_bytes=3000)
    ids = []
    for name in sorted(glob.glob(f"{tmp_path}/g/*.warc.gz")):
        data = open(name, "rb").read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and data.endswith(warc.END)
        records = list(warc.parse(data))
        assert records[0][0]["WARC-Type"] == "warcinfo" and name.endswith(records[0][0]["WARC-Filename"])
        ids += [h["X-Page-ID"] for h, _ in records[1:]]
    ids = [int(x) if x else 10**30 for x in ids]
    assert ids == sorted(ids) and len(ids) == len(pages())


def test_damage_is_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "d"))
    name = glob.glob(f"{tmp_path}/d/*.warc.gz")[0]
    data = open(name, "rb").read()
    with pytest.raises(ValueError):
        list(warc.parse(data[:-4]))
    for crc in glob.glob(f"{tmp_path}/d/.*.crc"):
        __import__("os").remove(crc)
    open(name, "wb").write(data[:-25] + warc.END)
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read(spark, str(tmp_path / "d")).count()


def test_no_manifest_no_archive(spark, tmp_path):
    df = spark.createDataFrame(pages(10), SCHEMA)
    warc.write(df, str(tmp_path / "m"))
    assert not glob.glob(f"{tmp_path}/*.tmp")
    __import__("os").remove(tmp_path / "m" / "manifest.json")
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path / "m"))


def test_empty(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")) == []
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_missing_archive_is_noticed(spark, tmp_path):
    made = warc.write(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "g"), roll_bytes=2000)
    assert len(made) > 1
    __import__("os").remove(tmp_path / "g" / made[1]["file"])
    with pytest.raises(ValueError, match=made[1]["file"]):
        warc.read(spark, str(tmp_path / "g"))


def headers_of(folder):
    return [h for name in sorted(glob.glob(f"{folder}/*.warc.gz")) for h, _ in warc.parse(open(name, "rb").read()) if h["WARC-Type"] != "warcinfo"]


def test_record_ids_are_unique_and_revisits_name_their_response(spark, tmp_path):
    warc.write(spark.createDataFrame(pages() * 2, SCHEMA), str(tmp_path / "u"), shard_bytes=20000, roll_bytes=3000)
    found = headers_of(tmp_path / "u")
    by_id = {h["WARC-Record-ID"]: h for h in found}
    assert len(by_id) == len(found) == 2 * len(pages())
    revisits = [h for h in found if h["WARC-Type"] == "revisit"]
    assert revisits and all(by_id[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page"] and by_id[h["WARC-Refers-To"]]["WARC-Type"] == "response" and by_id[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] for h in revisits)


def test_an_id_and_nulls_over_a_shard_are_split(spark, tmp_path):
    rows = [(7, f"u{i}", f"text {i} " * 40, "x") for i in range(300)] + [(None, f"u{i}", f"null {i} " * 40, "x") for i in range(300)] + [(i, "u", f"one {i % 3}", "x") for i in (-(2**63), 2**63 - 1, -1, 0, 6, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = [warc.write(df.repartition(n), str(tmp_path / f"h{n}"), shard_bytes=20000) for n in (2, 5)]
    assert made[0] == made[1] and len({m["file"][:11] for m in made[0]}) >= 14
    assert rows_of(warc.read(spark, str(tmp_path / "h2"))) == expected(rows)


def test_hot_payloads_are_looked_up_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "join_unique", lambda *a: common.join_unique(*a, hot=4))
    rows = [(i, "u", "hot" if i % 3 == 0 else f"cold {i // 4}", "x") for i in range(200)]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "k"))
    assert rows_of(warc.read(spark, str(tmp_path / "k"))) == expected(rows)


def test_kinds_of_page_id(spark, tmp_path):
    rows = [(3, "a", "x"), (1, "b", "x"), (None, "c", "y")]
    warc.write(spark.createDataFrame(rows, "page_id int, url string, html string"), str(tmp_path / "i"))
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "i"), "int").collect()} == {(3, "revisit", 1), (1, "response", None), (None, "response", None)}
    with pytest.raises(TypeError, match="whole number"):
        warc.write(spark.createDataFrame([("1", "a", "x")], "page_id string, url string, html string"), str(tmp_path / "s"))


def test_payloads_are_shuffled_once_and_scratch_goes(spark, tmp_path):
    before = set(glob.glob(f"{common.shared_dir(spark)}/brindle-*"))
    warc.write(spark.createDataFrame(pages(), SCHEMA), str(tmp_path / "o"))
    assert set(glob.glob(f"{common.shared_dir(spark)}/brindle-*")) == before


def test_query(spark, tmp_path):
    """The registered query, on a table with a clashing column name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    data = pages()
    pq.write_table(pa.table([pa.array([r[0] for r in data], pa.int64()), pa.array([r[1] for r in data]), pa.array([r[2] for r in data]), pa.array(["x"] * len(data))], ["page_id", "url", "html", "payload"]), tmp_path / "pages.parquet")
    out = warc.query(spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(out) == expected(data)
