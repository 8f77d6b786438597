import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import media, progressive


def picture(across, down, values):
    n = 6 * across * down * 64
    return across, down, np.resize(np.array(values, np.int16), n).reshape(-1, 64), b"x"


def same(pictures):
    for p, q in zip(pictures, progressive.decode(progressive.encode(pictures))):
        assert (np.concatenate([b.reshape(-1, 64) for b in q.blocks]) == p[2]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-255, 255) | st.just(0) | st.integers(-1, 1), min_size=1, max_size=700), st.integers(1, 3), st.integers(1, 3))
def test_coefficients_come_back(values, across, down):
    same([picture(across, down, values)])


def test_batches_of_unlike_pictures():
    draw = np.random.default_rng(1)
    kinds = [lambda n: np.where(draw.random(n) < 0.03, draw.integers(-3, 4, n), 0), lambda n: draw.integers(-1000, 1000, n), lambda n: np.zeros(n, int), lambda n: draw.integers(-1, 2, n)]
    same([picture(1 + i % 4, 1 + i % 3, kinds[i % 4](384 * 12)) for i in range(24)])


class Slow:
    """A plain decoder of one scan's entropy-coded data, bit by bit, as the standard tells it."""

    def __init__(self, data, table):
        self.bits, self.at = "", 0
        i = 0
        while i < len(data):
            self.bits += f"{data[i]:08b}"
            i += 2 if data[i] == 255 else 1
        codes, lengths = progressive._codes(table)
        self.symbols = {f"{int(codes[s]):0{n}b}": s for s, n in enumerate(lengths) if n}

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self):
        for n in range(1, 17):
            if (s := self.symbols.get(self.bits[self.at : self.at + n])) is not None:
                self.at += n
                return s

    def first(self, out, ss, se, al):
        i = 0
        while i < len(out):
            k = ss
            while k <= se:
                r, s = divmod(self.symbol(), 16)
                if s:
                    k += r
                    v = self.take(s)
                    out[i][k] = (v if v >> (s - 1) else v - (1 << s) + 1) << al
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    i += (1 << r) + self.take(r) - 1
                    break
            i += 1

    def refine(self, out, ss, se, al):
        ends = 0
        for row in out:
            k = ss
            while k <= se:
                r = value = 0
                if not ends:
                    r, s = divmod(self.symbol(), 16)
                    if s:
                        value = 1 if self.take(1) else -1
                    elif r < 15:
                        ends = (1 << r) + self.take(r)
                if ends:
                    while k <= se:
                        self.fix(row, k, al)
                        k += 1
                    ends -= 1
                    break
                while k <= se:
                    if row[k]:
                        self.fix(row, k, al)
                    elif r == 0:
                        row[k] = value << al if value > 0 else -(1 << al) if value else 0
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1

    def fix(self, row, k, al):
        if row[k] and self.take(1):
            row[k] += (1 << al) if row[k] > 0 else -(1 << al)


@pytest.mark.parametrize("kind", range(4))
def test_scans_against_a_plain_decoder(kind):
    draw = np.random.default_rng(kind)
    n = 384 * 4
    values = [draw.integers(-60, 60, n), np.where(draw.random(n) < 0.1, draw.integers(-3, 4, n), 0), draw.integers(-1, 2, n), np.where(draw.random(n) < 0.02, 1, 0)][kind]
    p = picture(2, 2, values)
    parsed = progressive.parse(progressive.encode([p])[0])
    blocks = {c: np.zeros((n_, 64), int).tolist() for c, n_ in ((0, 16), (1, 4), (2, 4))}
    for of, ss, se, ah, al, restart, data in parsed.scans:
        if not ss:
            continue
        lanes, start = [], 0
        raw = data.tobytes()
        for i in range(len(raw) - 1):
            if raw[i] == 255 and 0xD0 <= raw[i + 1] <= 0xD7:
                lanes.append(raw[start:i])
                start = i + 2
        lanes.append(raw[start:])
        for j, lane in enumerate(lanes):
            part = blocks[of[0][0]][j * restart : (j + 1) * restart]
            getattr(Slow(lane, of[0][2]), "refine" if ah else "first")(part, ss, se, al)
    got = np.array(blocks[0] + blocks[1] + blocks[2])
    assert (got[:, 1:] == p[2][:, 1:]).all()


def test_runs_of_ended_blocks():
    """The reader takes runs of blocks that end at once (EOBn), which the writer doesn't make."""
    codes, lengths = progressive._codes(progressive.AC_TABLE)
    text = ""
    def put(symbol, value=0, n=0):
        nonlocal text
        text += f"{int(codes[symbol]):0{lengths[symbol]}b}" + (f"{value:0{n}b}" if n else "")
    put(0x02, 3, 2)
    put(0x20, 1, 2)  # five blocks from this one on
    put(0x11, 0, 1)
    put(0x00)
    data = int(text.ljust(-(-len(text) // 8) * 8, "1"), 2).to_bytes(-(-len(text) // 8), "big")
    out = np.zeros((6, 64), np.int32)
    progressive._read_ac(progressive._Bits(np.frombuffer(data, np.uint8)), np.array([0]), np.array([0]), np.array([6]), progressive.AC_TABLE, out, 1, 63, 0)
    assert out[0, 1] == 3 and out[5, 2] == -1 and np.count_nonzero(out) == 2


def test_inverse_transform_and_colour():
    draw = np.random.default_rng(3)
    p = picture(2, 1, draw.integers(-90, 90, 800))
    q = progressive.decode(progressive.encode([p]))[0]
    planes = []
    for blocks in q.blocks:
        plane = np.zeros((blocks.shape[0] * 8, blocks.shape[1] * 8))
        for i, j in np.ndindex(blocks.shape[:2]):
            square = np.zeros(64)
            square[progressive.ZIGZAG] = blocks[i, j]
            m = progressive._cosine
            plane[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] = m @ square.reshape(8, 8) @ m.T
        planes.append(np.clip(np.round(plane + 128), 0, 255))
    y, cb, cr = planes[0], *(x.repeat(2, 0).repeat(2, 1) - 128 for x in planes[1:])
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
    got = progressive.rgb(q)
    assert got.shape == (16, 32, 3) and np.abs(got - want).max() <= 2.6


def test_rows(spark):
    draw = random.Random(1)
    texts = [None, "", "a", "é" * 96, "x" * 192, "]" * 5000 + "\\", "".join(map(chr, range(1, 0x250))), " ".join("".join(draw.choices("etaoin", k=5)) for _ in range(9000)), "a"]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, TEXT int")
    rows = {r.doc_id: r for r in media.digests(df).collect()}
    tensors = {r.doc_id: r for r in media.loaded(media.stored(df)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        pay = data + b" " * (-len(data) % 192) if data else b" " * 192
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        x = tensors[i]
        assert bytes(x.payload) == pay and len(x.rgb) == x.height * x.width * 3
        assert r.feature == media.feature(np.frombuffer(x.rgb, np.uint8).reshape(x.height, x.width, 3))
        alone = media.store([data])[0]
        assert (r.media_bytes, r.media_sha256) == (len(alone), hashlib.sha256(alone).hexdigest())
    assert rows[2].feature == rows[8].feature and media.digests(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "one", "x"), (1, "one", "x"), (2, None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    out = media.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in out.collect()) == [(i, len(t), 192, hashlib.sha256(t.ljust(192)).hexdigest()) for i, t in ((1, b"one"), (1, b"one"), (2, b""))]
