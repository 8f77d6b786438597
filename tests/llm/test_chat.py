import random

from brindle.llm import chat

from .oracle import both

SCHEMA = "conv_id long, turn long, role string, text string, x int"


def rows(seed=0):
    draw, out, conv = random.Random(seed), [], 0
    for _ in range(60):
        base = [(draw.choice(["user", "assistant"]), draw.choice(["hi", "no", "", "so it is", None])) for _ in range(draw.randint(1, 9))]
        for n in draw.sample(range(1, len(base) + 1), min(len(base), draw.randint(1, 3))) + [len(base)] * draw.randint(0, 2):
            out += [(conv, 3 * i - 2, r, t, 0) for i, (r, t) in enumerate(base[:n])]
            conv += 1
    return out


def test_against_sql(spark):
    data = rows() + [(None, 1, "user", "x", 0), (900, None, None, "a", 0), (900, 5, "user", "b", 0), (900, 5, "user", "b", 0), (901, 1, "user", "é" * 50000, 0)]
    turns = spark.createDataFrame(data, SCHEMA)
    for block in (2, 256):
        got, want = both(spark, chat.render(turns, block), chat.ORACLE, conversations=turns)
        assert got == want and len(got) < len({r[0] for r in data})


def test_prefix_and_copies(spark):
    data = [(c, t, "user", f"m{t}", 0) for c, n in ((1, 3), (2, 2), (3, 3), (4, 1)) for t in range(n)]
    out = chat.render(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.copies) for r in out] == [(1, 3, 2)]
    assert out[0].rendered == "".join(f"<|im_start|>user\nm{t}<|im_end|>\n" for t in range(3))


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0
