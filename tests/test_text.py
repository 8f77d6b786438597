import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import redaction, stemming, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("name, parts", [("rich-demo/src/live_render.py", "rich demo src live render py"), ("generate_image", "generate image"), ("BigClass.method_two", "big class method two"), ("HTTPServerError", "http server error")])
def test_identifier_parts(spark, name, parts):
    assert " ".join(one(spark, name, text.identifier_parts("t"))) == parts


def test_tokens(spark):
    assert one(spark, "Как деплоер публикует сайт?", text.query_tokens("t")) == ["деплоер", "публикует", "сайт"]
    assert one(spark, "Foo foo the foo_bar", text.query_tokens("t")) == ["foo", "foo_bar"]


def test_stems():
    assert stemming.stem_text("Как деплоер публикует сайты") == "деплоер публик сайт"
    assert stemming.stem_text("How does the deployer publish sites") == "deploy publish site"
    words = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "agreed": "agre", "hopping": "hop", "hoping": "hope", "happy": "happi", "say": "say", "relational": "relat", "consistency": "consist", "generously": "generous", "skies": "sky", "proceed": "proceed", "knightly": "knight", "nationality": "nation", "knack": "knack", "luxuriated": "luxuri", "bed": "bed", "was": "was"}
    assert {w: stemming.stem_english(w) for w in words} == words
    russian = {"важная": "важн", "вопросам": "вопрос", "победивший": "побед", "красивейшая": "красив", "гордость": "гордост", "книгами": "книг"}
    assert {w: stemming.stem_russian(w) for w in russian} == russian


def test_snippet_header_span(spark):
    long = "  first line\n" + "x" * 100 + "\n" + "y" * 300
    assert one(spark, long, text.snippet("t")) == "first line\n" + "x" * 100 + " ..."
    assert one(spark, " short ", text.snippet("t")) == "short"
    assert one(spark, "z" * 300, text.snippet("t")) == "z" * 240 + " ..."
    assert one(spark, "a\\b.py", text.header("t", F.lit("S.m"), F.lit("method"))) == "a/b.py | S.m | method"
    assert one(spark, "httpx/httpx/_Client.py:546-571", text.parse_span("t")).asDict() == {"path": "httpx/httpx/_client.py", "first": 546, "last": 571}


@pytest.mark.parametrize("path, weight", [("web/test/unit/x.py", 0.5), ("web/Docs/guide.py", 0.5), ("web/HISTORY.old", 0.5), ("web/notes.RST", 0.5), ("web/src/io_test.py", 0.5), ("test_io.py", 0.5), ("web/src/testing.py", 1.0), ("web/src/latest/io.py", 1.0), ("web/readme/io.py", 1.0)])
def test_prior(spark, path, weight):
    assert one(spark, path, text.source_prior("t")) == weight


SECRETS = {
    "telegram_token": "id 4711471147:" + "Zz9" * 11 + "-q", "openai_key": "see sk-ant-madeup0madeup1madeup2", "google_api_key": "AIza" + "Qw3rt" * 7, "github_token": "use github_pat_" + "not_real_" * 3,
    "bearer_token": "header Bearer not.a.real-token~1==", "credential": "service_secret: 'NotARealSecret_0987'", "phone": "звоните 8 (812) 555-01-23, да", "ip_address": "at 10.20.30.40 port",
}


def test_redaction(spark):
    rows = [(k, v) for k, v in SECRETS.items()] + [("none", "for i in range(8):\n    total += i\n"), ("two", SECRETS["telegram_token"] + "\n" + SECRETS["telegram_token"])]
    out = {r.kind: r for r in redaction.with_redaction(spark.createDataFrame(rows, "kind string, text string")).collect()}
    for kind, value in SECRETS.items():
        assert f"[REDACTED:{kind}]" in out[kind].text and out[kind].redactions == {kind: 1}, kind
    assert out["credential"].text == "service_secret: '[REDACTED:credential]'" and out["none"].text == dict(rows)["none"] and out["none"].redactions == {}
    assert out["two"].redactions == {"telegram_token": 2}


def test_patterns_agree_with_python(spark):
    """Each pattern, with the classes as Python has them, on strings around word boundaries in several scripts."""
    import random

    draw = random.Random(7)
    bits = ["api_key", "=", ":", " ", "'", '"', "abcdefghijkl", "ABC-123_xyz+/", "é", "²", "ключ", "8", "+7", "999", "12", "1.2.3.4", ".", "sk-", "x" * 17, "Bearer ", "\x1c", "_", "(", ")", "-", "\n"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = {r.text: r.x for r in df.select("text", redaction.redact("text").alias("x")).collect()}

    def plain(t):
        for kind, pattern in redaction.PATTERNS.items():
            for java, py in ((text.EDGE, r"\b"), (text.SPACE, r"\s"), (text.WORD, r"\w"), (r"[\s\x1C-\x1F\-]", r"[\s\-]"), (r"[\p{L}\p{N}_.]", r"[\w.]")):
                pattern = pattern.replace(java, py)
            flags = re.I | re.M if kind == "credential" else 0
            to = rf"\g<1>\g<2>[REDACTED:{kind}]\g<2>" if kind == "credential" else f"[REDACTED:{kind}]"
            t = re.sub(re.sub(r"^\(\?\w+\)", "", pattern), to, t, flags=flags)
        return t

    assert {t: plain(t) for t in texts} == got


def test_usual_texts_are_spared_the_search(spark):
    """Words like key or api, numbers and decimals alone open no search."""
    usual = spark.createDataFrame([("the monkey: a capital, in 1999 and 2001 = 1.5 times 300 tokens: yes",)], "t string")
    assert list(usual.select(*(redaction._guarded(F.col("t"), k) for k in redaction.PATTERNS)).first()) == [False] * len(redaction.PATTERNS)
    secret = spark.createDataFrame(list(SECRETS.items()), "kind string, t string").select("kind", *(redaction._guarded(F.col("t"), k).alias(k) for k in redaction.PATTERNS))
    assert all(r[r.kind] for r in secret.collect())


def test_endings_are_found_by_their_last_letter():
    for endings in (stemming.STEP2, stemming.STEP3, stemming.STEP4, ("'", "'s", "'s'"), ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        table = stemming._by_last(endings)
        for word in ["", "x", *endings, *(a + b for a in ("n", "reli", *endings) for b in endings), "zzz"]:
            assert stemming._ending(word, table) == stemming._longest(word, endings)
