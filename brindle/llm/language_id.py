"""Operator 10: language identification by averaged hashed subword embeddings and a linear softmax.

A word (a run of letters and marks, lower-cased) stands for itself and its character n-grams with word ends, hashed into a table of
embeddings. A text is the average of the embeddings of all its words' subwords; a linear softmax gives the languages. Embeddings and softmax
are trained together by stochastic gradient descent in numpy, on whole texts and their sentences. A fifth of the training texts is set aside.

Rejection is calibrated on the texts set aside and on pieces of them with few words. The softmax temperature is the one of least log loss, with smoothed targets, so that
confidences are probabilities; a text is rejected if its best language is likelier wrong than right (below LEAST). A softmax is sure of anything that isn't like any language it
knows, too; so the best language's logit, before the temperature, must also be at least a part NOVEL of what all but a share LOST of the texts set aside with about as many words have (about
half, as that is what a text in two known languages has of each). Subwords that weren't learned from have logits about 0, so texts in other scripts and unlike languages fall short, the more
surely the longer they are; a single word, or a language much like a known one, mostly can't be told.

Only texts and languages of a bounded sample are learned from: PER_LANGUAGE texts of each of the MAX_LANGUAGES most frequent languages, those with the least hash of id and text, and
SAMPLE_BYTES in all. Each text is learned from as a whole, and besides some SENTENCES of its sentences, evenly spread, so that long texts don't outweigh others; calibration uses the text set aside as a whole, and
its first PIECES pieces of each length. Scoring reads every text whole. As the logits of an average are the average of the logits, a worker keeps the summed logits of each word, and a
text costs a lookup for each word. The words of a text that are new to a worker are summed up together.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected; texts of any length are read whole; rows with
equal texts get equal results; null ids are never learned from and aren't held out; without anything to learn from, all are `und`; columns
besides doc_id, text and lang don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, each_slice, fold, kept, pick, small_batches, table, worker_state

PER_LANGUAGE, MAX_LANGUAGES = 400, 200
BUCKETS, DIMENSIONS, GRAMS, EPOCHS = 1 << 16, 16, (2, 3, 4), 3
#: Rates of the softmax's weights, of its bias, and of the embeddings, at the start of the training.
RATE, BIAS_RATE, TABLE_RATE = 0.5, 0.05, 10.0
#: Sentences that a training text is learned from besides the whole (up to twice as many, as they are evenly spread), and pieces of each length that it is calibrated on.
SENTENCES, PIECES = 20, 4
#: The least confidence; the share of the texts set aside whose best logit may fall short; and the part of the logit of the others that a text must have.
LEAST, LOST, NOVEL = 0.5, 0.001, 0.55
#: Numbers of words by which logits are told apart: powers of two, the last for all longer texts.
SIZES = 8
MEMO_CHARS, MEMO_ENTRIES, WORDS_AT_ONCE = 40, 250_000, 1024

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SENTENCE = regex.compile(r"[.!?\n]+")


@cache
def _plain_word() -> re.Pattern:
    """WORD for texts of the basic plane, with its letters and marks spelled out, which is read faster."""
    plane = "".join(map(chr, range(0x10000)))
    kinds = ("".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(p, plane)) for p in (r"\p{L}+", r"[\p{L}\p{M}]+"))
    return re.compile("[{}][{}]*".format(*kinds))


HIGH = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    text = text.lower()
    return (WORD if HIGH.search(text) else _plain_word()).findall(text)


def subwords(word: str) -> list[int]:
    """Table rows of a word: its own and those of its n-grams."""
    ends = f"<{word}>"
    if ends.isascii() and len(ends) <= MEMO_CHARS:
        own = ends.encode()
        return [h & (BUCKETS - 1) for h in map(crc32, sorted({own, *(own[i : i + n] for n in GRAMS for i in range(len(own) - n + 1))}))]
    grams = {ends, *(ends[i : i + n] for n in GRAMS for i in range(len(ends) - n + 1))} if len(ends) <= MEMO_CHARS else [ends[i : i + n] for n in GRAMS for i in range(len(ends) - n + 1)]
    return [crc32(g.encode()) & (BUCKETS - 1) for g in sorted(grams)]


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each table row, by language
    bias: np.ndarray
    temperature: float
    least: float  # confidence, else rejected
    least_logits: np.ndarray  # by the number of words, else rejected

    def told(self, sure: float, logit: float, words: int) -> bool:
        return sure >= self.least and logit >= self.least_logits[min(SIZES, words.bit_length()) - 1]


def _bag(words: list[str], memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows: list[int] = []
    for w in words:
        if w not in memo:
            memo[w] = subwords(w)
        rows += memo[w]
    found, n = np.unique(np.asarray(rows, np.int64), return_counts=True)
    return found, (n / len(rows)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = 0) -> Model | None:
    names = sorted(set(languages))
    if not names:
        return None
    at, memo = {k: i for i, k in enumerate(names)}, {}
    learn, aside = [], []
    for text, language in zip(texts, languages):
        parts = [p for s in SENTENCE.split(text.lower()) if (p := WORD.findall(s))]
        if not parts:
            continue
        words = [w for p in parts for w in p]
        if crc32(text.encode()) % 5 == 0:
            aside.append((words, at[language]))
        else:
            learn.append((_bag(words, memo), at[language]))
            learn += [(_bag(p, memo), at[language]) for p in parts[:: max(1, len(parts) // SENTENCES)]]
    if not learn:
        learn, aside = [(_bag(words, memo), k) for words, k in aside], []
    draw = np.random.default_rng(seed)
    table_ = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(learn)):
            (rows, share), y = learn[i]
            left = np.float32(1 - done / steps)
            done += 1
            hidden = share @ table_[rows]
            off = _softmax(hidden @ weights + bias)
            off[y] -= 1
            back = weights @ off
            weights -= RATE * left * np.outer(hidden, off)
            bias -= BIAS_RATE * left * off
            table_[rows] -= TABLE_RATE * left * np.outer(share, back)
    model = Model(names, (table_ @ weights).astype(np.float64), bias.astype(np.float64), 1.0, 0.0, np.full(SIZES, -np.inf))
    return _calibrated(model, aside, memo)


def _calibrated(model: Model, aside: list[tuple[list[str], int]], memo: dict[str, list[int]]) -> Model:
    """The model with temperature and thresholds fitted to texts set aside, and to pieces of them of each number of words."""
    if not aside:
        return model
    pieces = [(words[start : start + n], k) for words, k in aside for n in (1 << j for j in range(SIZES - 1)) for start in range(0, min(len(words), PIECES * n), n) if len(words) > start + n]
    y = np.array([k for _, k in aside + pieces])
    raw = np.array([share @ model.logits[rows] + model.bias for rows, share in (_bag(words, memo) for words, _ in aside + pieces)])
    whole = slice(0, len(aside))
    smooth = 1 / (len(aside) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(_softmax(raw[whole] / t), 1e-300))
        own = p[np.arange(len(aside)), y[whole]]
        others = (p.sum(1) - own) / max(1, len(model.languages) - 1)
        return -((1 - smooth) * own + smooth * others).mean()

    model.temperature, model.least = float(min(np.geomspace(0.01, 20, 120), key=loss)), LEAST
    right = raw.argmax(1) == y
    size = np.array([min(SIZES, len(words).bit_length()) - 1 for words, _ in aside + pieces])
    for k in range(SIZES):
        best = raw[right & (size == k)].max(1, initial=-np.inf)
        if len(best):
            model.least_logits[k] = NOVEL * max(0.0, np.quantile(best, LOST, method="lower"))
    return model


def sample(docs: DataFrame, skip: int = 2, modulus: int = 4) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded number of documents outside the fold that is held out."""
    docs = pick(docs, "doc_id", "text", "lang")
    known = docs.filter(F.col("lang").isNotNull() & (fold(modulus) != skip))
    return bounded_sample(known.select("doc_id", F.col("lang").alias("y"), "text"), PER_LANGUAGE, MAX_LANGUAGES)


class Scorer:
    """Scores texts; one per worker and model."""

    def __init__(self, model: Model):
        self.model, self.memo = model, _Memo(model)

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence, and whether that is rejected."""
        words = words_of(text) if text else []
        if not words:
            return "und", 0.0, True
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = _Memo(self.model)
        self.memo.add([w for w in dict.fromkeys(words) if w not in self.memo])
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        sums = self.memo.rows[at].sum(0)
        logits = sums[:-1] / sums[-1] + self.model.bias
        sure = _softmax(logits / self.model.temperature)
        best = int(sure.argmax())
        return self.model.languages[best], float(sure[best]), not self.model.told(sure[best], logits[best], len(words))


class _Memo(dict):
    """For each word the row that holds its summed logits and its number of subwords."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages) + 1))

    def add(self, words: list[str]) -> None:
        """Takes new words in, all at once."""
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            n = len(self)
            while n + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            flat, ends = [], []
            for w in some:
                flat += subwords(w)
                ends.append(len(flat))
            sizes = np.diff(ends, prepend=0)
            self.rows[n : n + len(some), :-1] = np.add.reduceat(self.model.logits[flat], ends - sizes)
            self.rows[n : n + len(some), -1] = sizes
            self.update(zip(some, range(n, n + len(some))))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score and rejected for each whole text."""
    docs = pick(docs, *keep, "text")
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    tag = crc32(model.logits.tobytes())
    schema = f"{', '.join(f'`{k}` {docs.schema[k].dataType.simpleString()}' for k in keep)}, lang_pred string, score double, rejected boolean"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_state(("language", tag), lambda: Scorer(held.value))
        found = [scorer.score(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array([x[j] for x in found], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))], [*keep, "lang_pred", "score", "rejected"])

    return small_batches(docs).mapInArrow(each_slice(work, "text"), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(*sample(docs)))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; rejected ones go."""
    model = train(*sample(docs))
    return kept(docs, lambda flat, names: identify(flat, model, names).filter("NOT rejected"))
