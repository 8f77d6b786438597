"""Operator 3: toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks, trained on sentences.

Kernel. Two words are alike by the subsequences of two to four characters that they share; a subsequence may have gaps and counts less the
longer it spans. So an insult with inserted characters, or with another ending, stays near the insult. Spans are bounded and subsequences
hashed, which keeps the kernel positive definite and its feature map explicit. A point of the machine is a word in its sentence: the kernel of two points is that of their words, plus
that of their sentences, which is the mean over the pairs of their words. So a word counts as what it is, and its sentence counts for and against it. Letters set apart by blanks,
and neighbours of which one is a fragment, are read as one word, too; digits and signs that stand for letters are read as those.

Sentences. Texts are cut at sentence ends and lines, and sentences of more than WINDOW words into overlapping windows. Labels are of documents: every word of every sentence of a
clean document is clean, and a toxic document has a witness, the word in a sentence that scores highest, chosen anew after each training (multiple instances). Words of many toxic
documents and no clean one are witnesses in any sentence, and so are forms of them with characters put in (virtual examples). One character put in, and marks, blanks or look-alikes at any number of places, leave an insult an insult; letters put in at many places mostly do not.

Landmarks. For words those most tied to toxic training documents, such forms of them, and the most common words of clean ones; for sentences the latter. The inverse square roots of the
landmarks' kernel matrices map a point to as many coordinates as there are landmarks; a linear machine with squared hinge loss is trained there. A sentence's value is the most of its
words' plus its own; a document scores the maximum over its sentences, turned into a probability by a sigmoid that is fitted to documents of the learning fold that a first machine
wasn't trained on; then the machine is trained on all of them.

Only a bounded sample is learned from: MAX_TOXIC and MAX_CLEAN labelled documents, those with the least hash of the id, and SAMPLE_BYTES. Since the machine is
linear in the features, landmarks and weights collapse into two tables of a fixed size that are broadcast, and workers keep the values of words. Scoring reads every text whole.

Defined results: null and empty texts, and texts without letters or digits, score as a clean word at the margin (value -1); words like none that was learned from count as clean; equal texts
score equally; null ids are never learned from and aren't held out; without labels of both kinds every score is 0; labels of one id that
differ count as toxic if any is; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, each_slice, fold, give_back, kept, pick, small_batches, table, worker_state

MAX_TOXIC, MAX_CLEAN = 1000, 1400
#: One in so many documents of the sample is set aside for the sigmoid.
ASIDE = 3
#: Clean words that the machine starts with, and at most so many more that it errs on in each round.
ACTIVE, MINED = 10_000, 5_000
TOXIC_LANDMARKS, VIRTUAL_LANDMARKS, CLEAN_LANDMARKS, ROUNDS = 160, 48, 64, 5
RIDGE, COST, SURE = 1.0, 3.0, 0.1
#: What a word without any like subsequence costs.
STRANGE = 1000.0
#: What a sentence's coordinates count for.
CONTEXT = 0.5
BUCKETS_LOG, DECAY, SPANS = 18, 0.85, {2: 2, 3: 4, 4: 4}
THRESHOLD, WORDLESS = 0.7, -1.0
#: Longer words are read in overlapping windows, and so are sentences of more words than WINDOW.
LONGEST, WINDOW = 28, 32
#: Characters that virtual examples have put in.
PUT_IN = "xqzjkvw"
#: Neighbours are joined where one has at most FRAGMENT letters and both together at most JOINED.
FRAGMENT, JOINED = 3, 8
#: Tokens that a worker keeps, and bytes of text that it takes at once.
MEMO_ENTRIES, STEP = 200_000, 1 << 20

#: (offsets, weight) of the gapped subsequences; the last offset is bounded by SPANS, but for four characters with one put in between any two.
OFFSETS = [(0, *mid, last) for p, widest in SPANS.items() for last in range(p - 1, widest + 1) for mid in combinations(range(1, last), p - 2)] + [(0, 2, 4, 6)]
PATTERNS = [(x, DECAY ** (x[-1] + 1 - len(x))) for x in OFFSETS]
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

NOISE = re.compile(r"[\W_]+")
LINES = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: What stands for letters in a word that has some.
STANDS = str.maketrans("013457@$", "oieastas")
LETTER = re.compile(r"[^\W\d_]")
END = re.compile(r"[.!?…]+[\"')\]»”]*$")
#: Stands between lines.
LINE = "\0"


def units_of(token: str) -> list[str]:
    """Words of a token: letters and digits in lower case, long ones in windows."""
    word = token.lower()
    if not word.isalpha():
        word = NOISE.sub("", word.translate(STANDS) if LETTER.search(word) else word)
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@dataclass(slots=True)
class Token:
    """What a token is: its words, its letters and digits, whether it has nothing else, and whether a sentence ends with it."""

    units: list[str]
    size: int
    plain: bool
    end: bool

    @classmethod
    def of(cls, token: str) -> "Token":
        if token.isalpha():
            return cls(units_of(token), len(token), True, False)
        return cls(units_of(token), len(NOISE.sub("", token)), False, token == LINE or bool(END.search(token)))


def tokens_of(text: str | None) -> list[str]:
    return LINES.sub(f" {LINE} ", text).split() if text else []


def sentences(tokens: list[str], kinds: list[Token]) -> list[tuple[list[str], list[str]]]:
    """The tokens of each sentence, or of each window of a long one, and what is read as a word besides: neighbours of which one is a fragment, and runs of three or more single
    letters. A window is two blocks of WINDOW // 2 tokens; what is read besides is in the block in which it starts."""
    out, start, runs = [], 0, {}
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and kinds[j].size == 1:
            j += 1
        if j - i >= 3:
            runs[i] = " ".join(tokens[i:j])
        i = max(i + 1, j)
    for i in range(len(tokens)):
        if not (kinds[i].end or i + 1 == len(tokens)):
            continue
        last = i + (tokens[i] != LINE)
        blocks = []
        for at in range(start, last, WINDOW // 2):
            here = range(at, min(last, at + WINDOW // 2))
            pairs = [tokens[k] + tokens[k + 1] for k in here if k + 1 < last and kinds[k].plain and min(kinds[k].size, kinds[k + 1].size) <= FRAGMENT and kinds[k].size + kinds[k + 1].size <= JOINED]
            blocks.append(([tokens[k] for k in here], pairs + [runs[k] for k in here if k in runs]))
        out += [(a + b, c + d) for (a, c), (b, d) in zip(blocks, blocks[1:])] or blocks
        start = i + 1
    return out


def disguised(word: str) -> list[str]:
    """Forms of a word with a character put in at one place, at every other, and at every place."""
    once = [word[:i] + PUT_IN[i % len(PUT_IN)] + word[i:] for i in range(1, len(word))]
    several = ["".join(c + (PUT_IN[(i + k) % len(PUT_IN)] if (i + k) % step == 0 else "") for i, c in enumerate(word[:-1])) + word[-1] for step, turns in ((2, 2), (1, 4)) for k in range(turns)]
    return list(dict.fromkeys(once + several))


def features(units: list[str]):
    """For each pattern: the unit, hash bucket and weight of its subsequences. Units are taken with marks at both ends, and weighted so that a
    unit's own kernel value is about 1."""
    lengths = np.array([len(u) + 2 for u in units], np.int64)
    chars = np.frombuffer("".join(f"\2{u}\3" for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    unit = np.repeat(np.arange(len(units)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    own = sum(np.maximum(lengths - offsets[-1], 0) * weight**2 for offsets, weight in PATTERNS)
    scale = 1 / np.sqrt(np.maximum(own, 1e-9))
    for offsets, weight in PATTERNS:
        at = np.nonzero(left > offsets[-1])[0]
        code = np.full(len(at), len(offsets), np.uint64)
        for k, offset in enumerate(offsets):
            code = (code + chars[at + offset]) * _MULTIPLIERS[k]
            code ^= code >> np.uint64(29)
        bucket = ((code * _MULTIPLIERS[0]) >> np.uint64(64 - BUCKETS_LOG)).astype(np.int64)
        yield unit[at], bucket, weight * scale[unit[at]]


def weigh(units: list[str], *weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each unit's features, a row for each table of weights."""
    out = np.zeros((len(weights), len(units)))
    for unit, bucket, x in features(units) if units else ():
        for row, table_ in zip(out, weights):
            row += np.bincount(unit, x * table_.take(bucket), len(units))
    return out


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of units and landmarks."""
    place = np.full(1 << BUCKETS_LOG, -1, np.int64)
    rows = [(u, b, x) for u, b, x in features(landmarks)]
    used = np.unique(np.concatenate([b for _, b, _ in rows]))
    place[used] = np.arange(len(used))
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    for u, b, x in rows:
        np.add.at(dense, (place[b], u), x)
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for start in range(0, len(units), 200):
        for u, b, x in features(units[start : start + 200]):
            hit = place[b] >= 0
            u, rows = u[hit] + start, dense[place[b[hit]]] * x[hit, None].astype(np.float32)
            if len(u):
                first = np.nonzero(np.concatenate([[True], u[1:] != u[:-1]]))[0]
                out[u[first]] += np.add.reduceat(rows, first)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of words, by hash bucket
    context: np.ndarray  # of words of the sentence, by hash bucket
    bias: float
    slope: float
    shift: float

    def probability(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500))))


def _machine(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of least squared hinge loss by Newton's method, for points in several arrays; a step is halved until it lowers the loss. Points are
    taken some at a time, so that little memory is used besides theirs."""
    pieces, at = [], 0
    for part in parts:
        for start in range(0, len(part), 2048):
            pieces.append((at + start, part[start : start + 2048]))
        at += len(part)
    width = parts[0].shape[1]
    ridge = np.full(width + 1, RIDGE)
    ridge[-1] = 1e-3
    w, made = np.zeros(width + 1), np.zeros(at)
    loss = lambda v, made: float((ridge * v * v).sum() / 2 + (cost * np.maximum(0, 1 - y * made) ** 2).sum())
    now = loss(w, made)
    for _ in range(40):
        gap = 1 - y * made
        gradient, curve = ridge * w, np.diag(ridge)
        for start, x in pieces:
            on = np.nonzero(gap[start : start + len(x)] > 0)[0]
            if len(on):
                xa, c = np.concatenate([x[on].astype(np.float64), np.ones((len(on), 1))], 1), cost[start + on]
                gradient -= 2 * xa.T @ (c * y[start + on] * gap[start + on])
                curve += 2 * xa.T @ (c[:, None] * xa)
        step = np.linalg.solve(curve, gradient)
        along = np.concatenate([x @ step[:-1].astype(x.dtype) for _, x in pieces]) + step[-1]
        size = 1.0
        while size > 1e-4 and (then := loss(w - size * step, made - size * along)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-7 * now:
            break
        w, made, now = w - size * step, made - size * along, then
    return w


def _sigmoid(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss, with Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
        g = np.array([((p - target) * values).sum() + 1e-3 * a, (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * values**2).sum() + 1e-3, (q * values).sum()], [(q * values).sum(), q.sum()]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(a, 1e-6)), float(b)


def _collapsed(landmarks: list[str], beta: np.ndarray) -> np.ndarray:
    """Weights of hash buckets that give the same sums as beta on the kernel values of landmarks."""
    weights = np.zeros(1 << BUCKETS_LOG)
    for u, b, x in features(landmarks):
        np.add.at(weights, b, x * beta[u])
    return weights.astype(np.float32)


def _root(landmarks: list[str]) -> np.ndarray:
    own, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(own, 1e-3))) @ vectors.T


class _Space:
    """Coordinates of words and of sentences in their landmarks; those of words are kept."""

    def __init__(self, names: list[str], landmarks: list[str]):
        self.names, self.landmarks, self.root = names, landmarks, _root(landmarks)
        self.at, self.rows = np.full(len(names), -1, np.int32), np.zeros((0, len(landmarks)), np.float32)

    def words(self, words: np.ndarray) -> np.ndarray:
        new = np.unique(words[self.at[words] < 0])
        if len(new):
            self.at[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            made = [(kernel([self.names[i] for i in new[k : k + 4096]], self.landmarks) @ self.root).astype(np.float32) for k in range(0, len(new), 4096)]
            self.rows = np.concatenate([self.rows, *made])
        return self.rows[self.at[words]]

    def means(self, sentences: list[np.ndarray]) -> np.ndarray:
        self.words(np.unique(np.concatenate(sentences)))
        out = np.zeros((len(sentences), len(self.landmarks)), np.float32)
        for row, s in zip(out, sentences):
            row += self.rows[self.at[s]].mean(0)
        return out

    def collapsed(self, w: np.ndarray) -> np.ndarray:
        return _collapsed(self.landmarks, self.root @ w)


class _Sample:
    """Words as numbers; sentences as arrays of them; documents as lists of sentences, and of what is read as a word besides."""

    def __init__(self, texts: list[str]):
        known: dict[str, Token] = {}
        number: dict[str, int] = {}
        self.docs: list[list[np.ndarray]] = []
        self.besides: list[list[np.ndarray]] = []
        for text in texts:
            tokens = tokens_of(text)
            for t in tokens:
                if t not in known:
                    known[t] = Token.of(t)
            found = []
            for pair in sentences(tokens, [known[t] for t in tokens]):
                for t in pair[1]:
                    if t not in known:
                        known[t] = Token.of(t)
                found.append([np.array([number.setdefault(u, len(number)) for t in part for u in known[t].units], np.int32) for part in pair])
            self.docs.append([a for a, _ in found if len(a)])
            self.besides.append([b for a, b in found if len(a)])
        self.names = list(number)


def train(texts: list[str], labels: list[int]) -> Model | None:
    sample = _Sample(texts)
    give_back()
    # A text's part follows from its hash; equal texts are in the same part.
    aside = np.array([crc32(t.encode()) % ASIDE == 0 for t in texts], bool)
    y = np.array(labels, int)
    filled = np.array([bool(d) for d in sample.docs], bool)
    model = None
    if all((filled & (y == k) & part).any() for k in (0, 1) for part in (aside, ~aside)):
        model = _machine_of(sample, y, ~aside)
    values = None
    if model is not None:
        fitted = np.nonzero(aside)[0]
        values = Scorer(model).values([texts[i] for i in fitted])
        scale = _sigmoid(np.array(values), y[fitted].astype(float))
        model = None
        give_back()
    model = _machine_of(sample, y, np.ones(len(texts), bool))
    if model is not None:
        # Too few to set some aside: the sigmoid is fitted to what the machine was trained on.
        model.slope, model.shift = scale if values is not None else _sigmoid(np.array(Scorer(model).values(texts)), y.astype(float))
    return model


def _machine_of(sample: _Sample, labels: np.ndarray, chosen: np.ndarray) -> Model | None:
    """A machine trained on some documents."""
    toxic, clean = ([d for d, k, on in zip(sample.docs, labels, chosen) if on and d and k == y] for y in (1, 0))
    beside = [d for d, k, on in zip(sample.besides, labels, chosen) if on and d and not k]
    if not toxic or not clean:
        return None
    names, n = list(sample.names), len(sample.names)
    of_toxic, of_clean = (np.bincount(np.concatenate([np.unique(np.concatenate(d)) for d in ds]), minlength=n) for ds in (toxic, clean))
    share = (of_toxic + 0.1) / (len(toxic) + 1) / ((of_clean + 0.1) / (len(clean) + 1))
    order = sorted(np.nonzero(of_toxic)[0].tolist(), key=lambda i: (-of_toxic[i] * np.log(share[i]), names[i]))
    rank = np.full(n, n)
    rank[order] = np.arange(len(order))
    sure = [i for i in order if not of_clean[i] and of_toxic[i] >= max(4, SURE * len(toxic))]
    virtual = list(dict.fromkeys(v for i in sure if len(names[i]) > 3 for v in disguised(names[i])))
    known = {u for u, k in zip(names, of_clean) if k}
    virtual = [v for v in virtual if v not in known]
    # What is put in counts for nothing by itself.
    names += virtual + [c * k for c in PUT_IN for k in (3, 8, LONGEST)]
    common = sorted(np.nonzero(of_clean)[0].tolist(), key=lambda i: (-of_clean[i], names[i]))
    marks = [names[i] for i in common[:CLEAN_LANDMARKS]]
    focus = _Space(names, list(dict.fromkeys([names[i] for i in order[:TOXIC_LANDMARKS]] + virtual[:: len(virtual) // VIRTUAL_LANDMARKS + 1] + marks)))
    around = _Space(names, marks)
    places: list[np.ndarray] = []  # the sentences

    def pairs(docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Words, their sentences' numbers, and where each document starts."""
        words, at, starts = [], [], []
        for d in docs:
            starts.append(sum(map(len, words[-1:])) + (starts[-1] if starts else 0))
            words.append(np.concatenate(d))
            at.append(np.repeat(np.arange(len(places), len(places) + len(d)), [len(s) for s in d]))
            places.extend(d)
        return np.concatenate(words), np.concatenate(at), starts

    t_word, t_place, starts = pairs(toxic)
    c_word, c_place, _ = pairs(clean)
    # What clean documents' sentences have besides is clean, too.
    at = [np.repeat(i + c_place[0], len(b)) for i, b in enumerate(b for d in beside for b in d)]
    c_word, c_place = np.concatenate([c_word, *(b for d in beside for b in d)]), np.concatenate([c_place, *at])
    flat, sizes = np.concatenate(places), np.array([len(s) for s in places])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # A clean word is taken in the first sentence that has it; one that is tied to toxic documents in all of them.
    _, first = np.unique(c_word, return_index=True)
    take = np.zeros(len(c_word), bool)
    take[first] = True
    take |= (share > 1)[c_word] & (of_toxic > 0)[c_word]
    c_word, c_place = c_word[take], c_place[take]
    by = np.argsort(-of_clean[c_word], kind="stable")
    c_word, c_place = c_word[by], c_place[by]
    # A toxic document's words that no clean one has, or few in comparison: others can't be witnesses.
    candidates = []
    for a, b in zip(starts, [*starts[1:], len(t_word)]):
        own = np.arange(a, b)
        for fits in (of_clean[t_word[a:b]] == 0, share[t_word[a:b]] > 1, np.ones(b - a, bool)):
            if fits.any():
                candidates.append(own[fits])
                break
    witness = np.array([c[np.argmin(rank[t_word[c]])] for c in candidates])

    def points(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([focus.words(words), CONTEXT * around.means([places[i] for i in at])], 1)

    active = np.zeros(len(c_word), bool)
    active[:ACTIVE] = True
    low, m = [points(c_word[active], c_place[active])], len(focus.landmarks)
    fixed = np.array([*sure, *range(n, n + len(virtual))], np.int64)
    strange = focus.words(np.arange(n + len(virtual), len(names)))
    strange = np.concatenate([np.concatenate([strange, np.zeros((len(strange), len(around.landmarks)), np.float32)], 1), np.zeros((1, m + len(around.landmarks)), np.float32)])
    fixed_points = np.concatenate([focus.words(fixed), np.tile(low[0][:, m:].mean(0), (len(fixed), 1))], 1)
    fixed_cost = np.array([9.0 * COST] * len(sure) + [COST] * len(virtual))
    for _ in range(ROUNDS):
        words = t_word[witness]
        cost = np.concatenate([COST / np.sqrt(np.bincount(words, minlength=n)[words]), fixed_cost, np.ones(n_low := sum(map(len, low))), np.full(len(strange), 5.0 * COST)])
        cost[-1] = STRANGE
        y = np.concatenate([np.ones(len(witness) + len(fixed)), -np.ones(n_low + len(strange))])
        # The last is a word like no landmark, in a sentence of such words: it is clean.
        w = _machine([points(words, t_place[witness]), fixed_points, *low, strange], y, cost)
        model = Model(focus.collapsed(w[:m]), around.collapsed(CONTEXT * w[m:-1]), float(w[-1]), 1.0, 0.0)
        own, by_word = np.concatenate([weigh(names[i : min(n, i + 10_000)], model.weights, model.context) for i in range(0, n, 10_000)], 1)
        sentence = np.add.reduceat(by_word[flat], firsts) / sizes
        of_toxic_pairs = own[t_word] + sentence[t_place]
        again = np.array([c[np.argmax(of_toxic_pairs[c])] for c in candidates])
        off = own[c_word] + sentence[c_place] + model.bias
        off[active] = -np.inf
        worst = np.argsort(-off, kind="stable")[:MINED]
        worst = worst[off[worst] > -1]
        if (again == witness).all() and not len(worst):
            break
        witness = again
        if len(worst):
            active[worst] = True
            low.append(points(c_word[worst], c_place[worst]))
    return model


class _Known(dict):
    """Numbers of tokens, and what the model makes of each."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.fresh = model, []
        self.own, self.around, self.size = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.plain, self.end, self.filled = (np.zeros(0, bool) for _ in range(3))

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.fresh.append(token)
        return n

    def learn(self) -> None:
        """Values of the tokens that are new."""
        for start in range(0, len(self.fresh), 20_000):
            kinds = [Token.of(t) for t in self.fresh[start : start + 20_000]]
            units = list(dict.fromkeys(u for k in kinds for u in k.units))
            number = dict(zip(units, range(len(units))))
            own, around = weigh(units, self.model.weights, self.model.context)
            flat = np.array([number[u] for k in kinds for u in k.units], np.int64)
            n = np.fromiter((len(k.units) for k in kinds), np.int64, len(kinds))
            some, first = n > 0, np.cumsum(n) - n
            values, means = np.full(len(kinds), -np.inf), np.zeros(len(kinds))  # a token without letters or digits is no word
            if len(flat):
                values[some] = np.maximum.reduceat(own[flat], first[some])
                means[some] = np.add.reduceat(around[flat], first[some]) / n[some]
            self.own, self.around = np.concatenate([self.own, values]), np.concatenate([self.around, means])
            self.size = np.concatenate([self.size, [k.size for k in kinds]])
            self.plain, self.end = np.concatenate([self.plain, [k.plain for k in kinds]]), np.concatenate([self.end, [k.end for k in kinds]])
            self.filled = np.concatenate([self.filled, some])
        self.fresh = []


class Scorer:
    """Margins of texts; one per worker and model. What it does for all tokens of some texts at once is what sentences() says."""

    def __init__(self, model: Model):
        self.model, self.known = model, _Known(model)

    def values(self, texts: list[str | None]) -> list[float]:
        if len(self.known) > MEMO_ENTRIES:
            self.known = _Known(self.model)
        known = self.known
        tokens = [[*tokens_of(t), LINE] for t in texts]
        sizes = np.array([len(t) for t in tokens])
        flat = list(chain.from_iterable(tokens))
        at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        mark = known[LINE]
        known.learn()
        size, end, line = known.size[at], known.end[at], at == mark
        # Blocks: sentences are numbered, and cut by the place of a token within.
        sentence = np.cumsum(end) - end
        first = np.searchsorted(sentence, sentence)
        place = (np.arange(len(at)) - first) // (WINDOW // 2)
        word = ~line
        opens = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (place[1:] != place[:-1])])
        block = np.cumsum(opens) - 1
        starts = np.nonzero(opens)[0]
        sums = np.add.reduceat(np.where(word, known.around[at], 0.0), starts)
        counts = np.add.reduceat((word & known.filled[at]).astype(np.int64), starts)
        words = np.add.reduceat(word.astype(np.int64), starts)
        most = np.maximum.reduceat(np.where(word, known.own[at], -np.inf), starts)
        # Neighbours.
        a, b = at[:-1], at[1:]
        fits = known.plain[a] & word[:-1] & word[1:] & ~end[:-1] & (np.minimum(size[:-1], size[1:]) <= FRAGMENT) & (size[:-1] + size[1:] <= JOINED)
        where = np.nonzero(fits)[0]
        extra: list[tuple[int, str]] = []
        if len(where):
            codes, back = np.unique(a[where] << 32 | b[where], return_inverse=True)
            one = where[np.unique(back, return_index=True)[1]].tolist()
            numbers = np.array([known[flat[i] + flat[i + 1]] for i in one], np.int64)
            known.learn()
            np.maximum.at(most, block[where], known.own[numbers][back])
        # Runs of single letters.
        single = np.concatenate([[False], (size == 1) & word, [False]]).astype(np.int8)
        edge = np.diff(single)
        for i, j in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
            if j - i >= 3:
                extra.append((block[i], " ".join(flat[i:j])))
        if extra:
            numbers = np.array([known[t] for _, t in extra], np.int64)
            known.learn()
            np.maximum.at(most, np.array([k for k, _ in extra]), known.own[numbers])
        # Windows: two blocks of a sentence, or its only one.
        pair = sentence[starts][1:] == sentence[starts][:-1]
        # A line's end is in its sentence's last block, by itself if that was full.
        pair &= words[1:] > 0
        alone = np.concatenate([[True], ~pair]) & np.concatenate([~pair, [True]]) & (words > 0)
        value = np.full(len(starts), -np.inf)
        value[alone] = most[alone] + sums[alone] / np.maximum(1, counts[alone])
        k = np.nonzero(pair)[0]
        value[k] = np.maximum(most[k], most[k + 1]) + (sums[k] + sums[k + 1]) / np.maximum(1, counts[k] + counts[k + 1])
        best = np.maximum.reduceat(value, block[np.cumsum(sizes) - sizes])
        return np.where(np.isfinite(best), best + self.model.bias, WORDLESS).tolist()


def sample(docs: DataFrame, labels: DataFrame, skip: int = 1, modulus: int = 3) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded number of documents outside the fold that is held out."""
    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    known = labels.filter(F.col("toxic").isNotNull() & (fold(modulus) != skip)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = docs.select("doc_id").distinct().join(known, "doc_id")
    least = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    ids = least[0].unionByName(least[1])
    return bounded_sample(docs.join(F.broadcast(ids), "doc_id"), max(MAX_TOXIC, MAX_CLEAN), 2)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """keep, score and predicted for each whole text."""
    docs = pick(docs, *keep, "text")
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    tag = crc32(model.weights.tobytes())
    schema = f"{', '.join(f'`{k}` {docs.schema[k].dataType.simpleString()}' for k in keep)}, score double, predicted int"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_state(("toxicity", tag), lambda: Scorer(held.value))
        found = [held.value.probability(v) for v in scorer.values(part.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], [*keep, "score", "predicted"])

    return small_batches(docs).mapInArrow(each_slice(work, "text", STEP), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(*sample(docs, table(spark, sf_dir, "labels"))))
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic."""
    model = train(*sample(docs, table(spark, sf_dir, "labels")))
    return kept(docs, lambda flat, names: score(flat, model, names).filter("predicted = 0"))
