"""

An index stems each distinct word of a block of chunks once (stem_token); stemmed() is for whole texts that aren't indexed, and keeps the stems of words it has met.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import STOPWORDS

CYRILLIC = re.compile("[а-яА-ЯёЁ]")
WORD = re.compile(r"\w+")

# English. Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
UNCHANGED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


#: A vowel and a consonant after it.
_CLOSED, _VOWEL = re.compile(f"[{VOWELS}][^{VOWELS}]"), re.compile(f"[{VOWELS}]")


def _after_first(word: str, start: int, closed: re.Pattern = _CLOSED) -> int:
    """Place after the first consonant that follows a vowel."""
    found = closed.search(word, start)
    return found.end() if found else len(word)


def _by_last(endings) -> dict[str, tuple[str, ...]]:
    """Endings by their last letter, long ones first: words have few letters of an ending, and most words none."""
    out: dict[str, tuple[str, ...]] = {}
    for e in sorted(endings, key=len, reverse=True):
        out[e[-1]] = (*out.get(e[-1], ()), e)
    return out


_POSSESSIVES, _PLURALS, _PARTICIPLES = _by_last(("'", "'s", "'s'")), _by_last(("sses", "ied", "ies", "us", "ss", "s")), _by_last(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_STEP2, _STEP3, _STEP4 = _by_last(STEP2), _by_last(STEP3), _by_last(STEP4)


def _ending(word: str, endings: dict[str, tuple[str, ...]]) -> str | None:
    """The longest ending of a word, of such by their last letter."""
    for e in endings.get(word[-1:], ()):
        if word.endswith(e):
            return e
    return None


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


@lru_cache(200_000)
def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    if "y" in w:
        w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None) if w.startswith(("gener", "commun", "arsen")) else None
    r1 = len(prefix) if prefix else _after_first(w, 0)
    r2 = _after_first(w, r1)
    has_vowel = _VOWEL.search
    if end := _ending(w, _POSSESSIVES):
        w = w[: -len(end)]
    # plurals
    end = _ending(w, _PLURALS)
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in UNCHANGED:
        return w
    # past and present participles
    end = _ending(w, _PARTICIPLES)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if w[-1:] in ("y", "Y") and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # suffixes
    end = _ending(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif end == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = stem + STEP2[end]
    end = _ending(w, _STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _ending(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Russian. Fixed values of the published algorithm; those of the first of two lists must follow а or я.
RU_VOWELS = "аеиоуыэюя"
_RU_CLOSED = re.compile(f"[{RU_VOWELS}][^{RU_VOWELS}]")
GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
REFLEXIVE = ("ся", "сь")
VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _cut(region: str, grouped: tuple[list[str], list[str]]) -> str | None:
    """The region without its longest ending; an ending of the first list must follow а or я within it."""
    end = _longest(region, [*grouped[1], *(e for e in grouped[0] if region[: -len(e)].endswith(("а", "я")))])
    return region[: -len(end)] if end else None


@lru_cache(200_000)
def stem_russian(word: str) -> str:
    word = word.replace("ё", "е")
    at = next((i + 1 for i, c in enumerate(word) if c in RU_VOWELS), None)
    if at is None:
        return word
    r2 = _after_first(word, _after_first(word, 0, _RU_CLOSED), _RU_CLOSED)
    head, rv = word[:at], word[at:]
    if (cut := _cut(rv, GERUND)) is not None:
        rv = cut
    else:
        if end := _longest(rv, REFLEXIVE):
            rv = rv[: -len(end)]
        if end := _longest(rv, ADJECTIVE):
            rv = rv[: -len(end)]
            rv = rv if (cut := _cut(rv, PARTICIPLE)) is None else cut
        elif (cut := _cut(rv, VERB)) is not None:
            rv = cut
        elif end := _longest(rv, NOUN):
            rv = rv[: -len(end)]
    if rv.endswith("и"):
        rv = rv[:-1]
    for end in ("ость", "ост"):
        if rv.endswith(end) and at + len(rv) - len(end) >= r2:
            rv = rv[: -len(end)]
            break
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif end := _longest(rv, ("ейше", "ейш")):
        rv = rv[: -len(end)]
        rv = rv[:-1] if rv.endswith("нн") else rv
    elif rv.endswith("ь"):
        rv = rv[:-1]
    return head + rv


def stem_token(token: str) -> str:
    return stem_russian(token) if CYRILLIC.search(token) else stem_english(token)


def stem_text(text: str) -> str:
    return " ".join(stem_token(w) for w in WORD.findall(text.lower()) if w not in STOPWORDS)


@F.pandas_udf(T.StringType())
def stemmed(texts: pd.Series) -> pd.Series:
    """Stems of the words of each text that aren't stopwords."""
    return texts.map(lambda t: None if t is None else stem_text(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stem of each word of an array."""
    return words.map(lambda ws: None if ws is None else [stem_token(w) for w in ws])
