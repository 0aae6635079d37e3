"""Stemming of words for text search: the published Snowball algorithms for English, German and Dutch.

Words are stemmed once per distinct word of a batch, as vocabularies are small against texts.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first non-vowel that follows a vowel, and the same again within R1."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in vowels and w[i - 1] in vowels:
                return i + 1
        return len(w)

    r1 = after(0)
    return r1, after(r1)


def _longest(w: str, suffixes: tuple[str, ...] | list[str]) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


# Fixed values of the English algorithm: irregular words, words that stay, replacements of endings.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_EN = "aeiouy"


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _EN and w[1] not in _EN
    return len(w) > 2 and w[-1] not in _EN + "wxY" and w[-2] in _EN and w[-3] not in _EN


def english(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = re.match(r"gener|commun|arsen", w)
    r1, r2 = _regions(w, _EN)
    if head:
        r1 = head.end()
        r2 = r1 + _regions(w[r1:], _EN)[0]
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(f"[{_EN}]", w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{_EN}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif _short_end(w) and len(w) <= r1:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN:
        w = w[:-1] + "i"
    s = _longest(w, list(_STEP2))
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l")) and not (s == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + _STEP2[s]
    s = _longest(w, list(_STEP3))
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _STEP3[s]
    s = _longest(w, _STEP4)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = re.sub(f"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), word.replace("ß", "ss"))
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and not (s == "s" and w[-2:-1] not in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and not (s == "st" and (w[-3:-2] not in tuple("bdfghklmnt") or len(w) < 6)):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        before = w[: -len(s)]
        if s in ("end", "ung"):
            w = before
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = w if before.endswith("e") else before
        elif s in ("lich", "heit"):
            w = before
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = before
            more = _longest(w, ("lich", "ig"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{v}])y|(?<=[{v}])i(?=[{v}])", lambda m: m[0].upper(), w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))

    def undouble(x: str) -> str:
        return x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def without_en(x: str, n: int) -> str:
        before = x[:-n]
        ok = len(before) >= r1 and before and before[-1] not in v and not before.endswith("gem")
        return undouble(before) if ok else x

    def without_e(x: str) -> tuple[str, bool]:
        ok = x.endswith("e") and len(x) - 1 >= r1 and x[-2:-1] not in tuple(v)
        return (undouble(x[:-1]), True) if ok else (x, False)

    s = _longest(w, ("heden", "en", "ene", "s", "se"))
    if s == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = without_en(w, len(s))
    elif s and len(w) - len(s) >= r1 and w[: -len(s)][-1:] not in tuple(v + "j"):
        w = w[: -len(s)]
    w, gone = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = without_en(w, 2)
    s = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        before = w[: -len(s)]
        if s in ("end", "ing"):
            w = before
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
            else:
                w = undouble(w)
        elif s == "ig":
            w = w if before.endswith("e") else before
        elif s == "lijk":
            w = without_e(before)[0]
        elif s == "baar" or gone:
            w = before
    if re.search(r"[^aeiouyè](aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "dutch": dutch}


def stem(word: Column, language: str) -> Column:
    """The stem of each word; of a language without a stemmer here the word itself."""
    if language not in STEMMERS:
        return word

    def run(words: pd.Series) -> pd.Series:
        stemmer = importlib.import_module("tessera.functions.stemming").cached(language)  # the executor's own, with its cache
        return words.map(lambda x: None if x is None else stemmer(x))

    return F.pandas_udf(run, T.StringType())(word)


@cache
def cached(language: str) -> Callable[[str], str]:
    return lru_cache(1 << 16)(STEMMERS[language])


