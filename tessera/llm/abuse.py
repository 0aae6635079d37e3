"""Abusive, hateful or sexual content (problem 10): a weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .lexicon import EXCEPTIONS, LEXICON, NO_SWAP, entries

_HOMOGLYPHS = str.maketrans(
    dict(zip("абвгдеёзийіїјкмнопрсѕтухһԁԛԝьӏꞓαβγεηικμνορτυχωѡ", "a6brdeeeuniijkmhonpcstyxhdqwbice" + "abyenikuvoptuxww"))
)
_HOMOGLYPHS[ord("ß")] = "ss"
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ \-._*]){2,}[^\W_](?![^\W_])")
_SIGNS = re.compile(r"[\W_]")
_TOKEN = re.compile(r"[a-z0-9@$!*]{3,}")
_THRICE = re.compile(r"([a-z])\1\1")
_RUNS = re.compile(r"([a-z*])\1+")
_END = re.compile(r"[.!?]+(?=\s|$)|\n")
_STOP = "\x02"
_REST = re.compile(r"[^a-z0-9\x02]+")
# How near cues must end before an entry, or begin behind it, in characters.
_CUES = {"cue": (0, 25), "call": (0, 1), "echo": (-25, 0)}


class Matcher:
    """The automaton of the lexicon and the exceptions, with the disguised spellings of the lexicon's words."""

    def __init__(self) -> None:
        import ahocorasick

        values: dict[str, tuple] = {}  # entry: (weight, kind)
        marks: dict[str, list] = {}  # entry: its exceptions and cues
        for (kind, weight), text in LEXICON.items():
            for e in entries(text):
                if kind in _CUES:
                    marks.setdefault(e, []).append((kind,))
                elif weight > values.get(e, (0.0,))[0]:
                    values[e] = (weight, kind)
        for rule, text in EXCEPTIONS.items():
            for e in entries(text):
                marks.setdefault(e, []).append(rule)
        self.weights = {e: w for e, (w, _) in values.items()}
        self.cue_weight = {kind: w for kind, w in LEXICON if kind in _CUES}
        words = sorted({w for e in self.weights for w in e.split() if len(w) >= 3})
        self.words = set(words)
        self.collapsed = {_RUNS.sub(r"\1", w): w for w in words}
        self.starred: dict[str, str] = {}
        self.swapped: dict[str, str] = {}
        real = self.words | {w for e in marks for w in e.split()} | set(entries(NO_SWAP))
        for w in words:
            if len(w) >= 5 or w in self.weights:
                for i in range(len(w) - 1):
                    v = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                    if v not in real:
                        self.swapped.setdefault(v, w)
        for drop in (1, 0, 2):  # a star for one letter is likelier than a star too many or for two letters
            for w in sorted(words, key=lambda w: (w not in self.weights, w)):
                for i in range(1, len(w) - drop + 1):
                    if len(w) - drop >= 2:
                        self.starred.setdefault(w[:i] + "*" + w[i + drop :], w)
        self.auto = ahocorasick.Automaton()
        for e in values.keys() | marks.keys():
            self.auto.add_word(f" {e} ", (len(e), *values.get(e, (0.0, None)), marks.get(e, ()), e))
        self.auto.make_automaton()
        self._plain = lru_cache(1 << 16)(self._plain_of)

    def _spelled(self, m) -> str:
        """Letters written apart: the word they make, if need be without single-letter words before or behind it."""
        s = _SIGNS.sub("", m[0]).translate(_LEET)
        for a, b in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2)):
            if (cut := s[a : len(s) - b]) in self.words:
                return f" {cut} "
        return f" {s} " if len(s) >= 4 and " " not in m[0] else m[0]

    def _plain_of(self, token: str) -> str:
        """The word of the lexicon that a token stands for, or the token."""
        if token in self.words:
            return token
        t = token
        if not t.isalpha():
            t = _RUNS.sub(lambda r: "*" if r[1] == "*" else r[0], t).strip("!")
            if not any(c.isalpha() for c in t):
                return token
            t = t.translate(_LEET)
            if "*" in t.strip("*"):
                return self.starred.get(t) or self.starred.get(t.strip("*")) or token
            t = t.strip("*")
        if t not in self.words and _THRICE.search(t):
            t = self.collapsed.get(_RUNS.sub(r"\1", t), t)
        t = self.swapped.get(t, t)
        return t if t in self.words else token

    def _letters(self, text: str) -> str:
        """Lower case without accents, homoglyphs, disguised, spaced-out or stretched words and letter swaps."""
        t = text
        if not t.isascii():
            t = "".join(_INVISIBLE.split(unicodedata.normalize("NFKD", t))).lower()
            t = _FOREIGN.sub(lambda m: m[0].translate(_HOMOGLYPHS), t)
        else:
            t = t.lower()
        t = _SPELLED.sub(self._spelled, t)
        plain = self._plain
        changed = {x: y for x in set(_TOKEN.findall(t)) if (y := plain(x)) != x}
        return _TOKEN.sub(lambda m: changed.get(m[0], m[0]), t) if changed else t

    def fold(self, text: str, ends: bool = False) -> str:
        """The text's letters and digits, all else as blanks; with ``ends`` a mark stands at the end of each sentence and line."""
        return self._blanks(self._letters(text), ends)

    def _blanks(self, t: str, ends: bool) -> str:
        return " " + _REST.sub(" ", _END.sub(f" {_STOP} ", t) if ends else t) + " "

    def score(self, text: str | None, window: int = 120) -> tuple[float, float, int]:
        """(peak, density, hits): the most weight of different entries within ``window`` characters, all weight for each
        hundred words, and the number of matches. Null and empty texts score 0."""
        if not text:
            return 0.0, 0.0, 0
        letters = self._letters(text)
        if not any(x[1] for _, x in self.auto.iter(self._blanks(letters, False))):
            return 0.0, 0.0, 0
        t = self._blanks(letters, True)
        found, void, cues = [], [], []
        for end, (size, weight, kind, marks, e) in self.auto.iter(t):
            s = end - size
            if weight:
                found.append((s, end, weight, kind, e))
            for m in marks:
                if m[0] in _CUES:
                    cues.append((s, end, m[0]))
                else:
                    lo, hi = max(s - m[1], t.rfind(_STOP, 0, s)), end + m[2]
                    stop = t.find(_STOP, end)
                    void.append((lo if m[1] else s, min(hi, stop) if stop >= 0 else hi, m[0], m[3], e))
        kept = [
            (s, end, w, kind, e)
            for s, end, w, kind, e in found
            if not any(lo <= s <= hi and kind in kinds and w <= most and e not in x for lo, hi, kinds, most, x in void)
        ]
        if not kept:
            return 0.0, 0.0, 0
        # A longer entry that holds a shorter one speaks for both.
        kept = [x for x in kept if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in kept)]
        meant = [
            max((self.cue_weight[k] for s, end, k in cues if _CUES[k][0] <= (a - end if k != "echo" else b - s) <= _CUES[k][1]), default=0.0)
            for a, b, *_ in kept
        ]
        peak = 0.0
        for i, (s, *_) in enumerate(kept):
            near: dict[str, tuple[float, str]] = {}
            cue = 0.0
            for (s2, _, w2, kind, e2), c in zip(kept[i:], meant[i:]):
                if s2 - s > window:
                    break
                near[e2] = (w2, kind)
                cue = max(cue, c)
            # Nouns that a group is likened to are often meant literally: one of them counts, however many there are.
            likened = max([w for w, kind in near.values() if kind == "hate" and w == 0.6], default=0.0)
            peak = max(peak, cue + likened + sum(w for w, kind in near.values() if kind != "hate" or w != 0.6))
        return peak, 100.0 * sum(x[2] for x in kept) / max(1, t.count(" ") - 1), len(kept)


_matcher: list[Matcher] = []


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, peak, density, hits): how abusive, hateful or sexual each text is.

    The text is folded (case, accents, homoglyphs, invisible characters, digits and signs for letters, letters written
    apart, stretched or swapped) and matched against the weighted lexicon in one pass; matches near a phrase of
    EXCEPTIONS don't count. peak is the weight found within a window of fixed length, so it doesn't depend on the length of
    the text; density is all weight for each hundred words. Null and empty texts score 0. Every input row gives one
    row, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _matcher:
            _matcher.append(Matcher())
        for b in batches:
            peak, density, hits = zip(*[_matcher[0].score(t) for t in b.column("text").to_pylist()]) if b.num_rows else ([],) * 3
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("source"),
                    pa.array(peak, pa.float64()),
                    pa.array(density, pa.float64()),
                    pa.array(hits, pa.int64()),
                ],
                names=["doc_id", "source", "peak", "density", "hits"],
            )

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).mapInArrow(
        run, "doc_id long, source string, peak double, density double, hits long"
    )


def abusive_documents(documents: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(doc_id) of the texts whose peak reaches the threshold."""
    return score_documents(documents).where(F.col("peak") >= threshold - 1e-9).select("doc_id")


def rates_by_source(documents: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(source, documents, abusive, rate, mean_density) for each source (null is one); pre-aggregated, so a source with a
    third of all texts is no hot task."""
    flag = (F.col("peak") >= threshold - 1e-9).cast("long")
    return score_documents(documents).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(flag).alias("abusive"), F.avg(flag).alias("rate"), F.avg("density").alias("mean_density")
    )
