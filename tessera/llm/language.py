"""Missing or wrong language labels, and texts in several languages (problem 5): bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_size
from .splitting import valid_documents
from ..functions.text import fold_name
from ..runtime import materialize, spread

LANGUAGES = ("en", "fr", "nl", "de", "es", "pt")

_SPACE, _BREAK, _SKIP = 1, 2, 3


def _classes(size: int = 0x250) -> np.ndarray:
    """For each code point its base letter in lower case, or one of the classes above."""
    out = np.full(size, _BREAK, dtype=np.uint32)
    for i in range(size):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[0]
            out[i] = ord(base) if base.isalpha() else ord(c.lower()[0])
        elif c in "  '-,´`" or c.isdigit():
            out[i] = _SPACE
    out[0xAD] = _SKIP
    return out


_CLASS = _classes()
_MULT = np.uint64(0x9E3779B97F4A7C15)


# What is no prose, each with the signs without which it can't occur: code, markup, long codes, addresses, statements with
# underscores, key=value fields, names with underscores, and quoted titles of up to four words. Every pattern is anchored
# at a sign or at the begin of a word, so that a text is read in linear time.
_TEST = r"[\w.]+\s*(?:[<>=!]+|like|in|is)\s*(?:'[^'\n]*'|[\w.()%-]+)"
_NO_PROSE = [
    ("`", re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.DOTALL)),
    ("<", re.compile(r"<[^<>\n]+>")),
    ("", re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")),
    ("://", re.compile(r"https?://\S+", re.IGNORECASE)),
    ("@", re.compile(r"(?<!\S)[^\s@]+@\S+")),
    ("_", re.compile(rf"\bselect\b[^\n;]*?_[^\n;]*?\bfrom\b\s*[\w.]+(?:\s+where\s+{_TEST}(?:\s+(?:and|or)\s+{_TEST})*)?", re.IGNORECASE)),
    ("=", re.compile(r"(?<![\w.])(?:\w+\|)?[\w.]+=[^\s|]*")),
    ("_", re.compile(r"\b[^\W_]*_\w+")),
]
_QUOTED = regex.compile(r"""["“”„«»‘'(]\s*["“”„«»‘']?\s*\w+(?:[ '’.-]+\w+){0,3}\s*["“”»«’']\s*\)?(?!\w)""")
_SINGLE = re.compile(r"(?<!\w)'|\(\s*'")


def prose(text: str | None) -> str:
    """The text with everything that is no prose replaced by as many bars."""
    if not text:
        return ""
    for sign, pattern in _NO_PROSE:
        if sign in text:
            text = pattern.sub(_bars, text)
    if any(q in text for q in '"“”„«»‘') or ("'" in text and _SINGLE.search(text)):
        text = _QUOTED.sub(_bars, text)
    return text


def _bars(m) -> str:
    return "|" * len(m[0])


class Clauses:
    """A batch of texts as runs of letters, cut into clauses at punctuation, line ends and wide gaps.

    Case and accents are folded. For each clause: doc, its first and last code point in the text (end exclusive), its
    number of words, and hits(): the n-gram counts per language.
    """

    def __init__(self, texts: list[str | None], n: int):
        texts = [prose(t) for t in texts]
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.full(len(raw), 0, dtype=np.uint32)
        low = raw < len(_CLASS)
        kind[low] = _CLASS[raw[low]]
        high = raw[~low]
        kind[~low] = np.where(
            ((high >= 0x300) & (high < 0x370)) | ((high >= 0x200B) & (high <= 0x200D)) | (high == 0x2060) | (high == 0xFEFF),
            _SKIP,
            np.where((high == 0x2019) | ((high >= 0x2000) & (high <= 0x200A)) | (high == 0x202F), _SPACE, np.where(high >= 0x2000, _BREAK, high)),
        )
        at = np.flatnonzero(kind != _SKIP)
        kind = kind[at]
        letter = kind > _SKIP
        wide = (kind == _SPACE) & np.append(False, kind[:-1] == _SPACE) & (raw[at] == 32) & np.append(False, raw[at][:-1] == 32)
        part = np.cumsum((kind == _BREAK) | wide)
        keep = letter | np.append(False, letter[:-1])
        self.text = np.where(letter, kind, 32)[keep].astype(np.uint64)
        at, part, letter = at[keep], part[keep], letter[keep]
        # A blank belongs to the clause before it.
        part = np.where(letter, part, np.append(0, part[:-1])) if len(part) else part
        change = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
        self.clause = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1 if len(part) else part
        self.count = len(change)
        last = np.append(change[1:], len(part)) - 1
        self.doc = np.searchsorted(self.base, at[change], "right") - 1
        self.start = at[change] - self.base[self.doc]
        self.end = at[last] - self.base[self.doc] + np.where(letter[last], 1, 0) if self.count else self.start
        first = letter & ~np.append(False, letter[:-1]) if len(letter) else letter
        self.words = np.bincount(self.clause[first], minlength=self.count) if self.count else np.zeros(0, dtype=np.int64)
        self._n = n

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, clause) of every n-gram that lies within one clause."""
        n = self._n
        m = len(self.text) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        inside = np.flatnonzero(self.clause[:m] == self.clause[n - 1 :])
        h = np.zeros(len(inside), dtype=np.uint64)
        for k in range(n):
            h = (h ^ self.text[inside + k]) * _MULT
            h ^= h >> np.uint64(29)
        return h, self.clause[inside]


class Filters:
    """Bloom filters of all languages in one array: bit l of a slot is language l's, so a look-up returns all at once."""

    def __init__(self, grams: list[np.ndarray], bits: int = 20):
        if len(grams) > 64:
            raise ValueError("a slot holds at most 64 languages")
        self.bits = bits
        self.slots = np.zeros(1 << bits, dtype=next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * t().itemsize >= len(grams)))
        for k, g in enumerate(grams):
            for s in self._places(g):
                self.slots[np.unique(s)] |= self.slots.dtype.type(1 << k)
        fill = np.array([((self.slots >> k) & 1).mean() for k in range(len(grams))])
        self.false = fill**2  # chance that both places of an n-gram are set by others
        self.languages = len(grams)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(36)) & mask).astype(np.int64)

    def hits(self, clauses: Clauses) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each clause per language, corrected for false positives; n-grams of each clause)."""
        h, clause = clauses.hashes()
        a, b = self._places(h)
        found = self.slots[a] & self.slots[b]
        total = np.bincount(clause, minlength=clauses.count).astype(float)
        hits = np.empty((clauses.count, self.languages))
        for k in range(self.languages):
            raw = np.bincount(clause[found & found.dtype.type(1 << k) != 0], minlength=clauses.count)
            hits[:, k] = np.maximum(0, raw - self.false[k] * total) / (1 - self.false[k])
        return hits, total


def train(texts: list[str], labels: list[int], languages: int, n: int = 4, rounds: int = 3, share: float = 0.2) -> Filters:
    """Filters from labelled texts of which some labels are wrong and some texts mixed.

    An n-gram is a language's if it occurs there at least twice and at ``share`` of the rate at which it occurs in the
    language that has it most. After the first round each clause counts for the language it was found to be in.
    """
    clauses = Clauses(texts, n)
    h, clause = clauses.hashes()
    grams, gram = np.unique(h, return_inverse=True)
    of_clause = np.array(labels, dtype=np.int64)[clauses.doc] if clauses.count else np.zeros(0, dtype=np.int64)
    filters = Filters([np.zeros(0, dtype=np.uint64)] * languages)
    for r in range(rounds):
        lang = of_clause[clause]
        ok = lang >= 0
        counts = np.bincount(gram[ok] * languages + lang[ok], minlength=len(grams) * languages).reshape(-1, languages)
        rate = counts / np.maximum(1, counts.sum(axis=0))
        best = rate.max(axis=1, keepdims=True) if len(grams) else rate
        member = (counts >= 2) & (rate >= share * best)
        filters = Filters([grams[member[:, k]] for k in range(languages)])
        if r + 1 < rounds:
            hits, total = filters.hits(clauses)
            order = np.sort(hits, axis=1)
            sure = (order[:, -1] - order[:, -2] > 0.2 * total) & (total > 10)
            of_clause = np.where(sure, hits.argmax(axis=1), -1)
    return filters


def segments(clauses: Clauses, hits: np.ndarray, total: np.ndarray, switch: float = 6.0) -> tuple[np.ndarray, ...]:
    """(doc, start, end, language, confidence, words) as arrays: each run of clauses in one language, in order.

    The clauses of a text are labelled by the path of most hits, each change of language costing ``switch`` hits, so
    that quoted titles and names don't part a text. confidence is the run's lead in hits over the second best
    language, as a share of its n-grams. Texts without a hit have no segment. Texts that no change can pay for are
    labelled all at once.
    """
    if not clauses.count:
        return tuple(np.zeros(0, dtype=t) for t in (int, int, int, int, float, int))
    first = np.flatnonzero(np.append(True, clauses.doc[1:] != clauses.doc[:-1]))
    size = np.diff(np.append(first, clauses.count))
    whole = np.add.reduceat(hits, first, axis=0)
    top = whole.argmax(axis=1)
    gain = hits.max(axis=1) - hits[np.arange(clauses.count), np.repeat(top, size)]
    single = np.maximum.reduceat(gain, first) < switch
    some = whole.any(axis=1)
    begin, lang = [first[single & some]], [top[single & some]]
    for k in np.flatnonzero(~single):
        at, of = _best_path(hits[first[k] : first[k] + size[k]], switch)
        begin.append(first[k] + at)
        lang.append(of)
    a, lang = np.concatenate(begin), np.concatenate(lang)
    order = np.argsort(a)
    a, lang = a[order], lang[order]
    stop = first[np.searchsorted(first, a, "right") - 1] + size[np.searchsorted(first, a, "right") - 1]
    b = np.minimum(np.append(a[1:], clauses.count), stop)
    runs = np.ravel(np.column_stack([a, b]))
    summed = lambda x: np.add.reduceat(np.concatenate([x, np.zeros_like(x[:1])]), runs)[::2] if len(a) else x[:0]
    score, n = summed(hits), summed(total)
    own = score[np.arange(len(a)), lang]
    score[np.arange(len(a)), lang] = 0 if score.shape[1] > 1 else own
    lead = np.maximum(0, own - score.max(axis=1)) if len(a) else own
    return clauses.doc[a], clauses.start[a], clauses.end[b - 1], lang, np.where(n > 0, lead / np.maximum(n, 1), 0.0), summed(clauses.words)


def _best_path(h: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """(first clause, language) of each run on the best path through the hits of one text's clauses."""
    score, back = h[0].copy(), np.zeros(h.shape, dtype=np.int64)
    own = np.arange(h.shape[1])
    for i in range(1, len(h)):
        best = int(score.argmax())
        jump = score[best] - switch > score
        back[i] = np.where(jump, best, own)
        score = np.where(jump, score[best] - switch, score) + h[i]
    path = np.zeros(len(h), dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(len(h) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    at = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    return at, path[at]


def _lasting(doc: np.ndarray, lang: np.ndarray, conf: np.ndarray, words: np.ndarray, least_words: int) -> np.ndarray:
    """Which runs count: those with a clear lead whose language has ``least_words`` words in such runs of the text; in
    a text without one the run of the greatest confidence times words (the first of equal ones)."""
    if not len(doc):
        return np.zeros(0, dtype=bool)
    clear = conf >= 0.1
    key = doc * (int(lang.max()) + 1) + lang
    _, group = np.unique(key, return_inverse=True)
    keep = clear & (np.bincount(group, words * clear)[group] >= least_words)
    bare = np.bincount(doc[keep], minlength=doc.max() + 1)[doc] == 0
    order = np.lexsort((np.arange(len(doc)), -conf * words, doc))
    first = order[np.append(True, doc[order][1:] != doc[order][:-1])]
    best = np.zeros(len(doc), dtype=bool)
    best[first] = True
    return keep | (bare & best)


def labelled(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, content, label): the valid rows with their canonical language, null where it is missing or unknown."""
    known = (
        aliases.where((F.col("alias_kind") == "language") & F.col("alias").isNotNull())
        .groupBy(fold_name(F.col("alias")).alias("alias"))
        .agg(F.min("canonical").alias("label"))
    )
    docs = valid_documents(raw, "language").withColumn("alias", fold_name(F.col("language")))
    return docs.join(known, "alias", "left").select("doc_id", "content", "label")


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample_rows: int = 4000, sample_chars: int = 20_000) -> Filters:
    """Filters of ``languages`` fitted on a bounded sample: the ``sample_rows`` labelled rows with the least hash of
    doc_id, of at most ``sample_chars`` characters each. Only fitting is bounded; every text is labelled."""
    rows = (
        docs.where(F.col("label").isin(*languages) & (F.length("content") <= sample_chars))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .collect()
    )
    return train([r["content"] for r in rows], [languages.index(r["label"]) for r in rows], len(languages))


def language_segments(
    raw: DataFrame, aliases: DataFrame, languages: tuple[str, ...] = LANGUAGES, least_words: int = 5, **options
) -> DataFrame:
    """(doc_id, label, segment, offset_start, offset_end, language, confidence, words): the languages of each valid row.

    label is the canonical form of the row's own label (null where it is missing or unknown); offsets are code points
    of the content. A language counts with at least ``least_words`` words in all its runs of a clear lead together, else its
    runs (headings, names) are no segments, unless the text holds nothing else. Contents that are null, empty or without words of
    a known language give no rows. Filters are fitted by fit() on a bounded sample; without labelled rows there is
    nothing to fit and no row comes out. One pass over the texts; the filters (1 MB) go with the task.
    """
    docs = materialize(labelled(raw, aliases), "labelled")
    filters = fit(docs, languages, **options)
    names = np.array(languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "content"):
            clauses = Clauses(b.column("content").to_pylist(), 4)
            hits, total = filters.hits(clauses)
            doc, start, end, lang, conf, words = segments(clauses, hits, total)
            keep = _lasting(doc, lang, conf, words, least_words)
            doc, start, end, lang, conf, words = (x[keep] for x in (doc, start, end, lang, conf, words))
            segment = np.arange(len(doc)) - np.searchsorted(doc, doc)
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(take),
                    b.column("label").take(take),
                    pa.array(segment, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                    pa.array(names[lang], pa.string()),
                    pa.array(conf, pa.float64()),
                    pa.array(words, pa.int64()),
                ],
                names=["doc_id", "label", "segment", "offset_start", "offset_end", "language", "confidence", "words"],
            )

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "content")).mapInArrow(
        run,
        "doc_id long, label string, segment int, offset_start long, offset_end long, language string, confidence double, words long",
    )


def document_languages(raw: DataFrame, aliases: DataFrame, **options) -> DataFrame:
    """(doc_id, label, language, confidence, words, mixed): each language of each valid row, the confidence weighted by words."""
    seg = language_segments(raw, aliases, **options)
    per = seg.groupBy("doc_id", "label", "language").agg(
        (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"), F.sum("words").alias("words")
    )
    listed = per.groupBy("doc_id", "label").agg(F.collect_list(F.struct("language", "confidence", "words")).alias("l"))
    return listed.select("doc_id", "label", F.explode("l").alias("x"), (F.size("l") > 1).alias("mixed")).select(
        "doc_id", "label", "x.*", "mixed"
    )


def mislabelled(raw: DataFrame, aliases: DataFrame, **options) -> DataFrame:
    """(doc_id, language): every language of the valid rows whose label is missing, unknown or wrong, or that are mixed."""
    found = document_languages(raw, aliases, **options)
    return found.where(F.col("label").isNull() | F.col("mixed") | (F.col("label") != F.col("language"))).select("doc_id", "language")
