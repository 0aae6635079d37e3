"""Term statistics: cleaned term records, distinctive terms (problem 1), value frequencies (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import INVISIBLE, clean_term, strip_blanks
from ..runtime import HOT_SHARE, keyed_join, materialize, spread


def term_records(rows: DataFrame) -> DataFrame:
    """(doc_id, term, freq): the valid count of each cleaned term in each record.

    Rows with null doc_id, null or blank term, or freq null or below 1 are dropped; of rows with the same doc_id and
    identical term_text the latest indexed_at counts once (null is oldest; among equal times the largest freq, so
    that repeated rows and ties have one result); spellings of one term are summed. Terms that hold nothing but
    invisible characters are blank. Other columns of the input are ignored. An empty input gives no rows.
    """
    rows = rows.select("doc_id", "term_text", F.col("freq").cast("long").alias("freq"), "indexed_at")
    visible = strip_blanks(F.translate(F.col("term_text"), INVISIBLE, ""))
    rows = spread(rows.where(F.col("doc_id").isNotNull() & (visible != "") & (F.col("freq") >= 1)))
    # One shuffle serves both aggregations, as either groups within (doc_id, term).
    rows = rows.withColumn("term", clean_term(F.col("term_text"))).repartition("doc_id", "term")
    latest = rows.groupBy("doc_id", "term", "term_text").agg(F.max(F.struct("indexed_at", "freq")).alias("last"))
    return latest.groupBy("doc_id", "term").agg(F.sum("last.freq").alias("freq"))


# ---------------------------------------------------------------------------------------------------------------
# Problem 1: hypergeometric enrichment
# ---------------------------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Vectorised log-gamma for x > 0 (Stirling's series after shifting small arguments)."""
    x = np.asarray(x, dtype=np.float64)
    small = x < 16
    shift = np.zeros_like(x)
    if small.any():
        s = x[small]
        shift[small] = sum(np.log(s + i) for i in range(16))
    z = np.where(small, x + 16, x)
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - shift


_NODES = {n: np.polynomial.legendre.leggauss(n) for n in (16, 32)}


def _summed_logs(f, df, d3f, m: np.ndarray, nodes: int) -> np.ndarray:
    """f(0) + ... + f(m - 1) for smooth f: the integral over [-1/2, m - 1/2] by Gauss-Legendre with the first two
    Euler-Maclaurin corrections of the midpoint rule."""
    x, w = _NODES[nodes]
    total = np.zeros_like(m)
    for xi, wi in zip(x, w):
        total += wi * f((xi + 1) / 2 * m - 0.5)
    return total * m / 2 - (df(m - 0.5) - df(-0.5)) / 24 + 7 / 5760 * (d3f(m - 0.5) - d3f(-0.5))


def _log_falling(a: np.ndarray, m: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """ln of a (a - 1) ... (a - m + 1), with ``b`` divided by b (b - 1) ... (b - m + 1), for a <= b.

    Differences of log-gamma lose all digits for counts of 1e14; where a - m is large the logs are summed by quadrature
    instead, those of (a - i) / (b - i) as log1p, which keeps the relative precision of a double.
    """
    out = np.empty_like(m)
    rest = a - m
    for nodes, ok in ((16, (rest >= 64) & (m <= a / 2)), (32, (rest >= 64) & (m > a / 2) & (m <= 0.9 * a)), (0, (rest < 64) | (m > 0.9 * a))):
        if not ok.any():
            continue
        x, n = a[ok], m[ok]
        if not nodes:
            out[ok] = lgamma(x + 1) - lgamma(x - n + 1) if b is None else _log_falling(x, n) - _log_falling(b[ok], n)
        elif b is None:
            out[ok] = _summed_logs(lambda t: np.log(x - t), lambda t: -1 / (x - t), lambda t: -2 / (x - t) ** 3, n, nodes)
        else:
            y = b[ok]
            out[ok] = _summed_logs(
                lambda t: np.where(2 * x < y, np.log((x - t) / (y - t)), np.log1p((x - y) / (y - t))), lambda t: 1 / (y - t) - 1 / (x - t), lambda t: 2 / (y - t) ** 3 - 2 / (x - t) ** 3, n, nodes
            )
    return out


def log_probability(k: np.ndarray, marked: np.ndarray, drawn: np.ndarray, total: float) -> np.ndarray:
    """ln P(X = k) of the hypergeometric distribution, for k that are possible."""
    k, marked, drawn = (np.asarray(a, dtype=np.float64) for a in (k, marked, drawn))
    n, m = np.minimum(marked, drawn), np.maximum(marked, drawn)  # the two are exchangeable
    all_ = np.full_like(k, total)
    return _log_falling(n, k) - lgamma(k + 1) + _log_falling(m, k, all_) + _log_falling(all_ - m, n - k, all_ - k)


def log_upper_tail(k: np.ndarray, marked: np.ndarray, drawn: np.ndarray, total: float) -> np.ndarray:
    """ln P(X >= k) for X hypergeometric: ``drawn`` of ``total`` occurrences drawn, ``marked`` of them the term's.

    The first probability comes from log-gamma sums; the following ones by their ratio, summed in log space until they fall
    and no longer count in double precision. Above the mean the tail itself is summed upwards, below it its complement
    downwards, so that the number of steps grows with the standard deviation, not with k.
    """
    k, marked, drawn = (np.asarray(a, dtype=np.float64) for a in (k, marked, drawn))
    least, top = np.maximum(0.0, drawn + marked - total), np.minimum(marked, drawn)
    out = np.zeros_like(k)
    out[k > top] = -np.inf
    open_ = (k > least) & (k <= top)
    below = open_ & (k <= drawn * (marked / total))
    for at, up in ((np.flatnonzero(open_ & ~below), True), (np.flatnonzero(below), False)):
        if not at.size:
            continue
        i, m, d = k[at] - (not up), marked[at], drawn[at]
        end = top[at] if up else least[at]
        term = log_probability(i, m, d, total)
        acc = term.copy()
        live = np.flatnonzero(i != end)
        i, term, m, d, end = i[live], term[live], m[live], d[live], end[live]
        while live.size:
            if up:
                ratio = np.log((m - i) * (d - i)) - np.log((i + 1) * (total - m - d + i + 1))
            else:
                ratio = np.log(i * (total - m - d + i)) - np.log((m - i + 1) * (d - i + 1))
            term = term + ratio
            i = i + 1 if up else i - 1
            acc[live] = np.logaddexp(acc[live], term)
            go = (i != end) & ((ratio > 0) | (term > acc[live] - 38))
            live, i, term, m, d, end = live[go], i[go], term[go], m[go], d[go], end[go]
        out[at] = acc if up else np.log1p(-np.exp(np.minimum(acc, -1e-300)))
    return np.minimum(out, 0.0)


def _tail_udf(total: int):
    @F.pandas_udf(T.DoubleType())
    def log_p(k: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        # Nine decimals, so that tests of one probability are ties whichever way it was summed.
        return pd.Series(np.round(log_upper_tail(k.to_numpy(), marked.to_numpy(), drawn.to_numpy(), float(total)), 9) + 0.0)

    return log_p


def adjust_fdr(tests: DataFrame, log_p: str, buckets: int = 256) -> DataFrame:
    """(log_p, n, log_q): the Benjamini-Hochberg value of each distinct log_p, for ``tests`` with one row per test.

    Ranks are made without a global sort: distinct values, cut into at most ``buckets`` ranges at fixed limits, are
    ranked within their range; only the ranges' counts and minima (at most ``buckets`` rows) meet on the driver.
    Equal values share the rank of the last of them. No tests give no rows.
    """
    dist = materialize(tests.groupBy(F.col(log_p).alias("log_p")).agg(F.count("*").alias("n")), "fdr")
    limits = dist.approxQuantile("log_p", [i / buckets for i in range(1, buckets)], 0.002)
    limits = sorted(set(limits))
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda b: b < F.col("log_p"))) if limits else F.lit(0)
    dist = dist.withColumn("bucket", bucket)
    count, before = {}, 0
    for r in sorted(dist.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        count[r["bucket"]] = before
        before += r["n"]
    up = Window.partitionBy("bucket").orderBy("log_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("bucket").orderBy(F.desc("log_p")).rowsBetween(Window.unboundedPreceding, 0)
    if not count:
        return dist.select("log_p", "n", F.lit(0.0).alias("log_q"))
    offset = F.create_map(*[F.lit(v) for pair in count.items() for v in pair])[F.col("bucket")]
    raw = dist.withColumn("rank", offset + F.sum("n").over(up)).withColumn(
        "raw", F.col("log_p") + F.log(F.lit(float(before))) - F.log("rank")
    )
    raw = materialize(raw, "fdr")
    least, following = {}, 0.0
    for r in sorted(raw.groupBy("bucket").agg(F.min("raw").alias("m")).collect(), reverse=True):
        least[r["bucket"]] = following
        following = min(following, r["m"])
    later = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])[F.col("bucket")]
    return raw.select("log_p", "n", F.least(F.min("raw").over(down), later, F.lit(0.0)).alias("log_q"))


def distinctive_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, term_text, freq, ndoc, nentry, length, log_p, score): how characteristic each term is of its record.

    The term's count in the record is held against a draw, without replacement, of the record's length from all
    occurrences of the collection (hypergeometric enrichment). log_p is the natural log of the exact probability of
    at least this count, to nine decimals, score the negative base-10 logarithm of its Benjamini-Hochberg adjusted value over all pairs
    of the collection: 0 for common terms, large for rare ones that are frequent in the record. Rows are cleaned as in
    term_records(), whose rules for nulls, ties and repeated rows hold. An empty input gives no rows.

    Scale: two shuffles of the rows, then joins with the term and record totals in which keys that hold over 1/4096
    of the rows are broadcast (at most 4096 of them by counting), so a term in a third of all rows is never one task.
    """
    pairs = materialize(term_records(rows), "pairs")
    terms = materialize(pairs.groupBy("term").agg(F.count("*").alias("ndoc"), F.sum("freq").alias("nentry")), "terms")
    docs = materialize(pairs.groupBy("doc_id").agg(F.count("*").alias("nterm"), F.sum("freq").alias("length")), "docs")
    n, total = terms.agg(F.sum("ndoc"), F.sum("nentry")).first()
    n, total = n or 0, total or 0
    wide = keyed_join(keyed_join(pairs, terms, "term", "ndoc", n), docs, "doc_id", "nterm", n)
    scored = materialize(wide.withColumn("log_p", _tail_udf(total)("freq", "nentry", "length")), "scored")
    adjusted = adjust_fdr(scored, "log_p").withColumnRenamed("n", "weight")
    return keyed_join(scored, adjusted, "log_p", "weight", n).select(
        "doc_id",
        F.col("term").alias("term_text"),
        "freq",
        "ndoc",
        "nentry",
        "length",
        "log_p",
        (-F.col("log_q") / F.log(F.lit(10.0))).alias("score"),
    )


# ---------------------------------------------------------------------------------------------------------------
# Problem 4: suffix-sorted n-gram counts
# ---------------------------------------------------------------------------------------------------------------

COUNTS = T.StructType(
    [
        T.StructField("ngram", T.ArrayType(T.StringType())),
        T.StructField("nentry", T.LongType()),
        T.StructField("ndoc", T.LongType()),
    ]
)


def _stack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix counts and record sets of suffixes that come by part, in reverse lexicographic order, by one stack.

    The stack holds one level for each symbol of the current suffix: its count and its set of records. A level is
    written when the next suffix no longer has it as a prefix; its records then join those of the level below. A change
    of part closes all levels, so that no set holds the records of two parts.
    """
    symbols: list[str] = []
    counts: list[int] = []
    records: list[set] = []
    group = 0
    out: tuple[list, list, list] = ([], [], [])

    def pop() -> None:
        out[0].append(list(symbols))
        out[1].append(counts[-1])
        out[2].append(len(records[-1]))
        symbols.pop()
        n, docs = counts.pop(), records.pop()
        if counts:
            counts[-1] += n
            if len(docs) > len(records[-1]):
                docs, records[-1] = records[-1], docs
            records[-1] |= docs

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
            names=["ngram", "nentry", "ndoc"],
        )
        for x in out:
            x.clear()
        return batch

    for b in batches:
        for suffix, doc, weight, part in zip(*(b.column(n).to_pylist() for n in ("suffix", "doc_id", "weight", "part"))):
            if part != group:
                while symbols:
                    pop()
                group = part
            if suffix != symbols:
                same = 0
                while same < len(symbols) and same < len(suffix) and symbols[same] == suffix[same]:
                    same += 1
                while len(symbols) > same:
                    pop()
                for s in suffix[same:]:
                    symbols.append(s)
                    counts.append(0)
                    records.append(set())
            counts[-1] += weight
            records[-1].add(doc)
        if len(out[0]) >= 20_000:
            yield flush()
    while symbols:
        pop()
    yield flush()


def ngram_counts(sequences: DataFrame, sigma: int, rows_per_group: int = 1_000_000) -> DataFrame:
    """(ngram, nentry, ndoc) of every n-gram of up to ``sigma`` symbols.

    ``sequences`` has doc_id, tokens (array of strings) and weight (how often the sequence occurs; null counts 1).
    Every suffix, cut to ``sigma`` symbols, is routed by its first symbol, sorted in reverse lexicographic order and
    counted by one pass with a stack. A first symbol with more than ``rows_per_group`` suffixes is split by a hash of
    doc_id into as many parts as it needs, so neither a task nor a record set is bound to a hot symbol: a part has
    ``rows_per_group`` suffixes on average. As a record lies in one part, the parts' counts add up. Up to 4096 such
    symbols are broadcast with their numbers of parts; where there are more, they meet the suffixes in a join by symbol,
    of which those with over 1/4096 of all suffixes are again at most 4096 and broadcast. Null sequences and null
    symbols have no n-grams; an empty input gives no rows.
    """
    suffixes = sequences.select(
        "doc_id",
        F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"),
        F.coalesce(F.col("weight").cast("long"), F.lit(1)).alias("weight"),
    )
    if sigma == 1:
        suffixes = suffixes.select("doc_id", "weight", F.explode("tokens").alias("first")).withColumn(
            "suffix", F.array("first")
        )
    else:
        suffixes = suffixes.select("doc_id", "weight", F.posexplode("tokens").alias("pos", "first"), "tokens").select(
            "doc_id", "weight", "first", F.slice("tokens", F.col("pos") + 1, sigma).alias("suffix")
        )
    firsts = materialize(suffixes.groupBy("first").agg(F.count("*").alias("n")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / rows_per_group).cast("int").alias("parts")
    hot = firsts.where(F.col("n") > rows_per_group).select("first", parts)
    if hot.limit(HOT_SHARE + 1).count() <= HOT_SHARE:
        routed = suffixes.join(F.broadcast(hot), "first", "left")
    else:
        routed = keyed_join(suffixes, firsts.select("first", "n", parts), "first", "n", total)
    routed = routed.withColumn("part", F.when(F.coalesce("parts", F.lit(1)) < 2, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"))
    routed = routed.repartition("first", "part").sortWithinPartitions("part", F.desc("suffix"), "doc_id")
    counted = routed.select("suffix", "doc_id", "weight", "part").mapInArrow(_stack_counts, COUNTS)
    return counted.groupBy("ngram").agg(F.sum("nentry").alias("nentry"), F.sum("ndoc").alias("ndoc"))


def mark(ndoc, records: int, rare: int = 1, common: float = 0.25):
    """'rare' for at most ``rare`` records, 'common' for at least ``common`` of all records, else null."""
    return F.when(ndoc <= rare, "rare").when(ndoc >= common * records, "common")


def term_frequencies(rows: DataFrame, rare: int = 1, common: float = 0.25) -> DataFrame:
    """(term_text, nentry, ndoc, mark): occurrences and records of every distinct cleaned term.

    Rows are cleaned as in term_records(). mark is 'rare' for terms of at most ``rare`` records, 'common' for terms
    of at least ``common`` of all records that have a valid row, else null ('rare' first, where both hold). An
    empty input gives no rows.
    """
    pairs = materialize(term_records(rows), "pairs")
    records = pairs.select("doc_id").distinct().count()
    seqs = pairs.select("doc_id", F.array("term").alias("tokens"), F.col("freq").alias("weight"))
    counted = ngram_counts(seqs, 1)
    return counted.select(
        F.col("ngram")[0].alias("term_text"), "nentry", "ndoc", mark(F.col("ndoc"), records, rare, common).alias("mark")
    )


def content_ngrams(facts: DataFrame, sigma: int = 3, rare: int = 1, common: float = 0.25) -> DataFrame:
    """(ngram, nentry, ndoc, mark) of the runs of up to ``sigma`` terms in the contents of the valid facts.

    The highest version of an id is valid (then the latest updated_at and the lowest doc_id). Terms are parted by
    semicolons and cleaned like clean_term(); blank ones are left out. Runs are joined by '; '. Facts with null id,
    doc_id or content have no terms; marks are those of term_frequencies().
    """
    latest = Window.partitionBy("id").orderBy(F.desc("version"), F.desc("updated_at"), "doc_id")
    valid = (
        facts.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull())
        .select("id", "version", "updated_at", "doc_id", "content")
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1 and content is not null")
        .select("doc_id", F.split(clean_term(F.col("content")), r"\s*;\s*").alias("tokens"))
        .select("doc_id", F.filter("tokens", lambda x: x != "").alias("tokens"))
        .where(F.size("tokens") > 0)
    )
    valid = materialize(valid, "contents")
    records = valid.select("doc_id").distinct().count()
    counted = ngram_counts(valid.withColumn("weight", F.lit(1)), sigma)
    return counted.select(
        F.array_join("ngram", "; ").alias("ngram"), "nentry", "ndoc", mark(F.col("ndoc"), records, rare, common).alias("mark")
    )
