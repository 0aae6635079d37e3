import math
import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import queries, terms

T0 = datetime(2024, 1, 1)
S = "doc_id long, term_text string, freq int, indexed_at timestamp, term string, ndoc string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f, None if n is None else T0 + timedelta(days=n), "clash", None) for d, t, f, n in rows], S)


ROWS = [
    (1, "Café", 2, 1),
    (1, "café ", 3, 1),  # another spelling of the term: summed
    (1, "Café", 5, 0),  # an older count
    (1, "Café", 2, 1),  # an exact copy
    (1, "so­ft​", 1, None),
    (1, "SOFT", 4, 1),
    (2, "café", 1, 1),
    (2, None, 9, 1),
    (2, "  ", 9, 1),
    (2, "​﻿", 9, 1),
    (2, "zero", 0, 1),
    (2, "neg", -3, 1),
    (2, "null", None, 1),
    (None, "nodoc", 3, 1),
    (3, "tie", 2, 1),
    (3, "tie", 7, 1),
    (4, "tie", 1, 1),
    (5, "tie", 1, 1),
]


def test_records(spark, rows):
    got = rows(terms.term_records(frame(spark, ROWS)))
    assert got == {(1, "café", 5), (1, "soft", 5), (2, "café", 1), (3, "tie", 7), (4, "tie", 1), (5, "tie", 1)}
    assert terms.term_records(frame(spark, [])).collect() == []


def test_lgamma():
    x = np.array([0.25, 0.5, 1, 2, 3.5, 15.9, 16, 17.3, 1e3, 1e7, 1e12])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(terms.lgamma(x), want, rtol=1e-13, atol=1e-13)


def test_upper_tail_by_brute_force():
    def brute(k, m, d, n):
        return sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(max(k, d + m - n, 0), min(m, d) + 1)) / math.comb(n, d)

    cases = [(k, m, d, 40) for m, d in product((1, 3, 10, 25, 39), (1, 5, 20, 38)) for k in range(1, min(m, d) + 1)]
    k, m, d, n = (np.array(x) for x in zip(*cases))
    got = np.exp(terms.log_upper_tail(k, m, d, 40.0))
    assert np.allclose(got, [brute(*c) for c in cases], rtol=1e-9)


@pytest.mark.parametrize("total", [50, 10**6, 10**9, 10**14])
def test_upper_tail_against_exact_fractions(total):
    """Counts of up to 1e14, where differences of log-gamma would have no digit left."""
    rng = random.Random(total)
    for _ in range(8):
        n = rng.randint(1, min(200, total))
        m = rng.choice([rng.randint(1, total), rng.randint(1, max(1, total // 100)), rng.randint(1, min(total, 900))])
        k = rng.randint(max(0, n + m - total), min(n, m))
        ways = sum(math.comb(m, j) * math.comb(total - m, n - j) for j in range(k, min(n, m) + 1))
        exact = Decimal(ways) / Decimal(math.comb(total, n))
        got = terms.log_upper_tail(np.array([k]), np.array([m]), np.array([n]), float(total))[0]
        assert got == pytest.approx(float(exact.ln()), rel=1e-10, abs=1e-10)


def test_probability_against_products_of_ratios():
    for total, m, n, k in ((10**14, 10**12, 3000, 80), (10**14, 3 * 10**13, 2000, 900), (10**12, 5 * 10**6, 4000, 3)):
        want = sum((Decimal((n - i) * (m - i)) / Decimal((total - i) * (i + 1))).ln() for i in range(k))
        want += sum((Decimal(total - m - j) / Decimal(total - k - j)).ln() for j in range(n - k))
        assert terms.log_probability(*(np.array([float(x)]) for x in (k, m, n)), float(total))[0] == pytest.approx(float(want), rel=1e-11)


def test_tail_takes_steps_by_the_deviation():
    """A record with a third of all occurrences and a term far below its mean there: no walk up to the mean."""
    begun = time.perf_counter()
    got = terms.log_upper_tail(np.array([4.0, 3e8]), np.array([1e12, 1e9]), np.array([3e13, 3e13]), 1e14)
    assert got[0] == 0 and -1 < got[1] < 0 and time.perf_counter() - begun < 30


def test_fdr_by_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform(0.001, 1, 400) ** 3, 3) + 0.001
    df = spark.createDataFrame([(float(math.log(x)),) for x in p], "log_p double")
    got = {r["log_p"]: r["log_q"] for r in terms.adjust_fdr(df, "log_p", buckets=7).collect()}
    s = np.sort(p)
    q = np.minimum(1, np.minimum.accumulate((s * len(s) / np.arange(1, len(s) + 1))[::-1])[::-1])
    want = {float(math.log(a)): math.log(b) for a, b in sorted(zip(s, q), reverse=True)}
    assert got.keys() == want.keys()
    for a in want:
        assert got[a] == pytest.approx(want[a], abs=1e-9)


def test_distinctive_terms(spark):
    data = [(d, "common", 3, 1) for d in range(40)] + [(d, f"own{d}", 1, 1) for d in range(40)] + [(7, "rare", 6, 1), (8, "rare", 5, 1)]
    got = {(r["doc_id"], r["term_text"]): r for r in terms.distinctive_terms(frame(spark, data)).collect()}
    assert len(got) == 82
    assert got[7, "rare"]["ndoc"] == 2 and got[7, "rare"]["nentry"] == 11 and got[7, "rare"]["length"] == 10
    assert got[7, "rare"]["score"] > 2 > got[3, "own3"]["score"] > got[3, "common"]["score"] >= 0
    assert terms.distinctive_terms(frame(spark, [])).collect() == []


def test_hot_keys_join_the_same(spark, rows, monkeypatch):
    """The path of hot keys, which starts at 200,000 rows, gives what a plain join gives."""
    from tessera.runtime import keyed_join

    left = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v").repartition(3)
    right = left.groupBy("k").count()
    plain = rows(left.join(right, "k"))
    assert rows(keyed_join(left, right, "k", "count", 4_096_000)) == plain
    assert rows(keyed_join(left, right, "k", "count", 9000)) == plain


def brute_ngrams(seqs, sigma):
    entries, docs = Counter(), defaultdict(set)
    for doc, tokens, weight in seqs:
        tokens = [t for t in tokens or [] if t is not None]
        for i in range(len(tokens)):
            for n in range(1, min(sigma, len(tokens) - i) + 1):
                g = tuple(tokens[i : i + n])
                entries[g] += 1 if weight is None else weight
                docs[g].add(doc)
    return {(g, entries[g], len(docs[g])) for g in entries}


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngrams_by_brute_force(spark, sigma):
    rng = np.random.default_rng(sigma)
    seqs = [(int(rng.integers(12)), [str(x) for x in rng.choice(list("aabécd"), rng.integers(0, 9))], int(rng.integers(1, 4))) for _ in range(120)]
    seqs += [(1, None, 1), (2, [], 1), (3, ["a", None, "b"], None)]
    df = spark.createDataFrame(seqs, "doc_id long, tokens array<string>, weight int")
    for rows_per_group in (5, 1_000_000):  # with and without splits of hot first symbols
        got = {(tuple(r["ngram"]), r["nentry"], r["ndoc"]) for r in terms.ngram_counts(df, sigma, rows_per_group).collect()}
        assert got == brute_ngrams(seqs, sigma)
    assert terms.ngram_counts(df.limit(0), sigma).collect() == []


def test_more_hot_symbols_than_a_broadcast_may_hold(spark, monkeypatch):
    """Over 4096 symbols with more rows than a group may have: joined, and no record set holds two parts."""
    seqs = spark.range(5000 * 12).selectExpr("id as doc_id", "array(concat('s', id % 5000), concat('s', id % 5000)) as tokens", "1 as weight")
    got = terms.ngram_counts(seqs, 1, rows_per_group=10)
    assert got.where("nentry != 24 or ndoc != 12").isEmpty() and got.count() == 5000
    suffixes = [("b", 1, 1, 0), ("a", 1, 1, 0), ("a", 2, 1, 1), ("a", 3, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([[x[0]] for x in suffixes]), *(pa.array([x[i] for x in suffixes]) for i in (1, 2, 3))], names=["suffix", "doc_id", "weight", "part"])
    out = [tuple(r.values()) for b in terms._stack_counts([batch]) for r in b.to_pylist()]
    assert out == [(["b"], 1, 1), (["a"], 1, 1), (["a"], 2, 2)]


def test_marks(spark, rows):
    got = rows(terms.term_frequencies(frame(spark, ROWS)).select("term_text", "nentry", "ndoc", "mark"))
    assert got == {("café", 6, 2, "common"), ("soft", 5, 1, "rare"), ("tie", 9, 3, "common")}
    assert terms.term_frequencies(frame(spark, [])).collect() == []


def test_content_ngrams(spark, rows):
    facts = spark.createDataFrame(
        [("f", 1, T0, 1, "old; x"), ("f", 2, T0, 1, "A;b ; ;A"), ("g", 1, T0, 2, "b; c"), ("h", 1, T0, 3, None), (None, 1, T0, 4, "n"), ("i", 1, T0, 5, "q"), ("j", 1, T0, 6, "q"), ("k", 1, T0, 7, "z"), ("l", 1, T0, 8, "y")],
        "id string, version long, updated_at timestamp, doc_id long, content string",
    )
    got = rows(terms.content_ngrams(facts, 2))
    assert ("a", 2, 1, "rare") in got and ("b", 2, 2, "common") in got and ("a; b", 1, 1, "rare") in got and ("b; a", 1, 1, "rare") in got
    assert not any("old" in r[0] for r in got)


def test_found_keeps_pairs_without_a_score(spark, rows, tmp_path):
    data = [(1, "even", 4, 1), (2, "even", 4, 1), (3, "once", 9, 1), (1, "few", 3, 1), (2, "few", 1, 1)]
    frame(spark, data).write.parquet(f"{tmp_path}/bm25_term_frequencies.parquet")
    frame(spark, [(d, "even", 4, 1) for d in (1, 2)]).write.parquet(f"{tmp_path}/all/bm25_term_frequencies.parquet")
    scored = terms.distinctive_terms(spark.read.parquet(f"{tmp_path}/all/bm25_term_frequencies.parquet"))
    assert rows(scored.select("score")) == {(0.0,)}
    assert rows(queries.p1_found(spark, f"{tmp_path}/all")) == {(1, "even"), (2, "even")}
    assert rows(queries.p1_found(spark, str(tmp_path))) == {(1, "even"), (2, "even")}
