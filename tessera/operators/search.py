"""Text search: tokens, corpus statistics, BM25 ranking, prefix and fuzzy matching, vectors, hybrid ranking.

The index is a set of DataFrames derived from (doc_id, text): postings (doc_id, term, tf), document lengths, term
statistics and one row of collection statistics. A search touches only the postings of its terms (a filter that reaches
the scan of a stored index) and pre-aggregates by document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import STEMMERS, stem
from ..runtime import materialize, spread

# A word character is an ASCII letter or digit or any character beyond ASCII.
TOKEN_PATTERN = r"([0-9A-Za-z\u0080-\x{10FFFF}]+)"
_TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
# The English stop words of the pure tokenizer.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
K1, B = 1.2, 0.75


def ascii_lower(c: Column) -> Column:
    """Lower case for ASCII letters only; other characters stay."""
    return F.translate(c, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """All tokens of a text in order: longest runs of word characters, ASCII-lowered; null for null."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def pure_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """tokens() without stop words and without those of one byte or of more than 100."""
    stop = STOPWORDS if stopwords is None else stopwords
    return F.filter(tokens(text), lambda t: (F.octet_length(t) > 1) & (F.octet_length(t) <= 100) & ~t.isin(*stop))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


class Index:
    """The DataFrames of a search index."""

    def __init__(self, postings: DataFrame):
        self.postings = postings

    @property
    def measured(self) -> DataFrame:
        """The postings, with doc_length where that is stored with them."""
        return self.postings

    @property
    def documents(self) -> DataFrame:
        """(doc_id, doc_length, unique_terms)"""
        return self.postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_length"), F.count("*").alias("unique_terms"))

    @property
    def terms(self) -> DataFrame:
        """(term, ndoc, nentry)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("ndoc"), F.sum("tf").alias("nentry"))

    def lookup(self, words: list[str]) -> DataFrame:
        """The postings of some terms; over a stored table the filter reaches the scan."""
        return self.postings.where(F.col("term").isin(*words) if words else F.lit(False))

    def similar_terms(self, word: str, least: float) -> DataFrame:
        """(term) of at least that trigram similarity to a word, by a look at every term."""
        return self.terms.where(trigram_similarity(F.col("term"), F.lit(word)) >= least).select("term")

    def stats(self) -> tuple[int, float]:
        """(number of documents, their average length), 1.0 without any."""
        row = self.documents.agg(F.count("*").alias("n"), F.avg("doc_length").alias("avgdl")).first()
        return row["n"], row["avgdl"] or 1.0

    def collection(self) -> DataFrame:
        """(total_documents, avg_document_length, total_terms, unique_terms): one row."""
        docs = self.documents.agg(
            F.count("*").alias("total_documents"), F.avg("doc_length").alias("avg_document_length"), F.sum("doc_length").alias("total_terms")
        )
        return docs.withColumn("unique_terms", self.postings.agg(F.count_distinct("term")).scalar())

    def snapshot(self) -> DataFrame:
        """(documents, terms, postings): the size of the index in one row."""
        return self.postings.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))


class StoredIndex(Index):
    """An index in a folder: postings with their documents' lengths in folders by a hash of the term, sorted by term within their
    files; documents; terms; the terms' trigrams, sorted; one row of statistics.

    A search for given terms reads only their folders, and there only the row groups whose range of terms fits, and starts no job for
    the statistics. A fuzzy one reads the rows of the word's trigrams. An opened index lists its files once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        read = lambda name: spark.read.parquet(f"{self.folder}/{name}")
        schema = read("like").schema.add("bucket", "integer")  # an empty index has no files of postings
        self._rows = spark.read.schema(schema).parquet(f"{self.folder}/postings")
        self._documents, self._terms, self.trigrams = (read(n) for n in ("documents", "terms", "trigrams"))
        super().__init__(self._rows.select("doc_id", "term", "tf"))
        meta = read("meta").first()
        self.buckets, self._stats = meta["buckets"], (meta["n"], meta["avgdl"] or 1.0)

    @classmethod
    def write(cls, index: Index, folder: str, buckets: int = 64) -> StoredIndex:
        """Store an index; a bucket of a hot term is split over several files by the hash of the document."""
        spark = index.postings.sparkSession
        index.documents.write.mode("overwrite").parquet(f"{folder}/documents")
        documents = spark.read.parquet(f"{folder}/documents")
        bucket = (F.crc32(F.encode("term", "UTF-8")) % buckets).cast("int")
        kept = index.postings.select("doc_id", "term", "tf").join(documents.select("doc_id", "doc_length"), "doc_id").withColumn("bucket", bucket)
        kept = kept.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        kept.drop("bucket").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/like")
        base = Index(spark.read.schema(kept.schema).parquet(f"{folder}/postings"))
        base.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        words = spark.read.parquet(f"{folder}/terms").select("term", trigrams(F.col("term")).alias("t"))
        pairs = words.select("term", F.size("t").cast("int").alias("n"), F.explode("t").alias("trigram"))
        pairs.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{folder}/trigrams")
        meta = documents.agg(F.count("*").alias("n"), F.avg("doc_length").alias("avgdl")).withColumn("buckets", F.lit(buckets))
        meta.write.mode("overwrite").parquet(f"{folder}/meta")
        return cls(spark, folder)

    @property
    def measured(self) -> DataFrame:
        return self._rows.drop("bucket")

    @property
    def documents(self) -> DataFrame:
        return self._documents

    @property
    def terms(self) -> DataFrame:
        return self._terms

    def stats(self) -> tuple[int, float]:
        return self._stats

    def lookup(self, words: list[str]) -> DataFrame:
        if not words:
            return self.measured.limit(0)
        wanted = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self._rows.where(F.col("bucket").isin(*wanted) & F.col("term").isin(*words)).drop("bucket")

    def similar_terms(self, word: str, least: float) -> DataFrame:
        asked = word_trigrams(word)
        if least <= 0:
            return self.terms.select("term")
        shared = self.trigrams.where(F.col("trigram").isin(*asked)).groupBy("term", "n").agg(F.count("*").alias("both"))
        return shared.where(F.col("both") / (F.col("n") + len(asked) - F.col("both")) >= least).select("term")


# The languages of the text configurations, by the name they have there.
LANGUAGES = ("english", "french", "dutch", "german", "spanish", "portuguese")


def default_stopwords(spark: SparkSession, language: str) -> DataFrame:
    """(word): the stop words that Spark has for a language, ASCII-lowered as tokens are; none for 'simple'."""
    if language == "simple":
        return spark.range(0).select(F.lit("").alias("word"))
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language}")
    from pyspark.ml.feature import StopWordsRemover

    words = StopWordsRemover.loadDefaultStopWords(language)
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("word")).select(ascii_lower(F.col("word")).alias("word")).distinct()


def import_stopwords(table: DataFrame | None, words: DataFrame, language: str) -> DataFrame:
    """The table of stop words (language, word) with those of ``words`` (word) added: trimmed and lowered, blank ones left out."""
    new = words.select(F.lit(language).alias("language"), F.trim(F.lower("word")).alias("word")).where("word != ''").distinct()
    return new if table is None else table.select("language", "word").unionByName(new).distinct()


def delete_stopwords(table: DataFrame, language: str, words: list[str] | None = None) -> DataFrame:
    """The table of stop words without the given ones of a language, or without all of them."""
    gone = F.col("language") == language
    return table.where(~(gone if words is None else gone & F.col("word").isin(*words)))


def configured_index(documents: DataFrame, language: str = "simple", doc: str = "doc_id", text: str = "text", stopwords: DataFrame | None = None) -> Index:
    """An index by a text configuration: tokens without the language's stop words, stemmed.

    ``stopwords`` (language, word) replaces the default ones of the languages that it has words for. English, German and Dutch are stemmed; in
    French, Spanish and Portuguese, and in 'simple', tokens stay as they are. Search it with configured_query().
    """
    own = None if stopwords is None else stopwords.where(F.col("language") == language).select("word")
    if own is None or own.isEmpty():
        own = default_stopwords(documents.sparkSession, language)
    raw = build_index(documents, doc, text, own).postings
    stemmed = raw.select("doc_id", stem(F.col("term"), language).alias("term"), "tf")
    return Index(stemmed.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))


def configured_query(spark: SparkSession, text: str, language: str = "simple", stopwords: DataFrame | None = None) -> str:
    """A query's tokens by the same configuration, with blanks between them."""
    words = list(dict.fromkeys(query_tokens(text)))
    own = None if stopwords is None else stopwords.where(F.col("language") == language).select("word")
    if own is None or own.isEmpty():
        own = default_stopwords(spark, language)
    stop = {r["word"] for r in own.where(F.col("word").isin(*words) if words else F.lit(False)).collect()}  # at most the query's words
    stemmer = STEMMERS.get(language, lambda w: w)
    return " ".join(stemmer(w) for w in query_tokens(text) if w not in stop)


def resolve_table(tables: DataFrame, workspace: str, table_id: int | None = None, collection: str | None = None) -> int | None:
    """The table that a search is on: an explicit id that is 1 or of the workspace, else the least id of the collection's name there, else 1.

    An id of another workspace, an unknown collection and an empty name give None.
    """
    mine = tables.where(F.col("workspace_id") == workspace)
    if table_id is not None:
        return table_id if table_id == 1 or not mine.where(F.col("table_id") == table_id).isEmpty() else None
    if collection is not None:
        return mine.where(F.col("table_name") == collection).agg(F.min("table_id")).first()[0] if collection else None
    return 1


def build_index(documents: DataFrame, doc: str = "doc_id", text: str = "text", stopwords: DataFrame | None = None) -> Index:
    """Postings of all documents with at least one token; ``stopwords`` (word) removes words by an anti-join.

    Null documents and texts have no postings. Rows of one doc_id are taken together.
    """
    rows = spread(documents.where(F.col(doc).isNotNull()).select(doc, text))
    rows = rows.select(F.col(doc).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))
    if stopwords is not None:
        rows = rows.join(stopwords.select(F.col("word").alias("term")).distinct(), "term", "left_anti")
    return Index(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf")))


def sync_documents(index: Index, changed: DataFrame, deleted: DataFrame | None = None, **options) -> Index:
    """The index after documents changed (doc_id, text) or were deleted (doc_id): their postings are replaced or removed."""
    gone = changed.select("doc_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("doc_id"))
    kept = index.postings.join(gone.distinct(), "doc_id", "left_anti")
    return Index(kept.unionByName(build_index(changed, **options).postings))


def idf(n: Column, ndoc: Column, variant: str = "default") -> Column:
    if variant == "fts5":
        return F.greatest(F.log((n - ndoc + 0.5) / (ndoc + 0.5)), F.lit(1e-6))
    return F.log((n + 1) / (ndoc + 0.5))


def query_tokens(text: str) -> list[str]:
    """The tokens of a query, repeated ones too: those of tokens(), found by the driver."""
    return _TOKEN.findall(text.translate(_ASCII_LOWER))


def _exact(index: Index, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings, matches) of a query's own tokens: known beforehand, so only their postings are read."""
    counts = Counter(query_tokens(text))
    return index.lookup(list(counts)), F.broadcast(_query(index.postings.sparkSession, list(counts.items())))  # a row for each token of the query


def _query(spark: SparkSession, weights: list[tuple[str, float]]) -> DataFrame:
    rows = [F.struct(F.lit(w).alias("term"), F.lit(float(n)).alias("qtf")) for w, n in weights]
    empty = F.array().cast("array<struct<term:string,qtf:double>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def term_matches(index: Index, text: str, prefix: bool = False, fuzzy: float | None = None) -> DataFrame:
    """(term, qtf): the terms of the vocabulary that a query matches, with how many query tokens match each.

    A token matches itself; with ``prefix`` every term it begins; with ``fuzzy`` every term of at least that trigram
    similarity. The vocabulary, not the postings, is searched: by ranges of terms for a prefix, by trigrams where they are stored.
    """
    counts = Counter(query_tokens(text))
    spark = index.postings.sparkSession
    if not prefix and fuzzy is None:
        return _query(spark, list(counts.items()))
    parts = []
    for q, n in counts.items():
        hit = index.terms.where((F.col("term") == q) | F.col("term").startswith(q) if prefix else F.col("term") == q).select("term")
        if fuzzy is not None:
            hit = hit.unionByName(index.similar_terms(q, fuzzy)).distinct()
        parts.append(hit.withColumn("qtf", F.lit(float(n))))
    if not parts:
        return _query(spark, [])
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("term").agg(F.sum("qtf").alias("qtf"))


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a word, padded with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def word_trigrams(word: str) -> list[str]:
    """trigrams() of a word that the driver has."""
    padded = f"  {word} "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words' trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def term_scores(
    index: Index, matched: DataFrame, variant: str = "default", k1: float = K1, b: float = B, postings: DataFrame | None = None
) -> DataFrame:
    """(doc_id, term, tf, qtf, ndoc, idf, doc_length, score): the share of each matched term in each document's score.

    idf = ln((N + 1) / (ndoc + 0.5)), or the FTS5 form ln((N - ndoc + 0.5) / (ndoc + 0.5)), at least 1e-6; the share is
    qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)). ``postings`` may be those of the
    matched terms, where they are known.
    """
    n, avgdl = index.stats()
    hit = (index.measured if postings is None else postings).join(matched, "term")
    if "doc_length" in hit.columns:  # a stored index has lengths with the postings, and counts by term
        scored = hit.join(index.terms.select("term", "ndoc").join(matched.select("term"), "term", "left_semi"), "term")
    else:
        hit = materialize(hit, "hits")
        ndoc = hit.groupBy("term").agg(F.count("*").alias("ndoc"))
        lengths = index.documents.select("doc_id", "doc_length").join(hit.select("doc_id").distinct(), "doc_id", "left_semi")
        scored = hit.join(ndoc, "term").join(lengths, "doc_id")
    scored = scored.withColumn("idf", idf(F.lit(float(n)), F.col("ndoc"), variant))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("doc_length") / avgdl)
    share = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return scored.withColumn("score", F.when(F.isnan(share), 0.0).otherwise(share))


def bm25_search(
    index: Index,
    text: str,
    limit: int | None = 10,
    prefix: bool = False,
    fuzzy: float | None = None,
    variant: str = "default",
    k1: float = K1,
    b: float = B,
    min_score: float | None = None,
    offset: int = 0,
) -> DataFrame:
    """(doc_id, score) of the documents that match any query token, best first, ties by doc_id; all with limit None.

    Repeated query tokens count as often as they occur. A query without tokens finds nothing.
    """
    if prefix or fuzzy is not None:
        shares = term_scores(index, term_matches(index, text, prefix, fuzzy), variant, k1, b)
    else:
        postings, matched = _exact(index, text)
        shares = term_scores(index, matched, variant, k1, b, postings)
    found = shares.groupBy("doc_id").agg(F.sum("score").alias("score"))
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    if limit is None:
        return found
    ranked = found.orderBy(F.desc("score"), "doc_id")
    return (ranked.offset(offset) if offset else ranked).limit(limit)


def bm25_explain(index: Index, text: str, doc_id: int, **options) -> DataFrame:
    """term_scores() of one document."""
    postings, matched = _exact(index, text)
    return term_scores(index, matched, postings=postings, **options).where(F.col("doc_id") == doc_id)


def matching_documents(index: Index, text: str, prefix: bool = False, fuzzy: float | None = None) -> DataFrame:
    """(doc_id) of the documents that hold any matched term."""
    if not prefix and fuzzy is None:
        return _exact(index, text)[0].select("doc_id").distinct()
    return index.postings.join(term_matches(index, text, prefix, fuzzy), "term", "left_semi").select("doc_id").distinct()


# --- vectors -----------------------------------------------------------------------------------------------------


def _pairs(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def vector_similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine (0 for a zero vector), l2 (1 / (1 + squared distance)) or inner_product, over the shorter length."""
    if metric == "cosine":
        norm = F.sqrt(_pairs(a, a, lambda x, y: x * y)) * F.sqrt(_pairs(b, b, lambda x, y: x * y))
        return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
    if metric == "l2":
        return 1 / (1 + _pairs(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "inner_product":
        return dot(a, b)
    raise ValueError(f"unknown metric {metric}")


def nearest(vectors: DataFrame, key: str | list[str], column: str, query: list[float], limit: int = 10, metric: str = "cosine") -> DataFrame:
    """(key, similarity) of the vectors of the query's length, best first, ties by key: exact, by one scan. Chunks have a key of two."""
    q = F.array(*[F.lit(float(x)) for x in query])
    keys = [key] if isinstance(key, str) else key
    rows = vectors.where(F.size(column) == len(query)).select(*keys, vector_similarity(F.col(column), q, metric).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), *keys).limit(limit)


def upsert_embeddings(vectors: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The table of vectors after changes: of a key's changes the last by ``seq`` counts; a null vector deletes the key."""
    rest = [c for c in vectors.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    vector = next(c for c in rest if isinstance(vectors.schema[c].dataType, (T.ArrayType, T.BinaryType)))
    return vectors.join(last.select(*keys), keys, "left_anti").unionByName(last.where(F.col(vector).isNotNull()).select(*vectors.columns))


def contextual_search(
    chunks: DataFrame, text: str, limit: int = 20, vectors: DataFrame | None = None, query: list[float] | None = None, weight: float = 0.5, around: int = 1
) -> DataFrame:
    """(doc_id, chunk_index, score, content, context): the best chunks by BM25, fused with vectors where they are given, each with its context.

    ``chunks`` has doc_id, chunk_index and content, ``vectors`` doc_id, chunk_index and values. context is the content of up to ``around``
    chunks on either side, in order, with the chunk's own. As models aren't called, the context comes from the document itself.
    """
    one = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"))
    keyed = chunks.select(F.to_json(one).alias("doc_id"), F.col("content").alias("text"))
    index = Index(materialize(build_index(keyed).postings, "postings"))
    if vectors is None or query is None:
        found = bm25_search(index, text, limit).select("doc_id", "score")
    else:
        near = nearest(vectors.select(F.to_json(one).alias("doc_id"), "values"), "doc_id", "values", query, min(1000, 4 * limit))
        found = fuse(bm25_search(index, text, None), near, weight, limit).select("doc_id", F.col("combined").alias("score"))
    key = F.from_json("doc_id", "doc_id long, chunk_index long")
    found = materialize(found.select(key["doc_id"].alias("doc_id"), key["chunk_index"].alias("chunk_index"), "score"), "found")
    wanted = found.select("doc_id", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - around, F.col("chunk_index") + around)).alias("at"))
    parts = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("at"), "content")
    near = wanted.join(parts, ["doc_id", "at"]).groupBy("doc_id", "chunk_index").agg(
        F.max(F.when(F.col("at") == F.col("chunk_index"), F.col("content"))).alias("content"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("context"),
    )
    return found.join(near, ["doc_id", "chunk_index"]).orderBy(F.desc("score"), "doc_id", "chunk_index")


def without_embedding(documents: DataFrame, vectors: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Documents that have no vector yet, by key."""
    missing = documents.join(vectors.select(key), key, "left_anti").orderBy(key)
    return missing if limit is None else missing.limit(limit)


def fuse(bm25: DataFrame, vectors: DataFrame, weight: float, limit: int | None = 10) -> DataFrame:
    """(doc_id, bm25_score, vector_score, combined): (1 - weight) * score + weight * similarity over either list.

    ``bm25`` has doc_id and score, ``vectors`` doc_id and similarity; what one list lacks counts 0. Ties by doc_id.
    """
    if not 0 <= weight <= 1 or math.isnan(weight):
        raise ValueError("the weight must be from 0 to 1")
    both = bm25.select("doc_id", F.col("score").alias("s")).join(vectors.select("doc_id", F.col("similarity").alias("v")), "doc_id", "full")
    both = both.select(
        "doc_id", F.coalesce("s", F.lit(0.0)).alias("bm25_score"), F.coalesce("v", F.lit(0.0)).alias("vector_score")
    ).withColumn("combined", (1 - weight) * F.col("bm25_score") + weight * F.col("vector_score"))
    return both if limit is None else both.orderBy(F.desc("combined"), "doc_id").limit(limit)


def hybrid_search(
    index: Index,
    vectors: DataFrame,
    text: str,
    query: list[float],
    weight: float = 0.5,
    limit: int = 10,
    metric: str = "cosine",
    vector_limit: int | None = None,
) -> DataFrame:
    """fuse() of all documents with a query token and the nearest vectors (doc_id, values).

    ``vector_limit`` is the number of vectors that take part, four times ``limit`` but at most 1000 unless given.
    """
    near = nearest(vectors, "doc_id", "values", query, vector_limit or min(1000, 4 * limit), metric)
    return fuse(bm25_search(index, text, None), near, weight, limit)
