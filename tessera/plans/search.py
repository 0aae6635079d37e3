"""Queries on the text and vector search of the documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as fa
from ..operators import search as se
from ..runtime import kept, materialize, new_folder
from ..runtime import table as t
from .facets import ASSIGNED, document_facets
from .registry import query

TEXT = "reserve fund maintenance owner"

_TOK = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9A-Za-z]|[^\\x00-\\x7F])+')"
)
POSTINGS = f"""post AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL
), lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doc_length, count(*) AS unique_terms FROM post GROUP BY doc_id
), dfs AS (SELECT term, count(*) AS ndoc, CAST(sum(tf) AS BIGINT) AS nentry FROM post GROUP BY term
), col AS (SELECT count(*) AS n, avg(doc_length) AS avgdl FROM lens)"""


def _scores(match: str, idf: str = "ln((n + 1.0) / (ndoc + 0.5))") -> str:
    """SQL of the score shares of the terms that the CTE ``match`` (term, qtf) has."""
    return f"""{POSTINGS}, {match}, shares AS (
  SELECT p.doc_id, p.term, p.tf, m.qtf, d.ndoc, {idf} AS idf, l.doc_length,
         m.qtf * ({idf}) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_length / avgdl)) AS score
  FROM post p JOIN matched m USING (term) JOIN dfs d USING (term) JOIN lens l ON l.doc_id = p.doc_id, col
), bm AS (SELECT doc_id, sum(score) AS score FROM shares GROUP BY doc_id)"""


_EXACT = "matched AS (SELECT unnest(['reserve', 'fund', 'maintenance', 'owner']) AS term, 1.0 AS qtf)"


def fresh(spark, d):
    """An index made anew from the documents."""
    built = se.build_index(t(spark, d, "documents"))
    return se.Index(materialize(built.postings, "postings"))


_open: dict = {}


def index(spark, d):
    """The index of the documents, stored once in a session and opened by every search after that."""
    folder = kept(spark, "index", d, lambda path: se.StoredIndex.write(se.build_index(t(spark, d, "documents")), path, 16))
    if folder not in _open:
        _open[folder] = se.StoredIndex(spark, folder)
    return _open[folder]


@query(f"WITH {POSTINGS} SELECT doc_id, doc_length, unique_terms FROM lens")
def search_document_stats(spark, d):
    return fresh(spark, d).documents


@query(f"WITH {POSTINGS} SELECT term, ndoc, nentry FROM dfs")
def search_term_stats(spark, d):
    return fresh(spark, d).terms


@query(f"""WITH {POSTINGS} SELECT n AS total_documents, round(avgdl, 6) AS avg_document_length,
(SELECT CAST(sum(doc_length) AS BIGINT) FROM lens) AS total_terms, (SELECT count(*) FROM dfs) AS unique_terms FROM col""")
def search_collection_stats(spark, d):
    return fresh(spark, d).collection().withColumn("avg_document_length", F.round("avg_document_length", 6))


@query(f"""SELECT doc_id, len(list_filter({_TOK}, lambda x: octet_length(encode(x)) > 1 AND octet_length(encode(x)) <= 100
  AND NOT list_contains([{", ".join(f"'{w}'" for w in se.STOPWORDS)}], x))) AS n_tokens FROM documents WHERE text IS NOT NULL""")
def search_pure_tokens(spark, d):
    """Tokens of each document without stop words and odd lengths."""
    docs = t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(se.pure_tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH {_scores(_EXACT)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def search_bm25(spark, d):
    """The twenty best documents (a top-k report)."""
    return se.bm25_search(index(spark, d), TEXT, 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_scores(_EXACT)} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_bm25_all(spark, d):
    """Every matching document."""
    return se.bm25_search(index(spark, d), TEXT, None).withColumn("score", F.round("score", 6))


@query(f"WITH {_scores(_EXACT)} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_stored_index(spark, d):
    """The same from an index stored by term, of which only the folders of the query's terms are read."""
    stored = se.StoredIndex.write(se.build_index(t(spark, d, "documents")), new_folder(spark, "index"), 16)
    return se.bm25_search(stored, TEXT, None).withColumn("score", F.round("score", 6))


@query(f"WITH {_scores(_EXACT, 'greatest(ln((n - ndoc + 0.5) / (ndoc + 0.5)), 1e-6)')} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_bm25_fts5(spark, d):
    """The same with the FTS5 form of idf."""
    return se.bm25_search(index(spark, d), TEXT, None, variant="fts5").withColumn("score", F.round("score", 6))


@query(f"""WITH {_scores("matched AS (SELECT term, 1.0 AS qtf FROM dfs WHERE starts_with(term, 'maint'))")}
SELECT doc_id, round(score, 6) AS score FROM bm""")
def search_prefix(spark, d):
    return se.bm25_search(index(spark, d), "maint", None, prefix=True).withColumn("score", F.round("score", 6))


_TRI = "list_distinct(list_transform(range(1, length('  ' || {x} || ' ') - 1), lambda i: substr('  ' || {x} || ' ', i, 3)))"
_A, _B = _TRI.format(x="term"), _TRI.format(x="'maintenence'")


@query(f"""WITH {_scores(f"matched AS (SELECT term, 1.0 AS qtf FROM dfs WHERE len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))) >= 0.3)")}
SELECT doc_id, round(score, 6) AS score FROM bm""")
def search_fuzzy(spark, d):
    """A misspelt word by trigram similarity."""
    return se.bm25_search(index(spark, d), "maintenence", None, fuzzy=0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH {_scores(_EXACT)} SELECT term, tf, ndoc, round(idf, 6) AS idf, doc_length, round(score, 6) AS score FROM shares
WHERE doc_id = (SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 1)""")
def search_explain(spark, d):
    """The shares of the best document's score."""
    i = index(spark, d)
    best = se.bm25_search(i, TEXT, 1).first()["doc_id"]
    out = se.bm25_explain(i, TEXT, best)
    return out.select("term", "tf", "ndoc", F.round("idf", 6).alias("idf"), "doc_length", F.round("score", 6).alias("score"))


@query(f"""WITH {POSTINGS}, {ASSIGNED}, hit AS (SELECT DISTINCT doc_id FROM post WHERE term IN ('reserve', 'fund', 'maintenance', 'owner'))
SELECT facet_name, facet_value, count(DISTINCT doc_id) AS doc_count FROM asg WHERE facet_name IN ('lang', 'doc_kind') AND doc_id IN (SELECT doc_id FROM hit) GROUP BY ALL""")
def search_with_facets(spark, d):
    """Facet counts of the documents that a search finds."""
    found = se.matching_documents(index(spark, d), TEXT)
    return fa.facet_counts(document_facets(spark, d).where("facet_name in ('lang', 'doc_kind')"), among=found)


@query(f"""WITH {POSTINGS.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN text || ' unlabelled' ELSE text END AS text FROM documents WHERE doc_kind <> 'forum'))")}
SELECT term, ndoc, nentry FROM dfs""")
def search_sync(spark, d):
    """Term statistics after an incremental change: unlabelled texts get a word more, forum posts are deleted."""
    docs = t(spark, d, "documents")
    changed = docs.where("lang is null and doc_kind != 'forum'").select("doc_id", F.concat("text", F.lit(" unlabelled")).alias("text"))
    return se.sync_documents(fresh(spark, d), changed, docs.where("doc_kind = 'forum'").select("doc_id")).terms


@query(f"""WITH {POSTINGS}, stop AS (SELECT term AS word FROM dfs WHERE ndoc * 2 > (SELECT n FROM col))
SELECT term, ndoc, nentry FROM dfs WHERE term NOT IN (SELECT word FROM stop)""")
def search_stopwords(spark, d):
    """Term statistics without the words of over half of the documents, removed by a stop word table."""
    i = fresh(spark, d)
    n = i.documents.count()
    stop = i.terms.where(F.col("ndoc") * 2 > n).select(F.col("term").alias("word"))
    return se.build_index(t(spark, d, "documents"), stopwords=stop).terms


def _query_vector(spark, d) -> list[float]:
    rows = t(spark, d, "embeddings")
    return rows.orderBy("vec_id").select("embedding").first()[0]


_Q = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIM = {
    "cosine": "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[]))",
    "l2": "1 / (1 + list_sum(list_transform(range(1, len(v) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - v[i]) * (CAST(embedding[i] AS DOUBLE) - v[i]))))",
    "inner_product": "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[]))",
}


def _knn_sql(metric: str) -> str:
    return f"WITH {_Q} SELECT vec_id, round({_SIM[metric]}, 6) AS similarity FROM embeddings, q ORDER BY {_SIM[metric]} DESC, vec_id LIMIT 10"


def _knn(spark, d, metric):
    near = se.nearest(t(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 10, metric)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("cosine"))
def vector_cosine(spark, d):
    """Exact nearest vectors by cosine (a top-k report)."""
    return _knn(spark, d, "cosine")


@query(_knn_sql("l2"))
def vector_l2(spark, d):
    return _knn(spark, d, "l2")


@query(_knn_sql("inner_product"))
def vector_inner_product(spark, d):
    return _knn(spark, d, "inner_product")


@query(f"""WITH {_scores(_EXACT)}, {_Q}, near AS (
  SELECT vec_id AS doc_id, {_SIM["cosine"]} AS similarity FROM embeddings, q ORDER BY similarity DESC, doc_id LIMIT 80
), fused AS (SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, coalesce(score, 0) AS s, coalesce(similarity, 0) AS v FROM bm b FULL JOIN near v ON v.doc_id = b.doc_id)
SELECT doc_id, round(s, 6) AS bm25_score, round(v, 6) AS vector_score, round(0.6 * s + 0.4 * v, 6) AS combined
FROM fused ORDER BY 0.6 * s + 0.4 * v DESC, doc_id LIMIT 20""")
def search_hybrid(spark, d):
    """BM25 and vectors fused with weight 0.4 (a top-k report); vec_id stands for doc_id."""
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("values"))
    out = se.hybrid_search(index(spark, d), vectors, TEXT, _query_vector(spark, d), 0.4, 20)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("bm25_score", "vector_score", "combined")])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_missing(spark, d):
    """Documents without an embedding."""
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return se.without_embedding(t(spark, d, "documents").select("doc_id"), vectors, "doc_id")


@query(f"""WITH {ASSIGNED}, {_Q}, near AS (SELECT vec_id AS doc_id FROM embeddings, q ORDER BY {_SIM["cosine"]} DESC, vec_id LIMIT 50)
SELECT facet_name, facet_value, count(DISTINCT doc_id) AS doc_count FROM asg WHERE facet_name = 'lang' AND doc_id IN (SELECT doc_id FROM near) GROUP BY ALL""")
def facet_counts_near_vector(spark, d):
    """Facet counts among the fifty nearest vectors."""
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    near = se.nearest(vectors, "doc_id", "embedding", _query_vector(spark, d), 50)
    return fa.facet_counts(document_facets(spark, d), "lang", near)


@query(f"""WITH {POSTINGS} SELECT term, ndoc, nentry FROM dfs WHERE term NOT IN ('de', 'la', 'the', 'of')""")
def search_language_config(spark, d):
    """Term statistics by a text configuration with stop words of its own."""
    words = spark.createDataFrame([(" De ",), ("la",), ("The",), ("of",), ("",)], "word string")
    table = se.delete_stopwords(se.import_stopwords(se.import_stopwords(None, words, "spanish"), words, "french"), "french")
    return se.configured_index(t(spark, d, "documents"), "spanish", stopwords=table).terms


_VALID = """valid AS (SELECT doc_id, chunk_index, content, doc_id * 100000 + chunk_index AS k FROM chunks_raw WHERE doc_id IS NOT NULL AND chunk_index IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY loaded_at DESC, content DESC) = 1)"""
_CHUNKS = _scores(_EXACT).replace("unnest(" + _TOK + ") AS term FROM documents", "unnest(" + _TOK + ") AS term FROM (SELECT k AS doc_id, content AS text FROM valid)")


@query(f"""WITH {_VALID}, {_CHUNKS}, best AS (SELECT v.doc_id, v.chunk_index, score, content FROM bm JOIN valid v ON v.k = bm.doc_id ORDER BY score DESC, v.doc_id, v.chunk_index LIMIT 20)
SELECT b.doc_id, CAST(b.chunk_index AS BIGINT) AS chunk_index, round(score, 6) AS score, md5(b.content) AS content, md5(string_agg(n.content, chr(10) ORDER BY n.chunk_index)) AS context
FROM best b JOIN valid n ON n.doc_id = b.doc_id AND n.chunk_index BETWEEN b.chunk_index - 1 AND b.chunk_index + 1 GROUP BY ALL""")
def search_contextual(spark, d):
    """The twenty best chunks with those beside them (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("loaded_at"), F.desc("content"))
    chunks = t(spark, d, "chunks_raw").where("doc_id is not null and chunk_index is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = se.contextual_search(materialize(chunks.select("doc_id", "chunk_index", "content"), "chunks"), TEXT, 20)
    return out.select("doc_id", "chunk_index", F.round("score", 6).alias("score"), F.md5("content").alias("content"), F.md5("context").alias("context"))


@query(f"""WITH {_Q}, c AS (SELECT vec_id AS doc_id, vec_id % 3 AS chunk_index, embedding FROM embeddings)
SELECT doc_id, chunk_index, round({_SIM["cosine"]}, 6) AS similarity FROM c, q ORDER BY {_SIM["cosine"]} DESC, doc_id, chunk_index LIMIT 10""")
def vector_chunks(spark, d):
    """The nearest chunks, which have a key of two columns (a top-k report)."""
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("chunk_index"), "embedding")
    return se.nearest(rows, ["doc_id", "chunk_index"], "embedding", _query_vector(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE len(embedding) END AS size FROM embeddings WHERE vec_id % 11 <> 0""")
def vector_upsert(spark, d):
    """Every seventh vector replaced, every eleventh deleted."""
    rows = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    early = rows.where("vec_id % 7 = 0").select("vec_id", F.array(F.lit(0.0), F.lit(1.0)).alias("v"), F.lit(1).alias("seq"))
    late = rows.where("vec_id % 7 = 0").select("vec_id", F.array(F.lit(2.0)).alias("v"), F.lit(2).alias("seq"))
    gone = rows.where("vec_id % 11 = 0").select("vec_id", F.lit(None).cast("array<double>").alias("v"), F.lit(3).alias("seq"))
    return se.upsert_embeddings(rows, early.unionByName(late).unionByName(gone), ["vec_id"], "seq").select("vec_id", F.size("v").alias("size"))


@query(f"WITH {POSTINGS} SELECT (SELECT count(*) FROM lens) AS documents, (SELECT count(*) FROM dfs) AS terms, (SELECT count(*) FROM post) AS postings")
def search_snapshot(spark, d):
    """The size of the index."""
    return fresh(spark, d).snapshot()
