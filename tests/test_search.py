import pytest
from pyspark.sql import functions as F

from tessera.operators import search as se

DOCS = [
    (1, "bitmap search with vectors"),
    (2, "vector search over bitmap postings, vector first"),
    (3, "graph traversal"),
    (4, None),
    (5, ""),
]


@pytest.fixture
def index(spark):
    return se.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))


def test_tokens(spark):
    row = spark.range(1).select(se.tokens(F.lit("L'ÉTÉ à 3x, naïve 😀-ok")).alias("t"), se.pure_tokens(F.lit("The cat is a x")).alias("p")).first()
    assert row["t"] == ["l", "ÉtÉ", "à", "3x", "naïve", "😀", "ok"]
    assert row["p"] == ["cat"]


def test_bm25_by_hand(index):
    import math

    found = {r["doc_id"]: r["score"] for r in se.bm25_search(index, "vector vector graph", None).collect()}
    avgdl = (4 + 7 + 2) / 3
    idf = lambda df: math.log(4 / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl))
    assert found[2] == pytest.approx(2 * idf(1) * part(2, 7))
    assert found[3] == pytest.approx(idf(1) * part(1, 2))
    assert 1 not in found  # 'vectors' is another term
    assert se.bm25_search(index, "...", 10).collect() == []


def test_prefix_fuzzy_and_updates(spark, index, rows):
    assert rows(se.matching_documents(index, "vect", prefix=True)) == {(1,), (2,)}
    assert (3,) in rows(se.matching_documents(index, "grahp", fuzzy=0.2))
    synced = se.sync_documents(index, spark.createDataFrame([(3, "vector")], "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"))
    assert rows(synced.postings.where("doc_id in (2, 3)")) == {(3, "vector", 1)}
    stop = spark.createDataFrame([("search",)], "word string")
    plain = se.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"), stopwords=stop)
    assert rows(plain.terms.where("term = 'search'")) == set()


def test_vectors_and_fusion(spark, rows):
    vecs = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 0.0]), (30, [0.0, 0.0]), (40, [1.0])], "doc_id long, values array<double>")
    near = [tuple(r) for r in se.nearest(vecs, "doc_id", "values", [2.0, 0.0], 3).collect()]
    assert near == [(10, 1.0), (20, 1.0), (30, 0.0)]  # ties by id, zero vectors score 0, other lengths are left out
    l2 = [r[1] for r in se.nearest(vecs, "doc_id", "values", [1.0, 1.0], 3, "l2").collect()]
    assert l2 == [0.5, 0.5, pytest.approx(1 / 3)]
    with pytest.raises(ValueError):
        se.vector_similarity(F.col("values"), F.col("values"), "x")
    bm = spark.createDataFrame([(10, 1.0), (50, 3.0)], "doc_id long, score double")
    v = spark.createDataFrame([(10, 0.5), (20, 1.0)], "doc_id long, similarity double")
    assert [r["doc_id"] for r in se.fuse(bm, v, 0.5).collect()] == [50, 10, 20]
    with pytest.raises(ValueError):
        se.fuse(bm, v, 1.5)


def test_hybrid_golden(spark):
    docs = [(1, "bitmap search with roaring vector blocks"), (2, "vector search meets bitmap vector postings"), (3, "graph paths only"), (4, "bitmap")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    vecs = spark.createDataFrame([(1, [0.9, 0.1, 0.0]), (2, [1.0, 0.0, 0.1]), (3, [0.5, 0.5, 0.5]), (4, [0.0, 1.0, 0.0])], "doc_id long, values array<double>")
    out = se.hybrid_search(se.build_index(frame), vecs, "bitmap vector search", [0.99, 0.04, 0.08], 0.85, 3).collect()
    assert [r["doc_id"] for r in out] == [2, 1, 3]
    for r in out:
        assert r["combined"] == pytest.approx(0.15 * r["bm25_score"] + 0.85 * r["vector_score"])


def test_stored_index(spark, index, rows, tmp_path):
    stored = se.StoredIndex.write(index, str(tmp_path / "index"), 4)
    assert rows(stored.postings) == rows(index.postings) and rows(stored.documents) == rows(index.documents) and rows(stored.terms) == rows(index.terms)
    for text in ("vector graph graph", "nothing", ""):
        assert rows(se.bm25_search(stored, text, None)) == rows(se.bm25_search(index, text, None))
    assert rows(se.matching_documents(stored, "vect", prefix=True)) == {(1,), (2,)}
    plan = stored.lookup(["graph"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [" in plan
    assert "In(term, [graph])" in plan or "EqualTo(term,graph)" in plan


def test_stems():
    from tessera.functions.stemming import dutch, english, german

    known = {"consistency": "consist", "knightly": "knight", "relational": "relat", "hoping": "hope", "hopping": "hop", "ties": "tie", "cries": "cri", "generously": "generous", "skies": "sky", "roll": "roll", "a": "a"}
    assert {w: english(w) for w in known} == known
    known = {"aufeinander": "aufeinand", "häusern": "haus", "kategorischen": "kategor", "regierungen": "regier", "ergebnisse": "ergebnis"}
    assert {w: german(w) for w in known} == known
    known = {"lichamelijke": "licham", "opheffing": "opheff", "mogelijkheden": "mogelijk", "maan": "man"}
    assert {w: dutch(w) for w in known} == known


def test_text_configurations(spark, rows):
    docs = spark.createDataFrame([(1, "The owners were searching"), (2, "an owner searches"), (3, None), (4, "")], "doc_id long, text string")
    index = se.configured_index(docs, "english")
    assert rows(index.terms) == {("owner", 2, 2), ("search", 2, 2)}
    assert se.configured_query(spark, "the OWNERS searched", "english") == "owner search"
    assert rows(se.matching_documents(index, se.configured_query(spark, "Owning searches", "english"))) == {(1,), (2,)}
    assert ("the", 1, 1) in rows(se.configured_index(docs, "simple").terms)
    own = se.import_stopwords(None, spark.createDataFrame([("Owner ",), (" ",)], "word string"), "english")
    assert rows(own) == {("english", "owner")} and "were" in {r["term"] for r in se.configured_index(docs, "english", stopwords=own).terms.collect()}
    assert se.delete_stopwords(own, "english", ["x"]).count() == 1 and se.delete_stopwords(own, "english").count() == 0
    with pytest.raises(ValueError):
        se.configured_index(docs, "klingon")


def test_stored_index_finds_the_same(spark, index, rows, tmp_path):
    stored = se.StoredIndex.write(index, str(tmp_path / "index"), 4)
    for how in ({}, {"prefix": True}, {"fuzzy": 0.3}, {"prefix": True, "fuzzy": 0.3}):
        for text in ("vector graph", "vectr", "gra", "...", "bitmap bitmap"):
            a, b = (sorted((r[0], round(r[1], 9)) for r in se.bm25_search(i, text, None, **how).collect()) for i in (index, stored))
            assert a == b, (how, text)
    assert stored.stats() == index.stats() and rows(stored.snapshot()) == rows(index.snapshot())
    assert rows(stored.similar_terms("vektor", 0.0)) == rows(index.similar_terms("vektor", 0.0))
    empty = se.StoredIndex.write(se.Index(index.postings.limit(0)), str(tmp_path / "none"), 4)
    assert se.bm25_search(empty, "vector", None).collect() == [] and empty.stats() == (0, 1.0)


def test_tables_vectors_and_contexts(spark, rows):
    tables = spark.createDataFrame([("w", 7, "docs"), ("w", 9, "docs"), ("v", 8, "docs")], "workspace_id string, table_id long, table_name string")
    assert [se.resolve_table(tables, "w", *x) for x in ((1,), (7,), (8,), (None, "docs"), (None, "none"), (None, ""), ())] == [1, 7, None, 7, None, None, 1]
    vecs = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k long, v array<double>")
    change = spark.createDataFrame([(1, [5.0], 1), (1, [6.0], 2), (2, None, 1), (3, [3.0], 1)], "k long, v array<double>, seq int")
    assert {r["k"]: r["v"] for r in se.upsert_embeddings(vecs, change, ["k"], "seq").collect()} == {1: [6.0], 3: [3.0]}
    chunks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta owner"), (1, 2, "gamma"), (2, 0, "owner"), (3, 0, None)], "doc_id long, chunk_index int, content string")
    got = {(r["doc_id"], r["chunk_index"]): (r["content"], r["context"]) for r in se.contextual_search(chunks, "owner").collect()}
    assert got == {(1, 1): ("beta owner", "alpha\nbeta owner\ngamma"), (2, 0): ("owner", "owner")}
    near = spark.createDataFrame([(3, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "doc_id long, chunk_index int, values array<double>")
    assert [r["doc_id"] for r in se.contextual_search(chunks, "nothing", 1, near, [1.0, 0.0]).collect()] == [3]
    assert [tuple(r) for r in se.nearest(near, ["doc_id", "chunk_index"], "values", [0.0, 1.0], 1).collect()] == [(2, 0, 1.0)]
