import pytest
from pyspark.sql import functions as F

from tessera.operators import facets as fa

DOCS = [
    (1, "a", "Technology", "US", ["x", "y"], 10.0, True),
    (2, "b", "Technology", "EU", ["x", "x"], 25.0, False),
    (3, "c", "Cooking", "US", [], 35.0, None),
    (4, "d", "Technology", "US", None, 45.0, True),
    (5, None, None, None, ["z"], None, None),
    (None, "e", "Cooking", "EU", ["x"], 1.0, True),
]


@pytest.fixture
def assigned(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, category string, region string, tags array<string>, price double, stock boolean")
    kinds = {
        "category": fa.plain("category"),
        "region": fa.plain("region"),
        "tags": fa.array("tags"),
        "price": fa.bucket("price", [0, 20, 30, 40]),
        "stock": fa.boolean(F.col("stock")),
    }
    return fa.assignments(docs, "id", kinds)


def test_filters(assigned, rows):
    assert rows(fa.filter_documents(assigned, {"category": "Technology"})) == {(1,), (2,), (4,)}
    assert rows(fa.filter_documents(assigned, {"category": "Technology", "region": "US"})) == {(1,), (4,)}
    assert rows(fa.filter_documents(assigned, {"region": ["US", "EU"], "category": ["Cooking"]})) == {(3,)}
    assert rows(fa.filter_documents(assigned, {"unknown": "x"})) == set()
    assert rows(fa.filter_documents(assigned, {})) == set()
    many = {"category": [str(i) for i in range(255)] + ["Technology"]}
    assert len(rows(fa.filter_documents(assigned, many))) == 3
    assert rows(fa.filter_documents_json(assigned, '{"category": "Cooking"}')) == {(3,)}
    with pytest.raises(ValueError):
        fa.filter_documents_json(assigned, "[1]")


def test_counts_and_kinds(assigned, rows):
    counts = rows(fa.facet_counts(assigned))
    assert ("tags", "x", 2) in counts and ("tags", "z", 1) in counts  # repeated elements count once
    assert ("price", "3", 1) in counts and ("price", "0", 1) in counts
    assert ("stock", "true", 2) in counts
    top = [tuple(r) for r in fa.top_values(assigned, 1).where("facet_name = 'region'").collect()]
    assert top == [("region", "US", 3, 1)]
    among = fa.filter_documents(assigned, {"category": "Technology"})
    assert rows(fa.facet_counts(assigned, "region", among)) == {("region", "US", 2), ("region", "EU", 1)}


def test_deltas(spark, assigned, rows):
    log = [(1, "region", "EU", 1, 1), (1, "region", "US", -1, 2), (9, "region", "EU", -1, 3), (2, "region", "EU", 1, 4), (3, "region", "US", -1, 5), (3, "region", "US", 1, 6)]
    schema = "doc_id long, facet_name string, facet_value string, delta int, seq int"
    after = fa.apply_deltas(assigned, spark.createDataFrame(log, schema))
    assert rows(after.where("facet_name = 'region'").select("doc_id", "facet_value")) == {(1, "EU"), (2, "EU"), (3, "US"), (4, "US")}
    with pytest.raises(Exception, match="bad facet delta"):
        fa.apply_deltas(assigned, spark.createDataFrame([(1, "region", "EU", 2, 1)], schema)).collect()


def test_bitmaps_and_hierarchy(spark, assigned, rows):
    card = fa.bitmaps(assigned).where("facet_name = 'category'").groupBy("facet_value").agg(F.sum("cardinality"))
    assert rows(card) == {("Technology", 3), ("Cooking", 1)}
    parents = spark.createDataFrame([("region", "US", "World"), ("region", "EU", "World")], "facet_name string, facet_value string, parent_value string")
    assert rows(fa.children_of(parents, "region", "World")) == {("US",), ("EU",)}
    assert ("region", "World", "US", 3) in rows(fa.hierarchical_counts(assigned, parents))
    assert rows(fa.drop_facets(assigned, ["tags"]).where("facet_name = 'tags'")) == set()


def test_search_values(spark, rows):
    data = [(1, "doc.lang", "English"), (1, "doc.source", "Gent"), (2, "doc.lang", "dutch"), (3, "geo.city", "GENT"), (4, "doc.lang", None)]
    asg = spark.createDataFrame(data, "doc_id long, facet_name string, facet_value string")
    assert rows(fa.search_values(asg, value="gEn")) == {(1, "doc.source", "Gent"), (3, "geo.city", "GENT")}
    assert rows(fa.search_values(asg, "doc", "lang")) >= {(1, "doc.lang", "English"), (2, "doc.lang", "dutch")}
    assert [r["doc_id"] for r in fa.search_values(asg, dimension="city").collect()] == [3]
    assert [r["doc_id"] for r in fa.search_values(asg, "doc", value="h", limit=1).collect()] == [1]
    assert fa.search_values(asg.limit(0)).collect() == []
