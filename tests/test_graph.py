import pytest

from tessera.operators import gpq
from tessera.operators import graph as g

ENTITIES = [
    (1, "person", "Alice", 0.9, '{"domain":"people","age":30}', None),
    (2, "person", "Bob", 0.8, '{"domain":"people","age":"30"}', None),
    (3, "topic", "PostgreSQL", 0.7, '{"domain":"database"}', None),
    (4, "topic", "SQL", 0.6, "{}", None),
    (5, "topic", "Old", 0.6, "{}", 1),
    (6, "topic", "Alone", 0.5, None, None),
]
RELATIONS = [
    (10, "knows", 1, 2, None, None, 0.9, None),
    (11, "writes_about", 1, 3, 100, 200, 0.5, None),
    (12, "writes_about", 2, 4, 150, None, 0.7, None),
    (13, "part_of", 3, 4, None, None, 1.0, None),
    (14, "knows", 2, 5, None, None, 0.9, 1),
    (15, "knows", 1, 1, None, None, 0.1, None),
]
E = "entity_id long, entity_type string, name string, confidence double, metadata_json string, deprecated_at long"
R = "relation_id long, relation_type string, source_id long, target_id long, valid_from long, valid_to long, confidence double, deprecated_at long"


@pytest.fixture
def ents(spark):
    return spark.createDataFrame(ENTITIES, E)


@pytest.fixture
def rels(spark):
    return spark.createDataFrame(RELATIONS, R)


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_traversal(spark, rels, ents, rows):
    assert rows(g.k_hops(rels, seed(spark, 1), 1)) == {(1, 0), (2, 1), (3, 1)}
    assert rows(g.k_hops(rels, seed(spark, 4), 2)) == {(4, 0), (2, 1), (3, 1), (1, 2)}
    assert rows(g.k_hops(rels, seed(spark, 2), 1, g.EdgeFilter(include_deprecated=True))) == {(2, 0), (1, 1), (4, 1), (5, 1)}
    assert rows(g.k_hops(rels, seed(spark, 1), 3, g.EdgeFilter(types=[]))) == {(1, 0)}
    assert rows(g.k_hops(rels, seed(spark), 3)) == set()
    assert g.shortest_path_hops(rels, 1, 4) == 2
    assert g.shortest_path_hops(rels, 1, 1) == 0
    assert g.shortest_path_hops(rels, 1, 6) is None
    assert [x["to"] for x in g.shortest_path(rels, 1, 4)] == [2, 4]
    assert rows(g.traverse(ents, rels, "Alice", "outbound", None, 2, "SQL").select("depth", "name")) == {(0, "Alice"), (1, "Bob"), (2, "SQL")}
    assert g.traverse(ents, rels, "Nobody").collect() == []
    assert rows(g.dependencies(rels, 1, ["knows", "writes_about", "part_of"], 2)) == {
        (2, "knows", 1), (3, "writes_about", 1), (1, "knows", 1), (4, "writes_about", 2), (4, "part_of", 2), (2, "knows", 2), (3, "writes_about", 2), (1, "knows", 2),
    }


def test_filters_and_properties(spark, rels, rows):
    ids = lambda df: {r["relation_id"] for r in df.collect()}
    assert ids(g.filter_edges(rels, g.EdgeFilter(valid_after=250))) == {10, 12, 13, 15}
    assert ids(g.filter_edges(rels, g.EdgeFilter(valid_before=120, confidence_min=0.5))) == {10, 11, 13}
    props = spark.createDataFrame([(10, "since", "integer", None, None, 5), (11, "note", "text", "x", None, None)], "relation_id long, property_key string, value_type string, value_text string, value_number double, value_integer long")
    assert ids(g.filter_edges(rels, g.EdgeFilter(properties=[("since", "gt", 4)]), props)) == {10}
    assert ids(g.filter_edges(rels, g.EdgeFilter(properties=[("note", "in_text", "x", "y")]), props)) == {11}
    with pytest.raises(ValueError):
        g.filter_edges(rels, g.EdgeFilter(properties=[("since", "like", 4)]), props)
    assert [r["relation_id"] for r in g.sort_by_property(rels, props, "since").collect()][0] == 10


def test_degrees_components(ents, rels, rows):
    deg = {r["entity_id"]: r["total_degree"] for r in g.degrees(ents, rels).collect()}
    assert deg == {1: 4, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0}
    assert rows(g.components(rels)) == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_components_on_a_long_path(spark):
    import random

    ids = list(range(1, 200))
    random.Random(3).shuffle(ids)
    edges = [(i, "r", a, b, None, None, 1.0, None) for i, (a, b) in enumerate(zip(ids, ids[1:]))] + [(999, "r", 500, 501, None, None, 1.0, None)]
    got = {r["node"]: r["component"] for r in g.components(spark.createDataFrame(edges, R)).collect()}
    assert {got[i] for i in ids} == {1} and got[501] == 500


def test_entity_search(ents, rels):
    found = [(r["entity_id"], r["rank"]) for r in g.entity_text_search(ents, "postgresql").collect()]
    assert found == [(3, 3.5)]
    assert g.entity_text_search(ents, "postgresql nothing").collect() == []
    assert [r["entity_id"] for r in g.entity_text_search(ents, "people person").collect()] == [1, 2]
    assert [r["entity_id"] for r in g.substring_search(ents, ["sql"]).collect()] == [3, 4]
    assert [r["entity_id"] for r in g.find_entities(ents, metadata={"domain": "database"}).collect()] == [3]
    with pytest.raises(KeyError):
        g.get_entity(ents, names=["Old"])
    market = g.marketplace_search(ents, rels, "postgresql", ["part_of"], 1).collect()
    assert [r["entity_id"] for r in market] == [3, 4]


def test_events_of_a_subgraph(spark, rels):
    got = [(r["kind"], r["id"], r["depth"]) for r in g.subgraph_events(rels, seed(spark, 3), 1).collect()]
    assert got == [("seed_node", 3, 0), ("edge", 11, 1), ("edge", 13, 1), ("node", 1, 1), ("node", 4, 1), ("done", None, 2)]


def test_pattern_language(ents, rels):
    q = gpq.parse("WORKSPACE w\nMATCH (p:person)\nWHERE p.metadata.age = 30\nPROJECT p.name\nLIMIT 5")
    assert [r[0] for r in gpq.execute(q, ents, rels).collect()] == ["Alice"]  # a number never equals a text
    q = gpq.parse("WORKSPACE w\nMATCH (p:person)\nWHERE p.metadata.age = '30'\nPROJECT p.name")
    assert [r[0] for r in gpq.execute(q, ents, rels).collect()] == ["Bob"]
    q = gpq.parse("WORKSPACE w\nMATCH (a:person)-[r:writes_about]->(b:topic {name: 'SQL'})\nPROJECT a.name, r.relation_id, b.name")
    assert [tuple(r) for r in gpq.execute(q, ents, rels).collect()] == [("Bob", 12, "SQL")]
    q = gpq.parse("WORKSPACE w\nMATCH (a:person {name: 'Alice'})-[r:x]->(b:topic)\nHOPS 1..2\nWHERE r.relation_type IN ('knows', 'writes_about')\nPROJECT b.name")
    assert [tuple(r) for r in gpq.execute(q, ents, rels).collect()] == [("Alice", 1), ("Bob", 1), ("PostgreSQL", 1), ("Alice", 2), ("Bob", 2), ("PostgreSQL", 2), ("SQL", 2)]
    assert '"hops":{"min":1,"max":2}' in gpq.to_ast(q)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a:b)\nPROJECT a.name",
        "WORKSPACE w\nMATCH (a:b)\nPROJECT a.name\nLIMIT 0",
        "WORKSPACE w\nMATCH (a:b)\nPROJECT a.name\nLIMIT 1001",
        "WORKSPACE w\nMATCH (a:b)\nPROJECT c.name",
        "WORKSPACE w\nMATCH (a:b)\nPROJECT a.colour",
        "WORKSPACE w\nMATCH (a:b)-[r:x]->(c:d)\nHOPS 3..1\nPROJECT c.name",
        "WORKSPACE w\nMATCH (a:b)-[r:x]->(c:d)\nHOPS 1..2\nPROJECT c.name",
        "WORKSPACE w\nMATCH (a:b)\nWHERE a.name ~ 'x'\nPROJECT a.name",
        "WORKSPACE w\nMATCH (a:b)\nSORT a.name\nPROJECT a.name",
    ],
)
def test_pattern_errors(text):
    with pytest.raises(ValueError):
        gpq.parse(text)


def test_lookups_and_changes(spark, ents, rels, rows):
    ids = lambda df: {r["relation_id"] for r in df.collect()}
    assert ids(g.find_relations(rels, source=1, relation_type="knows")) == {10, 15}
    assert ids(g.find_relations(rels, source=2, include_deprecated=True)) == {12, 14}
    assert ids(g.find_relations_by_names(ents, rels, "Alice", "Bob")) == {10}
    links = spark.createDataFrame([(1, 7, 1, "r", 0.2), (1, 7, 1, "r", 0.8), (2, 7, 1, "r", 0.5), (1, 8, 2, "r", 0.5)], "entity_id long, doc_id long, table_id long, role string, confidence double")
    assert rows(g.entity_documents(links, seed(spark, 1).toDF("entity_id"), 1)) == {(1, 7, 1, "r", 0.8)}
    props = spark.createDataFrame([(10, "k", 1.0, None), (10, "k", 2.0, None), (99, "k", 1.0, None), (12, "k", None, 5)], "relation_id long, property_key string, value_number double, value_integer long")
    assert rows(g.project_properties(props, rels)) == {(10, "k", 2.0, None), (12, "k", None, 5)}
    assert rows(g.property_sums(g.project_properties(props, rels), rels, "k")) == {(2, "knows", 1, 2.0), (4, "writes_about", 1, 5.0)}
    dead = {r["relation_id"]: r["deprecated_at"] for r in g.deprecate(rels, "relation_id", [10, 14], 7).collect()}
    assert dead[10] == 7 and dead[14] == 1 and dead[11] is None
    e, r = g.remove_entities(ents, rels, "Al")
    assert {x["entity_id"] for x in e.collect()} == {2, 3, 4, 5} and ids(r) == {12, 13, 14}
    with pytest.raises(ValueError):
        g.remove_entities(ents, rels, "")
    aliases = spark.createDataFrame([("pg", 3, 0.9), ("pg", 5, 0.9), ("pg", 4, 0.1)], "term string, entity_id long, confidence double")
    assert rows(g.resolve_terms(aliases, ents, ["pg"], 0.5)) == {("pg", 3, 0.9)}
    assert rows(g.resolve_terms(aliases, ents, [])) == set()


def test_components_need_no_limit_of_rounds(spark):
    """A path of 2^12 nodes in order is one component."""
    n = 2**12
    edges = spark.range(1, n).selectExpr("id as relation_id", "'r' as relation_type", "id as source_id", "id + 1 as target_id", "cast(null as long) as deprecated_at")
    assert g.components(edges).groupBy("component").count().collect() == [(1, n)]
    assert g.components(edges.limit(0)).collect() == []


def test_paths_from_both_ends(spark):
    """Against breadth-first search from one end, on a random graph."""
    import random

    rng = random.Random(5)
    edges = [(i, "r", rng.randrange(60), rng.randrange(60), None, None, 1.0, None) for i in range(70)]
    near: dict[int, set[int]] = {}
    for _, _, a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rels = spark.createDataFrame(edges, R).cache()
    by_id = {e[0]: {e[2], e[3]} for e in edges}
    for a, b in [(rng.randrange(60), rng.randrange(60)) for _ in range(8)]:
        depth, level, seen = 0, {a}, {a}
        while level and b not in seen:
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
            depth += 1
        want = depth if b in seen else None
        path = g.shortest_path(rels, a, b, 20)
        assert (None if path is None else len(path)) == want
        assert all({x["from"], x["to"]} == by_id[x["relation_id"]] for x in path or [])
        if path:
            assert path[0]["from"] == a and path[-1]["to"] == b and all(x["to"] == y["from"] for x, y in zip(path, path[1:]))
            assert g.shortest_path(rels, a, b, len(path) - 1) is None


def test_large_levels_are_written(spark, monkeypatch, rows):
    edges = [(i, "r", 0, i, None, None, 1.0, None) for i in range(1, 40)] + [(i + 100, "r", i, i + 100, None, None, 1.0, None) for i in range(1, 40)]
    rels = spark.createDataFrame(edges, R)
    plain = rows(g.k_hops(rels, seed(spark, 0), 2))
    monkeypatch.setattr(g, "SMALL_LEVEL", 3)
    assert rows(g.k_hops(rels, seed(spark, 0), 2)) == plain and len(plain) == 79


def test_lists_come_in_blocks(spark):
    edges = spark.createDataFrame([(i, "r", 1, i, None, None, 1.0, None) for i in range(2, 102)], R)
    got = [r for r in g.adjacency(edges, 10).collect() if r["entity_id"] == 1]
    assert len(got) == 10 and sorted(x for r in got for x in r["relation_ids"]) == list(range(2, 102))
    assert all(r["relation_ids"] == sorted(r["relation_ids"]) for r in got)
    assert {r["block"] for r in g.adjacency(edges).collect()} == {0}


def test_edge_filters_without_effect(rels, rows):
    assert rows(g.filter_edges(rels, g.EdgeFilter(doc_types=["law"], jurisdictions=["be"]))) == rows(g.filter_edges(rels))
