import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory as me
from tessera.operators import quality as qu

E = "entity_id long, entity_type string, name string, confidence double, metadata_json string, deprecated_at long"
R = "relation_id long, relation_type string, source_id long, target_id long, valid_from long, valid_to long, confidence double, deprecated_at long"


@pytest.fixture
def ents(spark):
    rows = [(1, "unit", "A", 0.9, '{"kind":"flat"}', None), (2, "unit", "B", 0.9, '{"kind":"garage"}', None), (3, "person", "P", 0.9, "{}", None), (4, "unit", "C", 0.9, None, 1)]
    return spark.createDataFrame(rows, E)


@pytest.fixture
def rels(spark):
    rows = [(10, "owns", 3, 1, 0, 10, 0.9, None), (11, "owns", 3, 1, 5, None, 0.9, None), (12, "owns", 3, 2, 8, 9, 0.9, None), (13, "owns", 1, 3, None, None, 0.9, 1)]
    return spark.createDataFrame(rows, R)


def test_rules_and_transitions(spark, ents, rels, rows):
    text = json.dumps(
        [
            {"rule_id": "r1", "entity_type": "unit", "relation_type": "owns", "direction": "in", "target_entity_type": "person", "min_count": 1, "max_count": 1},
            {"rule_id": "r2", "entity_type": "unit", "relation_type": "rents", "min_count": 1, "metadata_json": {"entity_filter": {"metadata": {"kind": {"eq": "flat"}}}}},
        ]
    )
    rules = qu.upsert_rules(spark.createDataFrame([], qu.RULE), text)
    got = rows(qu.rule_states(rules, ents, rels).select("rule_id", "entity_id", "n", "issue"))
    assert got == {("r1", 1, 2, "too_many_relations"), ("r1", 2, 1, None), ("r2", 1, 0, "missing_required_relation")}
    assert rows(qu.delete_rules(rules, ["r1"]).select("rule_id")) == {("r2",)}
    with pytest.raises(ValueError):
        qu.upsert_rules(rules, '[{"rule_id": "x", "direction": "sideways"}]')
    now = qu.rule_states(rules, ents, rels)
    states, events = qu.rule_transitions(None, now, "a")
    assert {r["from_state"] for r in events.collect()} == {"unknown"} and events.count() == 3
    _, again = qu.rule_transitions(states, now, "b")
    assert again.collect() == []
    fixed = now.withColumn("state", F.lit("valid"))
    _, events = qu.rule_transitions(states, fixed, "c")
    assert all(r["remediation"] for r in events.collect()) and events.count() == 2


def test_diagnostics(spark, ents, rels, rows):
    declared = spark.createDataFrame([("owns", "person", "person")], "edge_type string, source_type string, target_type string")
    assert len(rows(qu.type_mismatches(declared, ents, rels))) == 3
    assert rows(qu.isolated_entities(ents, rels).select("subject")) == set()
    assert rows(qu.small_components(rels, 3).select("subject", "detail")) == {("1", "3")}
    links = spark.createDataFrame([(1,)], "entity_id long")
    props = spark.createDataFrame([(10, 7)], "relation_id long, ref_doc_id long")
    assert rows(qu.evidence_gaps(ents, rels, links, props).select("subject")) == {("2",), ("3",), ("11",), ("12",)}
    every = qu.diagnostics([qu.isolated_entities(ents, rels), qu.small_components(rels)], 1)
    assert every.count() == 1


def test_conflicts(rels, rows):
    assert rows(qu.exclusive_conflicts(rels, ["owns"]).select("source_id", "n_targets")) == {(3, 2)}
    assert rows(qu.redundant_relations(rels).select("source_id", "target_id", "n")) == {(3, 1, 2)}
    assert rows(qu.overlap_conflicts(rels, ["owns"])) == {(12, 11)}


def test_overlaps_behind_a_longer_relation(spark, rows):
    import random

    few = [(1, "owns", 9, 1, 0, 100, 0.9, None), (2, "owns", 9, 2, 0, 50, 0.9, None), (3, "owns", 9, 1, 10, 20, 0.9, None)]
    df = spark.createDataFrame(few, R)
    assert rows(qu.overlap_conflicts(df, ["owns"])) == {(2, 1), (3, 2)}
    assert rows(qu.overlap_pairs(df, ["owns"])) == {(1, 2, "different_target"), (1, 3, "same_target"), (2, 3, "different_target")}
    r = random.Random(5)
    many = [(i, "owns", i % 12, r.randrange(3), b, b + r.randrange(30), 0.9, None) for i in range(240) for b in [r.randrange(60)]]
    want, pairs = {}, set()
    for x in many:
        for y in many:
            if x[2] == y[2] and x[0] != y[0] and x[4] <= y[5] and y[4] <= x[5]:
                pairs.add((min(x[0], y[0]), max(x[0], y[0]), "same_target" if x[3] == y[3] else "different_target"))
                if x[3] != y[3] and (y[4], y[0]) < (x[4], x[0]):
                    want[x[0]] = max(want.get(x[0], (0, 0)), (y[5], y[0]))
    df = spark.createDataFrame(many, R)
    assert rows(qu.overlap_conflicts(df, ["owns"])) == {(a, b) for a, (_, b) in want.items()}
    assert rows(qu.overlap_pairs(df, ["owns"])) == pairs


def test_coverage_and_convergence(spark, rows):
    facts = spark.createDataFrame(
        [("w", "on", "c1", '{"node_id":"A"}'), ("w", "on", "B", "{}"), ("w", "on", "X", None), ("w", "other", "A", "{}")], "workspace_id string, schema_id string, content string, facets_json string"
    )
    ents = spark.createDataFrame([("w", "A", "t", None), ("w", "B", "t", None), ("w", "X", "t", 1), ("w", "A", "t", None)], "workspace_id string, name string, entity_type string, deprecated_at long")
    assert rows(qu.coverage(facts, ents, ("on",))) == {("w", 2, 3, 2 / 3)}
    assert rows(qu.coverage_gaps(facts, ents, ("on",)).select("id", "criticality")) == {("X", "normal")}
    counts = spark.createDataFrame([("w", 1, 2, 1, 2, 5, 0, None, 3)], "workspace_id string, registry_nodes long, registry_edges long, entity_types long, edge_labels long, graph_entities long, graph_relations long, coverage_gaps long, diagnostics_issues long")
    assert rows(qu.convergence_actions(counts).select("issue_type")) == {("runtime_graph_relation_materialization_gap",), ("graph_diagnostics_issues",)}
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert rows(qu.reconcile(a, b, ["k"], "a", "b").select("issue_type", "subject")) == {("only_in_a", "1"), ("only_in_b", "3")}
    score = qu.evidence_score(spark.createDataFrame([(1.0, 1.0, 0.5, None, 1.0)], "doc_ref double, chunk double, confidence double, agreement double, recency double"))
    assert score.first()["evidence_score"] == pytest.approx(0.8)


def test_propositions(spark):
    lines = [("fact|subject=ada|conf=0.7| x = a=b |junk|subject=bob",), ("no bar",), ("|x=1",), ("  goal | k=v ",), (None,)]
    got = [r["r"] for r in spark.createDataFrame(lines, "l string").select(me.parse_line(F.col("l")).alias("r")).collect()]
    assert got[0]["record_type"] == "fact" and got[0]["fields"] == {"subject": "bob", "conf": "0.7", "x": "a=b"}
    assert got[1] is None and got[2] is None and got[4] is None
    assert got[3]["record_type"] == "goal" and got[3]["fields"] == {"k": "v"}


PROJ = "id string, user_id string, projection_type string, content string, rank_hint double, confidence double, metadata_json string, facets_json string"


def test_memory(spark):
    rows = [
        ("p1", "u", "FACT", "Hotel booked|x", 0.4, 0.5, '{"scope":"player_123"}', "{}"),
        ("p2", "u", "proposition", "fact|subject=ada|object=graph\nhotel", None, 1.0, "{}", "{}"),
        ("p3", "u", "odd", "hotel", 0.1, -2.0, "{}", "{}"),
        ("p4", "v", "FACT", "hotel", 0.1, 1.0, "{}", "{}"),
        ("p5", "u", "note", "edge|from=ada|to=e1", 0.9, 0.5, "{}", None),
    ]
    proj, types = spark.createDataFrame(rows, PROJ), me.projection_types(spark)
    ranked = [(r["id"], round(r["score"], 6)) for r in me.rank(proj, types, "u", "HOTEL").collect()]
    assert ranked == [("p1", 2.0), ("p2", 1.9)]
    assert [r["id"] for r in me.rank(proj, types, "u", "", ["raw"]).collect()] == ["p5"]
    packed = [r["id"] for r in me.pack_context(proj, types, "u", "hotel").collect()]
    assert packed == ["p1", "p2"]  # 'odd' is no type to pack
    assert [r["id"] for r in me.pack_context(proj, types, "u", "hotel", "player:player_123").collect()] == ["p1"]
    assert me.pack_context(proj, types, "u", "hotel", "nobody").collect() == []
    edges = spark.createDataFrame([("u", "ada", "acme", 0.9), ("u", "zoe", "ada", 0.5), ("v", "ada", "no", 1.0)], "user_id string, node_from string, node_to string, weight double")
    hops = {r["node"]: round(r["score"], 6) for r in me.next_hops(edges, proj, types, "u", ["ada"]).collect()}
    assert hops == {"acme": 0.9, "zoe": 0.4, "graph": 1.2, "e1": 0.475}


def test_agent_projections(spark):
    rows = [
        ("a", "x", None, "FACT", "Alpha", 0.5, "s1", "t", "active"), ("b", "x", "w:1", "CONSTRAINT", "alpha beta", 0.2, "s2", "t", "blocking"),
        ("c", "x", "w2", "FACT", "alpha", 0.9, "s1", "t", "active"), ("d", "x", "w", "FACT", "alpha", 0.9, "s1", "t", "done"), ("e", "y", "w", "FACT", "alpha", 0.9, "s1", "t", "active"),
    ]
    p = spark.createDataFrame(rows, "id string, agent_id string, scope string, proj_type string, content string, weight double, source_ref string, source_type string, status string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(me.materialize_projections(p, "x", query="ALPHA", workspace="w")) == ["a", "b"]
    assert ids(me.materialize_pack(p, "x")) == ["b", "c", "a"]
    assert ids(me.materialize_projections(p, "x", source_refs=[])) == []
    assert me.projection_relevance(p, "x", "beta", "alpha", workspace="w").first()[0] == pytest.approx(0.5)


def spans(spark, data):
    return spark.createDataFrame([(i, "owns", 1, t, b, e, 0.9, None) for i, t, b, e in data], R)


def test_a_further_relation_hides_no_overlap(spark, rows):
    three = spans(spark, [(1, 1, 0, 100), (2, 2, 0, 50), (3, 1, 10, 20)])
    assert rows(qu.overlap_conflicts(three, ["owns"])) == {(2, 1), (3, 2)}
    assert rows(qu.overlap_conflicts(three.where("relation_id != 1"), ["owns"])) == {(3, 2)}
    assert rows(qu.overlap_pairs(three, ["owns"])) == {(1, 2, "different_target"), (1, 3, "same_target"), (2, 3, "different_target")}


def test_overlaps_against_brute_force(spark, rows):
    import random

    rng = random.Random(9)
    data = [(i, rng.randrange(4), rng.choice([None, rng.randrange(60)]), None) for i in range(60)]
    data = [(i, t, b, rng.choice([None, (b or 0) + rng.randrange(12)])) for i, t, b, _ in data]
    lo = lambda x: -(2**62) if x is None else x
    hi = lambda x: 2**62 if x is None else x
    want = {
        i
        for i, t, b, e in data
        if any(t2 != t and (lo(b2), i2) < (lo(b), i) and hi(e2) >= lo(b) for i2, t2, b2, e2 in data)
    }
    got = rows(qu.overlap_conflicts(spans(spark, data), ["owns"]))
    assert {r[0] for r in got} == want and len(got) == len(want)
    assert rows(qu.overlap_conflicts(spans(spark, data), ["owns"], hot_rows=5)) == got  # range by range


def test_intervals_and_granularity(spark, rows):
    assert rows(qu.invalid_intervals(spans(spark, [(1, 1, 5, 4), (2, 1, 5, 5), (3, 1, None, 0), (4, 1, 5, None)])).select("relation_id")) == {(1,)}
    ents = spark.createDataFrame([(1, "unit", "a", 1.0, None, None), (5, "country", "x", 1.0, None, None), (6, "city", "y", 1.0, None, None), (7, "city", "z", 1.0, None, None)], E)
    tree = spark.createDataFrame([("city", "country"), ("country", None)], "entity_type string, parent_type string")
    got = qu.granularity_conflicts(spans(spark, [(1, 5, None, None), (2, 6, None, None), (3, 7, None, None), (4, 5, None, None)]), ents, tree)
    assert rows(got.select("relation_id", "coarse_relation_id", "n_coarse")) == {(2, 1, 2), (3, 1, 2)}
    assert qu.granularity_conflicts(spans(spark, []), ents, tree).collect() == []


def test_decisions_on_actions(spark, rows):
    found = spark.createDataFrame([("w", "gap", "high", 0.9), ("w", "gap", "high", 0.9), ("v", "gap", "low", 0.5)], "workspace_id string, issue_type string, severity string, confidence double")
    one = qu.propose_actions(None, found, "r1", 10)
    assert one.count() == 2
    two = qu.propose_actions(one, found, "r2", 20)
    assert rows(two.select("run_id")) == {("r1",)} and two.count() == 2
    ids = {r["workspace_id"]: r["action_id"] for r in one.collect()}
    say = lambda *x: spark.createDataFrame([(*y, None) for y in x], "action_id string, decision string, actor string, note string")
    decided = qu.decide_actions(two, say((ids["w"], "approved", "me"), (ids["v"], "rejected", "me")), 30)
    assert rows(decided.select("workspace_id", "status", "decided_at")) == {("w", "approved", 30), ("v", "rejected", 30)}
    done = qu.record_results(decided, spark.createDataFrame([(ids["w"], "applied", None)], "action_id string, status string, result_json string"), 40)
    assert rows(done.select("workspace_id", "status", "applied_at", "result_json")) == {("w", "applied", 40, "{}"), ("v", "rejected", None, "{}")}
    late = qu.decide_actions(done, say((ids["w"], "rejected", "you")), 50)
    assert rows(late.select("workspace_id", "status")) == {("w", "applied"), ("v", "rejected")}
    assert [r["workspace_id"] for r in qu.list_actions(done, "r1").collect()] == ["v", "w"] and qu.list_actions(done, "r1", "applied").count() == 1
    assert rows(qu.list_runs(done).select("workspace_id", "n_actions", "n_open")) == {("w", 1, 0), ("v", 1, 0)}
    for bad in (lambda: qu.decide_actions(done, say((ids["w"], "maybe", "me")), 1), lambda: qu.record_results(done, spark.createDataFrame([(ids["w"], "odd", None)], "action_id string, status string, result_json string"), 1)):
        with pytest.raises(Exception, match="decision|status"):
            bad().collect()


def test_coverage_of_a_domain_and_decay(spark, rows):
    facts = spark.createDataFrame([("w", "s", "x", "{}"), ("w", "s", "y", "{}"), ("v", "s", "x", "{}")], "workspace_id string, schema_id string, content string, facets_json string")
    ents = spark.createDataFrame([("w", 1, "x", "t", None), ("w", 2, "y label", "t", None)], "workspace_id string, entity_id long, name string, entity_type string, deprecated_at long")
    spaces = spark.createDataFrame([("w", "law", None), ("v", "law", None), ("law2", None, "L")], "workspace_id string, domain string, label string")
    assert rows(qu.coverage_by_domain(facts, ents, spaces, "w", ("s",))) == {("w", 1, 2, 0.5)}
    assert rows(qu.coverage_by_domain(facts, ents, spaces, "law", ("s",))) == {("v", 0, 1, 0.0)}
    assert qu.coverage_by_domain(facts, ents, spaces, "nobody", ("s",)).collect() == []
    gaps = spark.createDataFrame([("w", "y", "y label", "t", "normal"), ("w", "z", "z", "t", "normal")], "workspace_id string, id string, label string, entity_type string, criticality string")
    decayed = spark.createDataFrame([(2, 0.4)], "entity_id long, decayed double")
    assert rows(qu.decayed_gaps(gaps, ents, decayed).select("id", "decayed_confidence")) == {("y", 0.4), ("z", None)}
