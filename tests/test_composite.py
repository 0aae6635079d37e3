import pytest

from tessera.operators import composite as co
from tessera.operators import ingest as ing


def test_composite_and_recall(spark, rows):
    assigned = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (2, "s", "x"), (1, "s", "x")], "doc_id long, facet_name string, facet_value string")
    rel = spark.createDataFrame([(1, "r", 7, 8, None)], "relation_id long, relation_type string, source_id long, target_id long, deprecated_at long")
    src = spark.createDataFrame([(1, "s1"), (2, None)], "doc_id long, source_ref string")
    proj = spark.createDataFrame(
        [("p", "x", None, "FACT", "c", 1.0, "s1", "t", "active"), ("q", "x", None, "FACT", "c", 1.0, "s2", "t", "active")],
        "id string, agent_id string, scope string, proj_type string, content string, weight double, source_ref string, source_type string, status string",
    )
    seeds = spark.createDataFrame([(7,)], "node long")
    got = rows(co.flatten(co.composite(assigned, {"k": "a"}, ["s"], rel, seeds, 1, src, proj, "x")))
    assert got == {("documents", "1", None), ("facet_counts", "s=x", 1), ("reachable", "7", 0), ("reachable", "8", 1), ("source_refs", "s1", None), ("projections", "p", None)}
    none = rows(co.flatten(co.composite(assigned, {"k": "zzz"}, ["s"], rel, seeds, 0, src, proj, "x")))
    assert none == {("reachable", "7", 0)}  # a filter without a match counts nothing
    s = lambda *r: spark.createDataFrame(list(r), "doc_id long, score double")
    out = {r[0]: round(r[1], 6) for r in co.recall(s((1, 1.0)), s((1, 1.0), (2, 1.0)), s((2, 0.5), (2, 1.0)), s((3, 1.0))).collect()}
    assert out == {1: 0.4, 2: 0.75, 3: 0.15}
    assert [tuple(r) for r in co.federated({"b": s((1, 1.0)), "a": s((2, 1.0), (3, 0.1))}, 2).collect()] == [("a", 2, 1.0), ("b", 1, 1.0)]


def test_views(spark, rows):
    views = spark.createDataFrame([("a", "w", 3, "stale", "old"), ("b", "w", 1, "frozen", "old"), ("c", "v", 1, "live", "old"), ("d", "w", 2, "live", "old")], co.ARTIFACT)
    fresh = spark.createDataFrame([("a", 3, "new"), ("b", None, "new"), ("c", 9, "new")], "artifact_id string, expected_version long, payload string")
    after, events = co.refresh_views(views, fresh, 50)
    assert rows(after.select("artifact_id", "version", "status", "payload")) == {("a", 4, "live", "new"), ("b", 1, "frozen", "old"), ("c", 1, "live", "old"), ("d", 2, "live", "old")}
    assert rows(events) == {("a", 4, "refreshed", 50), ("c", 1, "conflict", 50)}
    assert rows(co.mark_stale(views, ["w"]).select("artifact_id", "status")) == {("a", "stale"), ("b", "frozen"), ("c", "live"), ("d", "stale")}


def test_evaluation(spark, rows):
    want = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id long, contains string")
    have = spark.createDataFrame([(1, "a x b"), (1, "x"), (2, "x"), (3, "z")], "doc_id long, content string")
    assert rows(co.chunk_scores(want, have)) == {(1, 1, 2, 0.5), (2, 0, 1, 0.0)}
    p = "doc_id long, lang string, kind string"
    a, b = spark.createDataFrame([(1, "en", None), (2, "fr", "x")], p), spark.createDataFrame([(1, "en", None)], p)
    assert rows(co.profile_scores(a, b, ["lang", "kind"])) == {(1, 2, 1.0), (2, 0, 0.0)}


def test_write_facts(spark):
    s = "id string, workspace_id string, source_ref string, schema_id string, content string, facets_json string, doc_id long, version long, updated_at_unix long"
    facts = spark.createDataFrame([("f1", "w", "a", "s", "old", "{}", 5, 2, 1)], s)
    c = spark.createDataFrame([("w", "a", "s", "x", "{}", 1), ("w", "a", "s", "y", "{}", 2), ("w", "b", "s", "z", "{}", 1), (None, "b", "s", "z", "{}", 1)], "workspace_id string, source_ref string, schema_id string, content string, facets_json string, seq int")
    got = {r["source_ref"]: r for r in ing.write_facts(facts, c, 9).collect()}
    assert (got["a"]["id"], got["a"]["content"], got["a"]["doc_id"], got["a"]["version"]) == ("f1", "y", 5, 3)
    assert got["b"]["version"] == 1 and got["b"]["doc_id"] > 5 and got["b"]["id"].startswith("facet_") and len(got) == 2


def test_entry_has_sql_for_registered_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def test_core_does_not_import_the_optional_subpackage():
    import pathlib
    import re

    import tessera

    root = pathlib.Path(tessera.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
    with pytest.raises(ModuleNotFoundError):
        import tessera.nothing  # noqa: F401


def test_running_sums_without_a_task_per_group(spark):
    from pyspark.sql import functions as F

    from tessera.runtime import running_sum

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, 'g') as g", "(id * 7919) % 3000 as k", "id % 4 as v").repartition(5)
    got = running_sum(rows, ["g"], ["k"], F.col("v"), "total").collect()
    want, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["k"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        want[r["g"], r["k"]] = sums[r["g"]]
    assert {(r["g"], r["k"]): r["total"] for r in got} == want
