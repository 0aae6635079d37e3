"""Schema drift (problem 2) and orphan references (problem 7) on small fixtures."""

from datetime import datetime, timedelta

import pytest

from tessera.operators import drift as dr
from tessera.operators import references as re

T0 = datetime(2024, 1, 1)
COLS = "table_id long, migration_id string, column_semantic_id long, column_name string, data_type string, updated_at timestamp, canonical string"
REL = "relation_semantic_id long, workspace_id string, from_schema string, from_table string, to_schema string, to_table string, source_table_id long, target_table_id long, updated_at timestamp, ingested_at timestamp, kind string"
TAB = "table_id long, workspace_id string, table_schema string, table_name string, registered_at timestamp, deleted_at timestamp, spans string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


@pytest.fixture
def aliases(spark):
    rows = [("data_type", "int4", "integer"), ("data_type", "int", "integer"), ("data_type", "text", "text"), ("data_type", "string", "text"), ("language", "int", "x"), ("data_type", None, "y")]
    return spark.createDataFrame(rows, "alias_kind string, alias string, canonical string")


@pytest.fixture
def migrations(spark):
    rows = [("m1", day(1)), ("m1", day(9)), ("m2", day(2)), ("m3", day(3)), (None, day(1)), ("m4", None)]
    return spark.createDataFrame(rows, "id string, applied_at timestamp")


def columns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], COLS)


def test_drift(spark, migrations, aliases, rows):
    c = columns(
        spark,
        [
            (1, "m1", 1, "a", "INT", day(1)),
            (1, "m1", 2, "b", "text", day(1)),
            (1, "m1", 3, "c", "text", day(1)),
            (1, "m2", 1, " A ", "int4 ", day(2)),  # neither renamed nor retyped
            (1, "m2", 2, "b2", "int", day(2)),
            (1, "m2", 2, "b2", "int", day(2)),  # an exact copy
            (1, "m2", 2, "old", "text", day(1)),  # an older row of the same file
            (1, "m3", 1, "a", "blob", day(3)),  # a type without an alias
            (1, "m3", 3, "c", "string", day(3)),  # back again
            (2, "m3", 9, None, None, None),
            (None, "m1", 1, "x", "text", day(1)),
            (1, "nowhere", 1, "x", "text", day(1)),
        ],
    )
    got = rows(dr.drift_report(c, migrations, aliases).select("table_id", "migration_id", "column_semantic_id", "change"))
    assert got == {
        (1, "m2", 2, "renamed"), (1, "m2", 2, "retyped"), (1, "m2", 3, "removed"), (1, "m3", 1, "retyped"), (1, "m3", 2, "removed"), (1, "m3", 3, "added"),
    }
    assert dr.drift_report(c.limit(0), migrations, aliases).collect() == []
    assert dr.drift_report(c, migrations.limit(0), aliases).collect() == []
    schema = {r["column_semantic_id"]: r for r in dr.unified_schema(c, migrations, aliases).where("table_id = 1").collect()}
    assert schema[2]["type"] == "text" and schema[2]["conflicting"] and schema[2]["alternatives"] == "text since m1; integer since m2"
    assert schema[3]["type"] == "text" and not schema[3]["conflicting"]


def test_unified_records(spark, migrations, aliases):
    c = columns(spark, [(1, "m1", 1, "n", "int", day(1)), (1, "m1", 2, "Note ", "text", day(1)), (1, "m2", 1, "n", "text", day(2))])
    recs = [
        (1, 1, "m1", '{"N": 5, "note": "x", "more": 1}'),
        (1, 1, "m1", '{"N": 5, "note": "x", "more": 1}'),
        (2, 1, "m1", '{"n": "five"}'),
        (3, 1, "m1", '{"n": 5'),
        (4, 1, "m1", None),
        (5, 1, "m2", '{"n": 7}'),
        (6, 8, "m1", '{"n": null}'),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in recs], "record_id long, table_id long, migration_id string, payload string, status string")
    got = {(r["record_id"], r["name"], r["tag"], r["raw"], r["v_bigint"], r["status"]) for r in dr.unified_records(df, c, migrations, aliases).collect()}
    assert got == {
        (1, "n", "integer", "5", 5, "ok"), (1, "Note ", "text", "x", None, "ok"), (1, "more", None, "1", None, "unlisted"),
        (2, "n", "integer", "five", None, "wrong type"), (2, "Note ", "text", None, None, "missing"),
        (3, None, None, '{"n": 5', None, "unreadable"), (4, None, None, None, None, "unreadable"),
        (5, "n", "text", "7", None, "ok"), (6, "n", None, None, None, "unlisted"),
    }
    assert dr.unified_records(df.limit(0), c, migrations, aliases).collect() == []


def relation(i, source, target, name, at, ingested=0, ws="w"):
    return (i, ws, "s", "f", "S ", name, source, target, day(at), day(ingested), "clash")


def test_orphans(spark, rows):
    tables = spark.createDataFrame(
        [
            (1, "w", "s", "One", day(0), None, "clash"),
            (1, "w", "s", " one", day(0), None, "clash"),  # the same table
            (2, "w", "s", "two", day(5), None, None),
            (3, "w", "s", "three", day(0), day(4), None),
            (4, "v", "s", "four", day(0), None, None),
            (5, "w", "s", "five", None, None, None),
        ],
        TAB,
    )
    rels = spark.createDataFrame(
        [
            relation(10, 1, 2, "ONE ", 3),
            relation(11, 1, 3, "two", 4),
            relation(12, 4, None, None, 6),
            relation(13, 9, 1, " ", 6, 1),
            relation(13, 1, 1, "one", 6, 2),  # a correction
            relation(14, 5, 5, "three", None),
            relation(None, 9, 9, "x", 1),
            relation(15, 3, 10, "one", 1),
        ],
        REL,
    )
    direct = {
        (10, "target_table_id", "late"), (11, "target_table_id", "deleted"), (11, "to_table", "late"), (12, "source_table_id", "missing"), (15, "target_table_id", "missing"),
    }
    assert rows(re.orphan_references(rels, tables)) == direct
    levels = {(r["relation_semantic_id"], r["ref_field"], r["level"]) for r in re.orphan_cascade(rels, tables).collect()}
    assert {x for x in levels if x[2] == 0} == {(i, f, 0) for i, f, _ in direct}
    assert (13, "target_table_id", 1) in levels and (13, "to_table", 1) in levels  # table 1 stands in an orphaned record
    assert (14, "to_table", 1) in levels
    assert re.orphan_references(rels.limit(0), tables).collect() == []
    assert all(r["kind"] == "missing" for r in re.orphan_references(rels, tables.limit(0)).collect())
    assert sum(r["orphans"] for r in re.orphan_report(rels, tables).where("level = 0").collect()) == len(direct)


def test_cascade_deeper_than_a_hundred_levels(spark):
    n = 104
    tables = spark.createDataFrame([(i, "w", "s", f"t{i}", day(0), None, None) for i in range(n)], TAB).coalesce(1)
    rels = spark.createDataFrame([relation(0, 0, n, None, 1)] + [relation(i, i, i - 1, None, 1) for i in range(1, n)], REL).coalesce(1)
    levels = {(r["relation_semantic_id"], r["kind"], r["level"]) for r in re.orphan_cascade(rels, tables).collect()}
    assert levels == {(0, "missing", 0)} | {(i, "inherited", i) for i in range(1, n)}


def test_records_have_their_canonical_branch(spark, migrations, rows):
    aliases = spark.createDataFrame([("data_type", t, t) for t in ("integer", "numeric", "double", "boolean", "timestamp")], "alias_kind string, alias string, canonical string")
    names = {1: "n", 2: "b", 3: "t"}
    kinds = {"m1": ("integer", "boolean", "timestamp"), "m2": ("numeric", "boolean", "timestamp"), "m3": ("double", "boolean", "timestamp")}
    c = columns(spark, [(1, m, i, names[i], k[i - 1], day(1)) for m, k in kinds.items() for i in names])
    recs = [
        (1, 1, "m1", '{"n": "5", "b": "yes", "t": "2024-01-02"}'),
        (2, 1, "m2", '{"n": "2,5", "b": "7", "t": "x"}'),
        (3, 1, "m3", '{"n": "1.5", "b": "02/01/2024", "t": "true"}'),
        (4, 1, "m1", '{"n": "2.5", "b": null, "t": "-1e3"}'),
        (5, 1, "m3", '{"n": "no", "b": "t", "t": "9"}'),
    ]
    out = dr.unified_records(spark.createDataFrame(recs, "record_id long, table_id long, migration_id string, payload string"), c, migrations, aliases)
    numbers = {(r["record_id"], r["v_bigint"], r["v_double"], r["v_boolean"], r["status"]) for r in out.where("name = 'n'").collect()}
    assert numbers == {(1, 5, 5.0, None, "ok"), (2, None, 2.5, None, "ok"), (3, None, 1.5, None, "ok"), (4, None, 2.5, None, "wrong type"), (5, None, None, False, "wrong type")}
    others = {(r["record_id"], r["name"], r["v_bigint"], r["v_double"], r["v_boolean"], r["v_timestamp"], r["status"]) for r in out.where("name != 'n'").collect()}
    assert others == {
        (1, "b", None, None, True, None, "ok"), (1, "t", None, None, None, day(1), "ok"), (2, "b", 7, None, None, None, "wrong type"), (2, "t", None, None, None, None, "wrong type"),
        (3, "b", None, None, None, day(1), "wrong type"), (3, "t", None, None, True, None, "wrong type"), (4, "b", None, None, None, None, "null"), (4, "t", None, -1000.0, None, None, "wrong type"),
        (5, "b", None, None, True, None, "ok"), (5, "t", 9, None, None, None, "wrong type"),
    }
    assert rows(dr.found_alternatives(out)) == {
        (1, 1, "integer", "double", 1), (1, 1, "double", "boolean", 1), (1, 2, "boolean", "bigint", 1), (1, 2, "boolean", "timestamp", 1),
        (1, 3, "timestamp", "text", 1), (1, 3, "timestamp", "boolean", 1), (1, 3, "timestamp", "double", 1), (1, 3, "timestamp", "bigint", 1),
    }
