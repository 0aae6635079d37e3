"""Schemas that drift between files (problem 2): one fused schema per table, a report of changes, one typed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_name
from ..runtime import materialize

# Branches of the tagged union, by canonical type; any other type is held as text.
BRANCHES = {
    "bigint": "bigint",
    "integer": "bigint",
    "double": "double",
    "numeric": "decimal(38,6)",
    "boolean": "boolean",
    "timestamp": "timestamp",
    "json": "json",
    "text": "text",
}


def canonical_types(aliases: DataFrame) -> DataFrame:
    """(alias, canonical) of the data types, one row per alias; the alias table is a fixed, small vocabulary."""
    rows = aliases.where((F.col("alias_kind") == "data_type") & F.col("alias").isNotNull())
    return rows.groupBy(fold_name(F.col("alias")).alias("alias")).agg(F.min("canonical").alias("canonical"))


def column_lists(columns: DataFrame, migrations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(table_id, seq, migration_id, applied_at, column_semantic_id, name, folded, type): the cleaned lists of all files.

    seq numbers a table's files from 1 by the first applied_at of their migration (then by id). Rows repeated within a
    file count once, the latest updated_at wins (then name and type in order). Rows with null table_id,
    column_semantic_id or migration_id, or of an unknown migration, can't be placed and are left out. type is the
    canonical type, for unknown aliases the folded name of the type itself; null types are ''.
    """
    placed = columns.where(
        F.col("table_id").isNotNull() & F.col("column_semantic_id").isNotNull() & F.col("migration_id").isNotNull()
    ).select("table_id", "column_semantic_id", "migration_id", "column_name", "data_type", "updated_at")
    one = placed.groupBy("table_id", "migration_id", "column_semantic_id").agg(
        F.max(F.struct("updated_at", "column_name", "data_type")).alias("last")
    )
    applied = migrations.where(F.col("id").isNotNull() & F.col("applied_at").isNotNull())
    applied = applied.groupBy(F.col("id").alias("migration_id")).agg(F.min("applied_at").alias("applied_at"))
    one = one.join(applied, "migration_id").select(
        "table_id",
        "migration_id",
        "applied_at",
        "column_semantic_id",
        F.coalesce("last.column_name", F.lit("")).alias("name"),
        fold_name(F.coalesce("last.column_name", F.lit(""))).alias("folded"),
        fold_name(F.coalesce("last.data_type", F.lit(""))).alias("alias"),
    )
    one = one.join(canonical_types(aliases), "alias", "left")
    files = one.select("table_id", "migration_id", "applied_at").distinct()
    by_time = Window.partitionBy("table_id").orderBy("applied_at", "migration_id")
    files = files.withColumn("seq", F.row_number().over(by_time)).drop("applied_at")
    return one.join(files, ["table_id", "migration_id"]).select(
        "table_id",
        "seq",
        "migration_id",
        "applied_at",
        "column_semantic_id",
        "name",
        "folded",
        F.coalesce("canonical", "alias").alias("type"),
    )


def fuse_schemas(lists: DataFrame) -> DataFrame:
    """(table_id, column_semantic_id, history, types, files): one row per column, the parallel schemas fused.

    history is the column's entries in the order of the table's files, types its alternative types in order of
    appearance, each with the file that brought it, files the table's migration ids by seq. One shuffle by table; a
    column has at most one entry per file.
    """
    fields = ("seq", "migration_id", "name", "folded", "type")
    fused = lists.groupBy("table_id", "column_semantic_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("history"))
    names = lists.select("table_id", "seq", "migration_id").distinct()
    files = names.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("seq", "migration_id"))).alias("files"))
    first_of = lambda h, t: F.element_at(F.filter(h, lambda e: e["type"] == t), 1)
    types = F.transform(
        F.array_distinct(F.transform("history", lambda e: e["type"])),
        lambda t: F.struct(t.alias("type"), first_of(F.col("history"), t)["migration_id"].alias("since")),
    )
    return fused.join(files, "table_id").select(
        "table_id", "column_semantic_id", "history", types.alias("types"), F.col("files.migration_id").alias("files")
    )


def schema_changes(fused: DataFrame) -> DataFrame:
    """(table_id, migration_id, column_semantic_id, change, before, after, alternative) of each file against the one before it.

    change is 'added', 'removed', 'renamed' (the name differs beyond case and outer blanks) or 'retyped' (the canonical
    type differs); a column may be both renamed and retyped. A table's first file changes nothing. before and
    after are names, for 'retyped' types; alternative says of a 'retyped' whether the file brought the type as a new
    alternative, or the column had it before, and is null for other changes.
    """
    h, n = F.col("history"), F.size("history")
    none, unknown = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    step = lambda e, m, change, a, b, alternative=unknown: F.struct(
        m.alias("migration_id"), F.lit(change).alias("change"), a.alias("before"), b.alias("after"), alternative.alias("alternative")
    )
    brought = lambda e: F.exists("types", lambda t: (t["type"] == e["type"]) & (t["since"] == e["migration_id"]))

    def at(e: Column, i: Column) -> Column:
        """The changes that entry i of the history shows, with those of a gap or end behind it."""
        prev = F.when(i > 0, F.get(h, i - 1))
        nxt = F.get(h, i + 1)
        follows = prev["seq"] == e["seq"] - 1
        new = F.when((e["seq"] > 1) & (prev.isNull() | ~follows), step(e, e["migration_id"], "added", none, e["name"]))
        name = F.when(follows & (prev["folded"] != e["folded"]), step(e, e["migration_id"], "renamed", prev["name"], e["name"]))
        kind = F.when(follows & (prev["type"] != e["type"]), step(e, e["migration_id"], "retyped", prev["type"], e["type"], brought(e)))
        gone_at = F.get(F.col("files"), e["seq"])
        gone = F.when(
            (e["seq"] < F.size("files")) & (nxt.isNull() | (nxt["seq"] > e["seq"] + 1)),
            step(e, gone_at, "removed", e["name"], none),
        )
        return F.filter(F.array(new, name, kind, gone), lambda x: x.isNotNull())

    changes = F.flatten(F.transform(h, at))
    return (
        fused.where(n > 0)
        .select("table_id", "column_semantic_id", F.explode(changes).alias("c"))
        .select("table_id", "c.migration_id", "column_semantic_id", "c.change", "c.before", "c.after", "c.alternative")
    )


def drift_report(columns: DataFrame, migrations: DataFrame, aliases: DataFrame) -> DataFrame:
    """schema_changes() of the cleaned column lists; an empty table gives no rows."""
    return schema_changes(fuse_schemas(column_lists(columns, migrations, aliases)))


def unified_schema(columns: DataFrame, migrations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(table_id, column_semantic_id, name, type, alternatives, conflicting): the fused schema of each table.

    name is the column's latest; type the canonical one of all alternatives: the only one, or 'double' where all are
    numbers ('bigint' where all are whole), else 'text'. alternatives lists 'type since migration' in order.
    """
    fused = fuse_schemas(column_lists(columns, migrations, aliases))
    kinds = F.transform("types", lambda t: t["type"])
    all_in = lambda *of: F.forall(kinds, lambda t: t.isin(*of))
    return fused.select(
        "table_id",
        "column_semantic_id",
        F.element_at("history", -1)["name"].alias("name"),
        F.when(F.size(kinds) == 1, kinds[0])
        .when(all_in("bigint", "integer"), "bigint")
        .when(all_in("bigint", "integer", "double", "numeric"), "double")
        .otherwise("text")
        .alias("type"),
        F.concat_ws("; ", F.transform("types", lambda t: F.concat_ws(" since ", t["type"], t["since"]))).alias("alternatives"),
        (F.size(kinds) > 1).alias("conflicting"),
    )


def _number(v: Column) -> Column:
    """The text of a number with the decimal point as a point ('210,49' is 210.49)."""
    return F.when(v.rlike(r"^\s*-?\d+,\d+\s*$"), F.translate(v, ",", ".")).otherwise(v)


def _time(v: Column) -> Column:
    """A timestamp from ISO 8601 or day/month/year, else null."""
    iso = F.when(v.rlike(r"^\s*\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.trim(v)))
    day = F.when(v.rlike(r"^\s*\d\d/\d\d/\d{4}\s*$"), F.try_to_timestamp(F.trim(v), F.lit("dd/MM/yyyy")))
    return F.coalesce(iso, day)


def unified_records(records: DataFrame, columns: DataFrame, migrations: DataFrame, aliases: DataFrame) -> DataFrame:
    """One long table of all record fields: (record_id, table_id, migration_id, column_semantic_id, name, tag, raw,
    v_bigint, v_double, v_decimal, v_boolean, v_timestamp, v_json, v_text, canonical_type, status).

    Each record is read by its file's column list: a field belongs to the column whose name it has, but for case and
    outer blanks, and gets a branch by that file's type (tag): the value converted to it; the branch of canonical_type
    holds it as well, so that one branch gives the column in all files, where the value can be converted. v_text always
    holds the raw value, so that no value is lost, and name and canonical_type are those of the fused schema. status is
    'ok', 'null', 'wrong type' (the tag's branch can't hold the value: it stands in the branch that its text has, as
    found_alternatives() lists), 'missing' (a listed column without a field), 'unlisted' (a
    field without a column) or 'unreadable' (payload null or no whole JSON object; one row, without a column). Exact
    copies of a record count once. Records of unknown files have only unlisted fields.
    """
    rows = records.select("record_id", "table_id", "migration_id", "payload").distinct()
    whole = F.col("payload").isNotNull() & F.try_parse_json("payload").isNotNull()
    parsed = F.when(whole, F.from_json("payload", "map<string,string>"))
    rows = rows.withColumn("fields", parsed)
    lists = column_lists(columns, migrations, aliases).select(
        "table_id", "migration_id", "column_semantic_id", "folded", F.col("type").alias("tag")
    )
    fused = unified_schema(columns, migrations, aliases).select(
        "table_id", "column_semantic_id", "name", F.col("type").alias("canonical_type")
    )
    lists = materialize(lists.join(fused, ["table_id", "column_semantic_id"]), "lists")
    key = ["table_id", "migration_id"]
    per_file = lists.groupBy(*key).agg(
        F.collect_list(F.struct("column_semantic_id", "folded", "tag", "name", "canonical_type")).alias("listed")
    )
    base = rows.join(per_file, key, "left")
    fields = F.transform(F.map_entries("fields"), lambda e: F.struct(fold_name(e["key"]).alias("k"), e["value"].alias("v")))
    base = base.withColumn("fields", fields).withColumn("listed", F.coalesce("listed", F.array().cast(per_file.schema["listed"].dataType)))
    none = F.lit(None)

    def cell(c: Column | None, raw: Column, here: Column) -> Column:
        get = (lambda n, t: c[n]) if c is not None else (lambda n, t: none.cast(t))
        return F.struct(
            get("column_semantic_id", "bigint").alias("column_semantic_id"),
            get("name", "string").alias("name"),
            get("tag", "string").alias("tag"),
            get("canonical_type", "string").alias("canonical_type"),
            raw.alias("raw"),
            here.alias("here"),
        )

    known = F.transform(
        "listed",
        lambda c: cell(
            c,
            F.get(F.filter("fields", lambda f: f["k"] == c["folded"]), F.lit(0))["v"],
            F.when(F.exists("fields", lambda f: f["k"] == c["folded"]), F.lit("field")).otherwise(F.lit("missing")),
        ),
    )
    others = F.transform(
        F.filter("fields", lambda f: ~F.exists("listed", lambda c: c["folded"] == f["k"])),
        lambda f: F.struct(
            none.cast("bigint").alias("column_semantic_id"),
            f["k"].alias("name"),
            none.cast("string").alias("tag"),
            none.cast("string").alias("canonical_type"),
            f["v"].alias("raw"),
            F.lit("unlisted").alias("here"),
        ),
    )
    unread = F.array(cell(None, F.col("payload"), F.lit("unreadable")))
    cells = base.select(
        "record_id", "table_id", "migration_id", F.explode(F.when(F.col("fields").isNull(), unread).otherwise(F.concat(known, others))).alias("c")
    ).select("record_id", "table_id", "migration_id", "c.*")
    return _branches(cells)


def found_alternatives(unified: DataFrame) -> DataFrame:
    """(table_id, column_semantic_id, tag, type, n): the types that values of 'wrong type' have by their text, for the
    table of unified_records(); they are alternatives of the column beside the declared ones of unified_schema()."""
    found = F.lit("text")
    for kind in ("timestamp", "boolean", "double", "bigint"):
        found = F.when(F.col(f"v_{kind}").isNotNull(), kind).otherwise(found)
    rows = unified.where("status = 'wrong type'").select("table_id", "column_semantic_id", "tag", found.alias("type"))
    return rows.groupBy("table_id", "column_semantic_id", "tag", "type").agg(F.count("*").alias("n"))


def _branches(cells: DataFrame) -> DataFrame:
    raw, tag, canonical = F.col("raw"), F.col("tag"), F.col("canonical_type")
    number = _number(raw)
    whole = F.when(raw.rlike(r"^\s*-?\d+\s*$"), raw.try_cast("bigint"))
    truth = F.when(F.lower(raw).isin("true", "false", "t", "f", "yes", "no"), raw.try_cast("boolean"))
    cells = cells.withColumns(
        {
            "v_bigint": F.when(tag.isin("bigint", "integer"), whole),
            "v_double": F.when(tag == "double", number.try_cast("double")),
            "v_decimal": F.when(tag == "numeric", number.try_cast("decimal(38,6)")),
            "v_boolean": F.when(tag == "boolean", truth),
            "v_timestamp": F.when(tag == "timestamp", _time(raw)),
            "v_json": F.when((tag == "json") & F.try_parse_json("raw").isNotNull(), raw),
            "v_text": raw,
        }
    )
    held = F.coalesce(
        F.col("v_bigint").cast("string"),
        F.col("v_double").cast("string"),
        F.col("v_decimal").cast("string"),
        F.col("v_boolean").cast("string"),
        F.col("v_timestamp").cast("string"),
        F.col("v_json"),
        F.when(~tag.isin(*[t for t in BRANCHES if t != "text"]), raw),
    )
    status = (
        F.when(F.col("here") != "field", F.col("here"))
        .when(raw.isNull(), "null")
        .when(held.isNull(), "wrong type")
        .otherwise("ok")
    )
    cells = cells.withColumn("status", status)
    # A value its tag can't hold goes to the first of these branches that can, if only text can to no other.
    misfit = F.col("status") == "wrong type"
    real = F.when(number.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), number.try_cast("double"))
    is_whole, is_real, is_truth = whole.isNotNull(), real.isNotNull(), truth.isNotNull()
    as_double = F.when(canonical == "double", number.try_cast("double"))
    cells = cells.withColumns(
        {
            "v_bigint": F.coalesce("v_bigint", F.when(misfit, whole)),
            "v_double": F.coalesce("v_double", as_double, F.when(misfit & ~is_whole, real)),
            "v_boolean": F.coalesce("v_boolean", F.when(misfit & ~is_whole & ~is_real, truth)),
            "v_timestamp": F.coalesce("v_timestamp", F.when(misfit & ~is_whole & ~is_real & ~is_truth, _time(raw))),
        }
    )
    return cells.drop("here")
