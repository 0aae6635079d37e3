"""References to records that do not exist (problem 7): direct orphans per reference, inherited ones by a fixpoint."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_name
from ..runtime import materialize

FIELDS = ("source_table_id", "target_table_id", "to_table")


def valid_relations(relations: DataFrame) -> DataFrame:
    """One row per relation_semantic_id: the latest ingested_at (then updated_at) is valid; null ids are left out."""
    cols = ["relation_semantic_id", "workspace_id", "from_schema", "from_table", "to_schema", "to_table"]
    cols += ["source_table_id", "target_table_id", "updated_at", "ingested_at"]
    last = Window.partitionBy("relation_semantic_id").orderBy(
        F.desc("ingested_at"), F.desc("updated_at"), "to_table", "source_table_id", "target_table_id"
    )
    rows = relations.where(F.col("relation_semantic_id").isNotNull()).select(*cols)
    return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank")


def references(relations: DataFrame) -> DataFrame:
    """(relation_semantic_id, workspace_id, ref_field, updated_at, ref_id, ref_schema, ref_name): each set reference.

    A null id is no reference, nor is a to_table that is null or blank.
    """
    none = F.lit(None)
    ref = lambda field, i, s, n: F.struct(
        F.lit(field).alias("ref_field"),
        i.cast("long").alias("ref_id"),
        s.cast("string").alias("ref_schema"),
        n.cast("string").alias("ref_name"),
    )
    refs = F.array(
        ref("source_table_id", F.col("source_table_id"), none, none),
        ref("target_table_id", F.col("target_table_id"), none, none),
        ref("to_table", none, fold_name(F.coalesce("to_schema", F.lit(""))), fold_name(F.col("to_table"))),
    )
    out = relations.select("relation_semantic_id", "workspace_id", "updated_at", F.explode(refs).alias("r"))
    out = out.select("relation_semantic_id", "workspace_id", "updated_at", "r.*")
    return out.where(F.col("ref_id").isNotNull() | (F.col("ref_name") != ""))


def known_tables(tables: DataFrame) -> DataFrame:
    """(table_id, workspace_id, schema, name, spans): each table with its spans of life (registered_at, deleted_at).

    Repeated rows count once. A table registered more than once has several spans; a null registered_at is from
    always, a null deleted_at for ever.
    """
    return tables.groupBy(
        "table_id",
        "workspace_id",
        fold_name(F.coalesce("table_schema", F.lit(""))).alias("schema"),
        fold_name(F.coalesce("table_name", F.lit(""))).alias("name"),
    ).agg(F.collect_set(F.struct("registered_at", "deleted_at")).alias("spans"))


def judged_references(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """references() with kind ('missing', 'late', 'deleted', null for sound ones) and the table_id found (or null).

    A reference is sound if some span of a table it names, in its relation's workspace_id, holds its updated_at; else
    'deleted' if a span ended at or before it, else 'late' if one only begins after it; 'missing' without such a
    table. A null updated_at is within any span. Two equi-joins, by id and by name, with the catalogue reduced to one
    row per key: a table that a third of all relations refer to is split by adaptive skew handling.
    """
    known = known_tables(tables)
    by_id = known.where(F.col("table_id").isNotNull()).groupBy("workspace_id", F.col("table_id").alias("ref_id"))
    by_name = known.groupBy("workspace_id", F.col("schema").alias("ref_schema"), F.col("name").alias("ref_name"))
    spans = F.flatten(F.collect_list("spans")).alias("spans")
    by_id = by_id.agg(spans, F.first("table_id").alias("found"))
    by_name = by_name.agg(spans, F.min("table_id").alias("found"))
    refs = references(valid_relations(relations))
    named = refs.where(F.col("ref_field") == "to_table").join(by_name, ["workspace_id", "ref_schema", "ref_name"], "left")
    ided = refs.where(F.col("ref_field") != "to_table").join(by_id, ["workspace_id", "ref_id"], "left")
    both = ided.unionByName(named)
    t = F.col("updated_at")
    begun = lambda s: F.coalesce(s["registered_at"] <= t, F.lit(True))
    ended = lambda s: F.coalesce(s["deleted_at"] <= t, F.lit(False))
    kind = (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.exists("spans", lambda s: begun(s) & ~ended(s)), None)
        .when(F.exists("spans", ended), "deleted")
        .otherwise("late")
    )
    return both.withColumn("kind", kind)


def orphan_references(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """(relation_semantic_id, ref_field, kind) of the references that find no table at their time.

    The direct orphans of orphan_cascade(). Empty relations give no rows; with an empty catalogue every reference
    is 'missing'.
    """
    return judged_references(relations, tables).where(F.col("kind").isNotNull()).select("relation_semantic_id", "ref_field", "kind")


def orphan_cascade(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """(relation_semantic_id, ref_field, kind, level, period): direct orphans (level 0) and inherited ones (level >= 1).

    A record with an orphan reference is orphaned, and so is the table it stands in, its source table. References to an
    orphaned table are inherited orphans (kind 'inherited') one level further, and so on down the references until
    a round finds no new one, however deep they go. The rounds run on the distinct (table referred to, table it stands in) pairs: each is a
    semi-join of the pairs with the tables orphaned in the round before, and an anti-join removes tables seen, so
    cycles end. The tables seen are written together every few rounds, which bounds the plan. One join at the end gives each reference its table's level. period is the month of updated_at.
    """
    refs = materialize(judged_references(relations, tables).withColumn("period", F.date_trunc("month", "updated_at")), "refs")
    source = refs.where("ref_field = 'source_table_id' and found is not null").select("relation_semantic_id", F.col("found").alias("in_table"))
    out = ["relation_semantic_id", "ref_field", "kind", "level", "period"]
    direct = refs.where("kind is not null").withColumn("level", F.lit(0)).select(*out)
    sound = refs.where("kind is null and ref_field != 'source_table_id' and found is not null")
    pairs = materialize(sound.join(source, "relation_semantic_id").select(F.col("found").alias("t"), "in_table").distinct(), "pairs")
    fresh = direct.join(source, "relation_semantic_id").select(F.col("in_table").alias("t")).distinct()
    levels = None
    for level in count(1):
        fresh = materialize(fresh.select("t", F.lit(level).alias("level")), "fresh")
        if fresh.isEmpty():
            break
        levels = fresh if levels is None else levels.unionByName(fresh)
        if level % 16 == 0:
            levels = materialize(levels.coalesce(levels.sparkSession.sparkContext.defaultParallelism), "levels")
        reached = pairs.join(fresh.select("t"), "t", "left_semi").select(F.col("in_table").alias("t")).distinct()
        fresh = reached.join(levels.select("t"), "t", "left_anti")
    if levels is None:
        return direct
    inherited = sound.join(levels, F.col("found") == F.col("t")).select("relation_semantic_id", "ref_field", F.lit("inherited").alias("kind"), "level", "period")
    return direct.unionByName(inherited)


def orphan_report(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """(ref_field, period, kind, level, orphans): orphan_cascade() counted per referring field and month."""
    return orphan_cascade(relations, tables).groupBy("ref_field", "period", "kind", "level").agg(F.count("*").alias("orphans"))
