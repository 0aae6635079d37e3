"""Composite operators: facets, graph and projections in one answer; recall; live answer views; federated search; scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facets import facet_counts, filter_documents
from .graph import EdgeFilter, k_hops
from .memory import live_projections


def composite(
    assigned: DataFrame,
    filters: dict[str, list[str] | str],
    count: list[str],
    relations: DataFrame,
    seeds: DataFrame,
    max_hops: int,
    sources: DataFrame,
    projections: DataFrame,
    agent: str,
    edge_filter: EdgeFilter | None = None,
) -> dict[str, DataFrame]:
    """documents, facet_counts, reachable, source_refs and projections of one request.

    ``sources`` has doc_id and source_ref; projections are the agent's live ones of the matching documents' sources. A
    filter that matches nothing gives empty parts; without filters all documents match.
    """
    docs = filter_documents(assigned, filters) if filters else assigned.select("doc_id").distinct()
    refs = sources.join(docs, "doc_id", "left_semi").where("source_ref is not null").select("source_ref").distinct()
    return {
        "documents": docs,
        "facet_counts": facet_counts(assigned.where(F.col("facet_name").isin(*count)), among=docs),
        "reachable": k_hops(relations, seeds, max_hops, edge_filter),
        "source_refs": refs,
        "projections": live_projections(projections, agent).join(refs, "source_ref", "left_semi"),
    }


def flatten(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, key, n): the parts of composite() as one table; n is a count, a depth, or null."""
    null = F.lit(None).cast("long")
    row = lambda part, df, key, n: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    rows = [
        row("documents", parts["documents"], F.col("doc_id"), null),
        row("facet_counts", parts["facet_counts"], F.concat_ws("=", "facet_name", "facet_value"), F.col("doc_count")),
        row("reachable", parts["reachable"], F.col("node"), F.col("depth")),
        row("source_refs", parts["source_refs"], F.col("source_ref"), null),
        row("projections", parts["projections"], F.col("id"), null),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def recall(schema: DataFrame, entity: DataFrame, passage: DataFrame, expansion: DataFrame) -> DataFrame:
    """(doc_id, score): a blend of four scores (doc_id, score) from 0 to 1: 0.45 passage, 0.30 entity, 0.15 expansion, 0.10
    schema; what a list lacks counts 0."""
    weights = [("schema", schema, 0.10), ("entity", entity, 0.30), ("passage", passage, 0.45), ("expansion", expansion, 0.15)]
    every = reduce(lambda a, b: a.unionByName(b), [df.groupBy("doc_id").agg((F.max("score") * w).alias("s")) for _, df, w in weights])
    return every.groupBy("doc_id").agg(F.sum("s").alias("score"))


def federated(found: dict[str, DataFrame], limit: int | None = 20) -> DataFrame:
    """(workspace_id, doc_id, score) of searches in several workspaces, best first, ties by workspace and id."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(w).alias("workspace_id"), "doc_id", "score") for w, df in found.items()])
    return every if limit is None else every.orderBy(F.desc("score"), "workspace_id", "doc_id").limit(limit)


# --- live answer views -------------------------------------------------------------------------------------------

ARTIFACT = "artifact_id string, workspace_id string, version long, status string, payload string"
EVENT = "artifact_id string, version long, event string, at long"


def refresh_views(artifacts: DataFrame, payloads: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The views with fresh payloads (artifact_id, expected_version, payload), and an event for each refresh.

    A view is refreshed only if its version is the expected one (null: any) and it isn't frozen, archived or deleted: its
    version rises by one and it is live. Others stay; a refresh that meets another version makes a 'conflict' event.
    """
    p = payloads.select("artifact_id", "expected_version", F.col("payload").alias("_new"))
    both = artifacts.join(p, "artifact_id", "left")
    asked = F.col("_new").isNotNull() & ~F.col("status").isin("frozen", "archived", "deleted")
    fits = F.col("expected_version").isNull() | (F.col("expected_version") == F.col("version"))
    both = both.withColumn("_do", asked & fits).withColumn("_clash", asked & ~fits)
    after = both.select(
        "artifact_id",
        "workspace_id",
        (F.col("version") + F.col("_do").cast("long")).alias("version"),
        F.when(F.col("_do"), "live").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_do"), F.col("_new")).otherwise(F.col("payload")).alias("payload"),
    )
    events = both.where("_do or _clash").select(
        "artifact_id", (F.col("version") + F.col("_do").cast("long")).alias("version"), F.when(F.col("_do"), "refreshed").otherwise("conflict").alias("event"), F.lit(now).cast("long").alias("at")
    )
    return after, events


def mark_stale(artifacts: DataFrame, workspaces: list[str]) -> DataFrame:
    """The views with those of changed workspaces marked stale, but for frozen, archived and deleted ones."""
    hit = F.col("workspace_id").isin(*workspaces) & ~F.col("status").isin("frozen", "archived", "deleted") if workspaces else F.lit(False)
    return artifacts.withColumn("status", F.when(hit, "stale").otherwise(F.col("status")))


# --- evaluation --------------------------------------------------------------------------------------------------


def chunk_scores(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, matched, expected, ratio): expected texts (doc_id, contains) that some chunk (doc_id, content) of the document
    has; documents without expectations don't come out. Chunks meet the expectations of their own document only."""
    e = expected.select("doc_id", "contains").distinct()
    hit = e.join(chunks.select("doc_id", "content"), "doc_id").where(F.contains("content", F.col("contains"))).select("doc_id", "contains").distinct()
    marked = e.join(hit.withColumn("_h", F.lit(1)), ["doc_id", "contains"], "left")
    return marked.groupBy("doc_id").agg(
        F.count("_h").alias("matched"), F.count("*").alias("expected"), (F.count("_h") / F.count("*")).alias("ratio")
    )


def profile_scores(expected: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, matched, ratio): how many of the fields agree (nulls agree with nulls); documents without a profile match none."""
    a = actual.select("doc_id", F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = expected.join(a, "doc_id", "left")
    same = reduce(lambda x, y: x + y, [(F.col("_there").isNotNull() & F.col(f).eqNullSafe(F.col(f"_{f}"))).cast("int") for f in fields])
    return both.select("doc_id", same.alias("matched"), (same / len(fields)).alias("ratio"))
