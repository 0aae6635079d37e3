"""Faceted filtering and counting over one long table of assignments (facet_name, facet_value, doc_id).

A posting list is the set of rows of one (facet_name, facet_value); set operations on postings are semi- and anti-joins,
and counts are partial aggregations, so no bitmap is needed and ids may be any bigint. Null values make no assignment.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import ascii_lower

# --- kinds of facets ---------------------------------------------------------------------------------------------


def plain(column: str | Column) -> Column:
    """The column's value as text."""
    return F.array((F.col(column) if isinstance(column, str) else column).cast("string"))


def array(column: str | Column) -> Column:
    """Each element of an array column."""
    c = F.col(column) if isinstance(column, str) else column
    return F.transform(c, lambda x: x.cast("string"))


def boolean(condition: Column) -> Column:
    """'true' or 'false'."""
    return F.array(condition.cast("string"))


def bucket(column: str | Column, bounds: list[float]) -> Column:
    """The number i of the bucket [bounds[i], bounds[i+1]) from 0; the last is open; below the first there is none."""
    c = F.col(column) if isinstance(column, str) else column
    number = reduce(lambda acc, i: acc.when(c >= bounds[i], str(i)), range(len(bounds) - 1, -1, -1), F)
    return F.array(number)


def datetrunc(column: str | Column, unit: str) -> Column:
    """The start of the unit ('month', 'year', ...) as an ISO date."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array(F.date_format(F.date_trunc(unit, c), "yyyy-MM-dd"))


def rating(column: str | Column) -> Column:
    """The whole number at or below the value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array(F.floor(c).cast("string"))


def assignments(rows: DataFrame, key: str, facets: dict[str, Column]) -> DataFrame:
    """(doc_id, facet_name, facet_value): the long table of the given facets, in one pass over ``rows``.

    Null keys and values are left out; an element that an array holds twice counts once.
    """
    none = F.array().cast("array<string>")

    def entries_of(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(F.array_distinct(values), none), lambda v: F.struct(F.lit(name).alias("n"), v.alias("v")))

    entries = [entries_of(name, values) for name, values in facets.items()]
    return (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).alias("doc_id"), F.explode(F.concat(*entries)).alias("e"))
        .select("doc_id", F.col("e.n").alias("facet_name"), F.col("e.v").alias("facet_value"))
        .where(F.col("facet_value").isNotNull())
    )


# --- filters -----------------------------------------------------------------------------------------------------


def filter_documents(assigned: DataFrame, filters: dict[str, list[str] | str]) -> DataFrame:
    """(doc_id) of the documents that have, for every facet in ``filters``, one of its values: OR within, AND across.

    One pass and one aggregation whatever the number of facets. No filters, or an unknown facet, give no documents.
    """
    wanted = {n: [v] if isinstance(v, str) else list(v) for n, v in filters.items()}
    if not wanted:
        return assigned.select("doc_id").limit(0)
    hit = reduce(
        lambda a, b: a | b, [(F.col("facet_name") == n) & F.col("facet_value").isin(*v) if v else F.lit(False) for n, v in wanted.items()]
    )
    per = assigned.where(hit).groupBy("doc_id").agg(F.count_distinct("facet_name").alias("n"))
    return per.where(F.col("n") == len(wanted)).select("doc_id")


def filter_documents_json(assigned: DataFrame, filters: str) -> DataFrame:
    """filter_documents() with a JSON object {facet: value or [values]}; other JSON raises ValueError."""
    parsed = json.loads(filters)
    if not isinstance(parsed, dict):
        raise ValueError("filters must be a JSON object")
    return filter_documents(assigned, {k: [str(x) for x in v] if isinstance(v, list) else str(v) for k, v in parsed.items()})


# --- counts ------------------------------------------------------------------------------------------------------


def facet_counts(assigned: DataFrame, facet: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """(facet_name, facet_value, doc_count) of each value, for all documents or those in ``among``; zeros are left out."""
    rows = assigned if facet is None else assigned.where(F.col("facet_name") == facet)
    if among is not None:
        rows = rows.join(among.select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("facet_name", "facet_value").agg(F.count_distinct("doc_id").alias("doc_count"))


def top_values(assigned: DataFrame, n: int = 5, among: DataFrame | None = None) -> DataFrame:
    """(facet_name, facet_value, doc_count, rank): the ``n`` commonest values of each facet, ties by value."""
    order = Window.partitionBy("facet_name").orderBy(F.desc("doc_count"), "facet_value")
    ranked = facet_counts(assigned, among=among).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


def hierarchical_counts(assigned: DataFrame, parents: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(facet_name, parent_value, facet_value, doc_count): counts of the children of each value of a hierarchy.

    ``parents`` has facet_name, facet_value and parent_value (null for a root).
    """
    return facet_counts(assigned, among=among).join(parents, ["facet_name", "facet_value"]).select(
        "facet_name", "parent_value", "facet_value", "doc_count"
    )


def children_of(parents: DataFrame, facet: str, value: str) -> DataFrame:
    """(facet_value) of the direct children of a facet value."""
    return parents.where((F.col("facet_name") == facet) & (F.col("parent_value") == value)).select("facet_value").distinct()


def describe(assigned: DataFrame) -> DataFrame:
    """(facet_name, n_values, n_documents, n_postings): the facets of the table."""
    return assigned.groupBy("facet_name").agg(
        F.count_distinct("facet_value").alias("n_values"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.count("*").alias("n_postings"),
    )


def search_values(assigned: DataFrame, namespace: str | None = None, dimension: str | None = None, value: str | None = None, limit: int | None = 50) -> DataFrame:
    """(doc_id, facet_name, facet_value): the documents with a facet value that contains ``value``, in any ASCII case.

    Facet names are 'namespace.dimension'; what isn't given isn't asked. Each document comes once, with its least value that fits, by facet
    name, value and document.
    """
    rows = assigned
    if namespace is not None and dimension is not None:
        rows = rows.where(F.col("facet_name") == f"{namespace}.{dimension}")
    elif namespace is not None:
        rows = rows.where(F.startswith("facet_name", F.lit(f"{namespace}.")))
    elif dimension is not None:
        rows = rows.where(F.endswith("facet_name", F.lit(f".{dimension}")))
    if value:
        rows = rows.where(F.contains(ascii_lower(F.col("facet_value")), ascii_lower(F.lit(value))))
    first = rows.groupBy("doc_id").agg(F.min(F.struct("facet_name", "facet_value")).alias("f")).select("doc_id", "f.*")
    return first if limit is None else first.orderBy("facet_name", "facet_value", "doc_id").limit(limit)


# --- changes -----------------------------------------------------------------------------------------------------


def apply_deltas(assigned: DataFrame, deltas: DataFrame) -> DataFrame:
    """``assigned`` after a log of changes (doc_id, facet_name, facet_value, delta, seq): +1 adds, -1 removes a posting.

    Of the changes of one posting the last by seq holds; removing what isn't there and adding what is change nothing.
    A change with another delta, or a null in its key, makes the whole merge fail, so nothing is half applied.
    """
    key = ["doc_id", "facet_name", "facet_value"]
    valid = F.col("delta").isin(1, -1) & F.col("doc_id").isNotNull() & F.col("facet_name").isNotNull() & F.col("facet_value").isNotNull()
    checked = deltas.withColumn("delta", F.when(valid, F.col("delta")).otherwise(F.raise_error(F.lit("bad facet delta"))))
    last = checked.groupBy(*key).agg(F.max_by("delta", "seq").alias("delta"))
    kept = assigned.select(*key).distinct().join(last.where("delta = -1"), key, "left_anti")
    return kept.union(last.where("delta = 1").select(*key)).distinct()


def drop_facets(assigned: DataFrame, names: list[str]) -> DataFrame:
    """``assigned`` without the given facets."""
    return assigned.where(~F.col("facet_name").isin(*names)) if names else assigned


def bitmaps(assigned: DataFrame) -> DataFrame:
    """(facet_name, facet_value, bucket, bitmap, cardinality): the postings as Spark bitmaps, one per bucket of ids.

    An optional cache for stores that want compact postings; ids must be at least 0.
    """
    rows = assigned.where(F.col("doc_id") >= 0).groupBy("facet_name", "facet_value", F.bitmap_bucket_number("doc_id").alias("bucket"))
    made = rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bitmap"))
    return made.withColumn("cardinality", F.bitmap_count("bitmap"))
