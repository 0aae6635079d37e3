"""Ontologies as triples: projection to classes, properties and relations; taxonomies; comparison of workspaces.

Triples: ontology_id, subject_kind, subject, predicate, object_kind, object_value (kinds: iri, blank, literal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The terms of RDF, RDFS and OWL that the projection knows.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
CLASSES = ("http://www.w3.org/2002/07/owl#Class", "http://www.w3.org/2000/01/rdf-schema#Class")
OBJECT_PROPERTY = "http://www.w3.org/2002/07/owl#ObjectProperty"
DATATYPE_PROPERTY = "http://www.w3.org/2002/07/owl#DatatypeProperty"
ONTOLOGY = "http://www.w3.org/2002/07/owl#Ontology"


def local_name(iri: Column) -> Column:
    """What follows the last '#' or '/' of an IRI, or all of it where nothing does."""
    name = F.regexp_extract(iri, r"([^#/]+)[#/]*$", 1)
    return F.when(name == "", iri).otherwise(name)


def stable_id(*parts: Column) -> Column:
    """A positive id from a hash of the parts."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def project_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, iri, node_type) and relations (relation_id, edge_type, source_id, target_id) of the triples.

    A subject typed as class or property is a node of that kind, one typed otherwise of the local name of its type; each
    other triple whose object is no literal is a relation, and its ends are nodes ('owl_resource' unless typed). Repeated
    triples count once; the ontology's own typing makes nothing.
    """
    t = triples.select("subject_kind", "subject", "predicate", "object_kind", "object_value").distinct()
    typing = (F.col("predicate") == RDF_TYPE) & (F.col("subject_kind") == "iri") & (F.col("object_kind") == "iri")
    kind = (
        F.when(F.col("object_value").isin(*CLASSES), "owl_class")
        .when(F.col("object_value") == OBJECT_PROPERTY, "owl_object_property")
        .when(F.col("object_value") == DATATYPE_PROPERTY, "owl_datatype_property")
        .when(F.col("object_value") != ONTOLOGY, local_name(F.col("object_value")))
    )
    typed = t.where(typing).select(F.col("subject").alias("iri"), kind.alias("node_type"), F.lit(0).alias("rank")).where("node_type is not null")
    links = t.where(~typing & (F.col("object_kind") != "literal"))
    resource = lambda c, k: F.struct(F.col(c).alias("iri"), F.when(F.col(k) == "blank", "blank_node").otherwise("owl_resource").alias("node_type"))
    ends = links.select(F.explode(F.array(resource("subject", "subject_kind"), resource("object_value", "object_kind"))).alias("x")).select("x.*", F.lit(1).alias("rank"))
    nodes = typed.unionByName(ends).groupBy("iri").agg(F.min(F.struct("rank", "node_type"))["node_type"].alias("node_type"))
    relations = links.select(
        stable_id(F.lit("relation"), F.col("subject"), F.col("predicate"), F.col("object_value")).alias("relation_id"),
        local_name(F.col("predicate")).alias("edge_type"),
        stable_id(F.lit("entity"), F.col("subject")).alias("source_id"),
        stable_id(F.lit("entity"), F.col("object_value")).alias("target_id"),
    )
    return nodes.select(stable_id(F.lit("entity"), F.col("iri")).alias("node_id"), "iri", "node_type"), relations


def taxonomy_facets(nodes: DataFrame) -> DataFrame:
    """(doc_id, facet_name, facet_value): each level of a taxonomy node's path as a facet 'level_<n>'.

    ``nodes`` has doc_id and levels (array of names from the root); null levels are left out.
    """
    rows = nodes.select("doc_id", F.posexplode("levels").alias("n", "facet_value")).where("facet_value is not null")
    return rows.select("doc_id", F.concat(F.lit("level_"), F.col("n").cast("string")).alias("facet_name"), "facet_value")


def taxonomy_projections(facts: DataFrame, agent: str, schema_id: str) -> DataFrame:
    """A FACT projection of weight 0.8 for each fact of the taxonomy's schema."""
    rows = facts.where(F.col("schema_id") == schema_id)
    return rows.select(
        F.concat(F.lit("tax_"), F.col("id")).alias("id"), F.lit(agent).alias("agent_id"), F.col("workspace_id").alias("scope"), F.lit("FACT").alias("proj_type"),
        "content", F.lit(0.8).alias("weight"), "source_ref", F.lit("taxonomy").alias("source_type"), F.lit("active").alias("status"),
    )


def compare_workspaces(types: DataFrame, a: str, b: str) -> DataFrame:
    """(type_name, side): 'shared', 'only_a' or 'only_b' for each type of two workspaces (workspace_id, type_name)."""
    has = types.where(F.col("workspace_id").isin(a, b)).groupBy("type_name").agg(F.array_sort(F.collect_set("workspace_id")).alias("w"))
    side = F.when(F.size("w") == 2, "shared").when(F.col("w")[0] == a, "only_a").otherwise("only_b")
    return has.select("type_name", (F.lit("shared") if a == b else side).alias("side"))


def entity_bridges(entities: DataFrame, a: str, b: str, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity): entities of two workspaces of one type whose names are alike.

    similarity = 1 - edit distance / greater length, ASCII letters in any case; null and empty names are like none.
    No pair is lost: a name of length n takes at most d edits to any name within the threshold, so of its d + 1 pieces
    one stays whole and stands in the other name, shifted by no more than the edits allow. Distinct names meet in an
    equi-join on such pieces, at a threshold of 0.5 or less (where pieces could be empty) on the type alone.
    """
    name = F.translate(F.col("name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pick = lambda w, s: entities.where((F.col("workspace_id") == w) & (F.length("name") > 0)).select("entity_type", F.col("entity_id").alias(f"id_{s}"), name.alias(f"n_{s}"))
    ids_a, ids_b = pick(a, "a"), pick(b, "b")
    names_a, names_b = ids_a.select("entity_type", "n_a").distinct(), ids_b.select("entity_type", "n_b").distinct()
    slack = 1e-9  # 0.2 * 5 is 1, also where the product is a little less
    whole = lambda x: F.floor(x + slack).cast("int")
    edits = lambda n: whole((1 - threshold) * n)
    longest, shift = F.greatest(F.length("n_a"), F.length("n_b")), F.lit(0)
    if threshold > 0.5:
        pieces = lambda n: edits(whole(n / threshold)) + 1
        n = F.length("n_a")
        cut = lambda i: F.floor(i * n / pieces(n)).cast("int")
        piece = lambda i: F.struct(cut(i).alias("at"), F.substring("n_a", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"))
        names_a = names_a.select("entity_type", "n_a", F.inline(F.transform(F.sequence(F.lit(0), pieces(n) - 1), piece)).alias("at_a", "piece"))
        n = F.length("n_b")
        sizes = F.transform(F.sequence(F.ceil(n * threshold - slack).cast("int"), whole(n / threshold)), lambda m: m / pieces(m))
        sizes = F.sequence(F.floor(F.array_min(sizes)).cast("int"), F.least(F.ceil(F.array_max(sizes)).cast("int"), n))
        names_b = names_b.select("entity_type", "n_b", F.explode(sizes).alias("size"))
        part = lambda i: F.struct(i.alias("at"), F.substring("n_b", i + 1, F.col("size")).alias("piece"))
        names_b = names_b.select("entity_type", "n_b", F.inline(F.transform(F.sequence(F.lit(0), n - F.col("size")), part)).alias("at_b", "piece"))
        shift = F.col("at_b") - F.col("at_a")
    both = names_a.join(names_b, ["entity_type", "piece"] if threshold > 0.5 else "entity_type")
    longer = F.length("n_b") - F.length("n_a")
    both = both.where(F.abs(shift) + F.abs(longer - shift) <= edits(longest)).select("entity_type", "n_a", "n_b").distinct()
    score = 1 - F.levenshtein("n_a", "n_b") / longest
    alike = both.withColumn("similarity", score).where(F.col("similarity") >= threshold)
    return alike.join(ids_a, ["entity_type", "n_a"]).join(ids_b, ["entity_type", "n_b"]).select("id_a", "id_b", "similarity")


def ontology_graph(entity_types: DataFrame, edge_types: DataFrame, ontology: str) -> tuple[DataFrame, DataFrame]:
    """An ontology as nodes (id, label) and edges (id, source, target) by its declared types; edges without an end are left out."""
    nodes = entity_types.where(F.col("ontology_id") == ontology).select(F.col("entity_type").alias("id"), F.coalesce("label", "entity_type").alias("label"))
    edges = edge_types.where((F.col("ontology_id") == ontology) & F.col("source_entity_type").isNotNull() & F.col("target_entity_type").isNotNull())
    return nodes.orderBy("id"), edges.select(F.col("edge_type").alias("id"), F.col("source_entity_type").alias("source"), F.col("target_entity_type").alias("target")).orderBy("id")


def inspect_ontology(entity_types: DataFrame, edge_types: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(ontology_id, kind, type_name, n): each declared type ('entity' or 'edge') with the number of rows that use it, zeros too."""
    used = lambda rows, c: rows.groupBy("ontology_id", F.col(c).alias("type_name")).agg(F.count("*").alias("n"))
    part = lambda types, rows, c, kind: types.select("ontology_id", F.col(c).alias("type_name")).distinct().join(used(rows, c), ["ontology_id", "type_name"], "left").select(
        "ontology_id", F.lit(kind).alias("kind"), "type_name", F.coalesce("n", F.lit(0)).alias("n")
    )
    return part(entity_types, entities, "entity_type", "entity").unionByName(part(edge_types, relations, "edge_type", "edge"))


def coverage_by_types(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """(workspace_id, entity_type, n, declared): how many entities each type has and whether it is declared."""
    counts = entities.groupBy("workspace_id", "entity_type").agg(F.count("*").alias("n"))
    known = declared.select("workspace_id", F.col("type_name").alias("entity_type"), F.lit(True).alias("d")).distinct()
    out = counts.join(known, ["workspace_id", "entity_type"], "full")
    return out.select("workspace_id", "entity_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(False)).alias("declared"))
