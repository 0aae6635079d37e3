"""Queries on ingest: upserts, imports, audits, the queue, the catalogue as an ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as ing
from ..operators import ontology as on
from ..runtime import materialize
from ..runtime import table as t
from .facets import valid_facts
from .registry import query


def _facts(spark, d):
    rows = t(spark, d, "agent_facts")
    return rows.select("workspace_id", "source_ref", "schema_id", "content", "facets_json", F.struct("version", "updated_at", "id").alias("seq"))


@query("""WITH l AS (SELECT workspace_id, source_ref, schema_id, content, facets_json FROM agent_facts WHERE workspace_id IS NOT NULL AND source_ref IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY workspace_id, source_ref ORDER BY version DESC, updated_at DESC, id DESC, schema_id DESC, content DESC, facets_json DESC) = 1)
SELECT 'facet_' || substr(sha256(workspace_id || ':' || source_ref), 1, 32) AS id, workspace_id, source_ref, schema_id, content, facets_json FROM l""")
def import_facts(spark, d):
    """The facts as an import, one per source of a workspace, with stable ids."""
    return ing.import_facts(_facts(spark, d))


@query("""WITH v AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
e AS (SELECT DISTINCT workspace_id, json_extract_string(facets_json, '$.node_id') AS source, 'mentions' AS label, source_ref AS target FROM v
  UNION SELECT DISTINCT workspace_id, json_extract_string(facets_json, '$.criticality'), 'ranks', source_ref FROM v)
SELECT workspace_id, concat_ws('|', source, label, target) AS external_id, source, label, target, 0.85 AS confidence FROM e WHERE source <> ''""")
def import_edges(spark, d):
    """Edges that follow from the facets of the facts."""
    return ing.derive_edges(valid_facts(spark, d), [("node_id", "mentions"), ("criticality", "ranks")])


@query("""WITH l AS (SELECT workspace_id, lower(trim(to_table)) AS name, updated_at, relation_semantic_id AS id, relation_kind FROM relation_semantics WHERE to_table IS NOT NULL),
o AS (SELECT DISTINCT workspace_id, lower(trim(table_name)) AS name, table_id FROM table_semantics)
SELECT coalesce(o.workspace_id, c.workspace_id) AS workspace_id, coalesce(o.name, c.name) AS name, least(coalesce(o.table_id, c.id), coalesce(c.id, o.table_id)) AS entity_id
FROM o FULL JOIN (SELECT workspace_id, name, min(id) AS id FROM l GROUP BY ALL) c ON c.workspace_id = o.workspace_id AND c.name = o.name""")
def ingest_upsert_entities(spark, d):
    """Tables as entities by natural key, merged with the tables that relations name."""
    name = lambda c: F.lower(F.trim(c)).alias("name")
    null = F.lit(None)
    base = t(spark, d, "table_semantics").select(
        "workspace_id", F.lit("table").alias("entity_type"), name("table_name"), F.col("table_id").alias("entity_id"), F.lit(0.9).alias("confidence"), F.lit("{}").alias("metadata_json"), null.cast("long").alias("deprecated_at")
    ).distinct()
    named = t(spark, d, "relation_semantics").where("to_table is not null").select(
        "workspace_id", F.lit("table").alias("entity_type"), name("to_table"), F.col("relation_semantic_id").alias("entity_id"), F.lit(0.5).alias("confidence"), F.lit("").alias("metadata_json"), F.unix_timestamp("updated_at").alias("seq")
    )
    return ing.upsert_entities(base, named).select("workspace_id", "name", "entity_id")


@query("""SELECT doc_id, updated_at, language FROM documents_raw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, loaded_at DESC) = 1""")
def ingest_latest_documents(spark, d):
    """The valid row of each raw document."""
    return ing.latest(t(spark, d, "documents_raw"), "doc_id", "updated_at", "loaded_at").select("doc_id", "updated_at", "language")


@query(r"""WITH v AS (SELECT doc_id, content FROM documents_raw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, loaded_at DESC) = 1),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9A-Za-z]|[^\x00-\x7F])+')) AS term FROM v) GROUP BY ALL)
SELECT term, count(*) AS ndoc, CAST(sum(tf) AS BIGINT) AS nentry FROM p GROUP BY term""")
def ingest_rebuild_index(spark, d):
    """Term statistics rebuilt from the raw layer."""
    _, _, index = ing.rebuild(t(spark, d, "documents_raw"))
    return index.terms


@query("""WITH f AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
e AS (SELECT DISTINCT workspace_id, source_ref FROM documents_raw)
SELECT f.workspace_id, count(*) AS facts, CAST(count(*) FILTER (e.source_ref IS NULL) AS BIGINT) AS orphans, round(avg(CASE WHEN e.source_ref IS NULL THEN 1.0 ELSE 0.0 END), 6) AS orphan_ratio
FROM f LEFT JOIN e ON e.workspace_id = f.workspace_id AND e.source_ref = f.source_ref GROUP BY 1""")
def ingest_orphans(spark, d):
    """Facts whose source is no document."""
    docs = t(spark, d, "documents_raw").select("workspace_id", F.col("source_ref").alias("external_id"))
    return ing.audit_orphans(valid_facts(spark, d), docs).withColumn("orphan_ratio", F.round("orphan_ratio", 6))


@query("""SELECT * FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source']) AS column_name, count(*) AS n_rows,
unnest([count(*) FILTER (trim(CAST(doc_id AS VARCHAR)) <> ''), count(*) FILTER (trim(text, ' ') <> ''), count(*) FILTER (trim(lang) <> ''), count(*) FILTER (trim(source) <> '')]) AS n_filled FROM documents)""")
def ingest_profile(spark, d):
    return ing.profile(t(spark, d, "documents").select("doc_id", "text", "lang", "source")).drop("n_distinct")


@query("""SELECT 'relation_semantics' AS "table", 'missing_column' AS problem, 'owner' AS detail, 1 AS n
UNION ALL SELECT * FROM (SELECT 'relation_semantics', 'null_in_required', unnest(['relation_semantic_id', 'source_table_id', 'to_table']),
  unnest([count(*) FILTER (relation_semantic_id IS NULL), count(*) FILTER (source_table_id IS NULL), count(*) FILTER (to_table IS NULL)]) AS n FROM relation_semantics) WHERE n > 0
UNION ALL SELECT * FROM (SELECT 'column_semantics', 'null_in_required', unnest(['table_id', 'column_name']),
  unnest([count(*) FILTER (table_id IS NULL), count(*) FILTER (column_name IS NULL)]) AS n FROM column_semantics) WHERE n > 0
UNION ALL SELECT 'relation_semantics', 'unknown_reference', 'target_table_id -> table_semantics.table_id', count(*) FROM relation_semantics
  WHERE target_table_id IS NOT NULL AND target_table_id NOT IN (SELECT table_id FROM table_semantics) HAVING count(*) > 0
UNION ALL SELECT 'column_semantics', 'unknown_reference', 'table_id -> table_semantics.table_id', count(*) FROM column_semantics
  WHERE table_id NOT IN (SELECT table_id FROM table_semantics) HAVING count(*) > 0""")
def ingest_validate(spark, d):
    """Required columns and references of the catalogue."""
    tables = {n: t(spark, d, n) for n in ("table_semantics", "relation_semantics", "column_semantics")}
    required = {"relation_semantics": ["relation_semantic_id", "source_table_id", "to_table", "owner"], "column_semantics": ["table_id", "column_name"]}
    return ing.validate_bundle(tables, required, [("relation_semantics", "target_table_id", "table_semantics", "table_id"), ("column_semantics", "table_id", "table_semantics", "table_id")])


@query("""SELECT DISTINCT workspace_id, 'tables' AS section, table_id AS item_id, table_name AS label FROM table_semantics
UNION ALL SELECT DISTINCT workspace_id, 'columns', column_semantic_id, column_name FROM (SELECT DISTINCT workspace_id, table_id, column_semantic_id, column_name, data_type FROM column_semantics)
UNION ALL SELECT DISTINCT workspace_id, 'relations', relation_semantic_id, to_table FROM relation_semantics""")
def ingest_workspace_model(spark, d):
    """The items of each workspace's model, by their ids and names."""
    model = ing.workspace_model(t(spark, d, "table_semantics"), t(spark, d, "column_semantics"), t(spark, d, "relation_semantics"))
    of = lambda *names: F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])
    key = F.when(F.col("section") == "columns", of("column_semantic_id")).otherwise(of("relation_semantic_id", "table_id"))
    label = F.when(F.col("section") == "columns", of("column_name")).when(F.col("section") == "tables", of("table_name")).otherwise(of("to_table"))
    return model.select("workspace_id", "section", key.cast("long").alias("item_id"), label.alias("label")).distinct()


@query("""WITH c AS (SELECT table_schema, table_name, column_semantic_id AS o, arg_max(column_name, updated_at) AS n, arg_max(data_type, updated_at) AS k FROM column_semantics GROUP BY ALL)
SELECT table_schema, table_name, 'CREATE TABLE `' || table_schema || '`.`' || table_name || '` (' || string_agg('`' || n || '` ' || k, ', ' ORDER BY o) || ')' AS ddl FROM c GROUP BY table_schema, table_name""")
def ingest_ddl(spark, d):
    """A CREATE TABLE for each table of the catalogue."""
    cols = t(spark, d, "column_semantics").groupBy("table_schema", "table_name", F.col("column_semantic_id").alias("ordinal")).agg(F.max_by("column_name", "updated_at").alias("column_name"), F.max_by("data_type", "updated_at").alias("data_type"))
    return ing.propose_ddl(cols)


_QUEUE = """q AS (SELECT event_id AS msg_id, event_type AS queue_name, CASE WHEN value > 150 THEN CAST(epoch(ts) AS BIGINT) + 3600 END AS vt_until_unix, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS archived FROM events),
k AS (SELECT max(CAST(epoch(ts) AS BIGINT)) AS now FROM events), name AS (SELECT min(event_type) AS n FROM events)"""


@query(f"""WITH {_QUEUE} SELECT msg_id FROM q, k, name WHERE queue_name = n AND archived = 0 AND (vt_until_unix IS NULL OR vt_until_unix <= now) ORDER BY msg_id LIMIT 25""")
def queue_read(spark, d):
    """The first 25 visible messages of a queue (a read of a batch)."""
    events = t(spark, d, "events")
    head = events.agg(F.max(F.unix_timestamp("ts")).alias("now"), F.min("event_type").alias("n")).first()
    at = F.unix_timestamp("ts")
    messages = events.select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("queue_name"), F.lit(0).alias("read_ct"), at.alias("enqueued_at_unix"),
        F.when(F.col("value") > 150, at + 3600).alias("vt_until_unix"), F.when(F.col("user_id") % 10 == 0, 1).otherwise(0).alias("archived"), F.lit(0).alias("deleted"), F.col("props").alias("message"),
    )
    got, _ = ing.read_queue(messages, head["n"], head["now"], 60, 25)
    return got.select("msg_id")


def _triples(spark, d):
    """The catalogue as triples: tables are classes, columns datatype properties, relations object properties and links."""
    iri = lambda kind, c: F.concat(F.lit(f"http://example.org/{kind}#"), F.col(c).cast("string"))
    row = lambda df, s, p, o: df.select(F.lit("iri").alias("subject_kind"), s.alias("subject"), F.lit(p).alias("predicate"), F.lit("iri").alias("object_kind"), o.alias("object_value"))
    tables, cols, rel = t(spark, d, "table_semantics"), t(spark, d, "column_semantics"), t(spark, d, "relation_semantics")
    both = rel.where("source_table_id is not null and target_table_id is not null")
    return (
        row(tables, iri("table", "table_id"), on.RDF_TYPE, F.lit(on.CLASSES[0]))
        .unionByName(row(cols, iri("column", "column_semantic_id"), on.RDF_TYPE, F.lit(on.DATATYPE_PROPERTY)))
        .unionByName(row(both, iri("table", "source_table_id"), "http://example.org/terms/refersTo", iri("table", "target_table_id")))
    )


_RDF = """tri AS (
  SELECT 'http://example.org/table#' || table_id AS iri, 'owl_class' AS node_type, 0 AS r FROM table_semantics
  UNION SELECT 'http://example.org/column#' || column_semantic_id, 'owl_datatype_property', 0 FROM column_semantics
  UNION SELECT 'http://example.org/table#' || source_table_id, 'owl_resource', 1 FROM relation_semantics WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL
  UNION SELECT 'http://example.org/table#' || target_table_id, 'owl_resource', 1 FROM relation_semantics WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL)"""


@query(f"WITH {_RDF} SELECT iri, arg_min(node_type, r) AS node_type FROM tri GROUP BY iri")
def ontology_nodes(spark, d):
    """Nodes of the catalogue's triples."""
    return on.project_triples(_triples(spark, d))[0].select("iri", "node_type")


@query("""SELECT 'refersTo' AS edge_type, count(*) AS n FROM (SELECT DISTINCT source_table_id, target_table_id FROM relation_semantics WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL)""")
def ontology_relations(spark, d):
    return on.project_triples(_triples(spark, d))[1].groupBy("edge_type").agg(F.count_distinct("relation_id").alias("n"))


_KINDS = "k AS (SELECT DISTINCT workspace_id, lower(trim(column_name)) AS type_name FROM column_semantics)"


@query(f"""WITH {_KINDS}, w AS (SELECT min(workspace_id) AS a, max(workspace_id) AS b FROM k)
SELECT type_name, CASE WHEN count(DISTINCT workspace_id) = 2 THEN 'shared' WHEN min(workspace_id) = min(a) THEN 'only_a' ELSE 'only_b' END AS side FROM k, w WHERE workspace_id IN (a, b) GROUP BY type_name""")
def ontology_compare(spark, d):
    """The column names of two workspaces."""
    kinds = t(spark, d, "column_semantics").select("workspace_id", F.lower(F.trim("column_name")).alias("type_name")).distinct()
    a, b = kinds.agg(F.min("workspace_id"), F.max("workspace_id")).first()
    return on.compare_workspaces(kinds, a, b)


@query(f"""WITH {_KINDS}, w AS (SELECT min(workspace_id) AS a, max(workspace_id) AS b FROM k), p AS (
  SELECT x.type_name AS id_a, y.type_name AS id_b, 1 - levenshtein(x.type_name, y.type_name) / greatest(length(x.type_name), length(y.type_name)) AS s
  FROM w JOIN k x ON x.workspace_id = a JOIN k y ON y.workspace_id = b WHERE x.type_name <> '' AND y.type_name <> '')
SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.8""")
def ontology_bridges(spark, d):
    """Column names that are alike in two workspaces."""
    kinds = t(spark, d, "column_semantics").select("workspace_id", F.lower(F.trim("column_name")).alias("name")).distinct()
    a, b = kinds.agg(F.min("workspace_id"), F.max("workspace_id")).first()
    ents = kinds.select("workspace_id", F.lit("column").alias("entity_type"), F.col("name").alias("entity_id"), "name")
    return on.entity_bridges(ents, a, b, 0.8).withColumn("similarity", F.round("similarity", 6))


@query("""WITH v AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
l AS (SELECT doc_id, string_split(schema_id, ':') AS p FROM v)
SELECT doc_id, 'level_0' AS facet_name, p[1] AS facet_value FROM l WHERE p[1] IS NOT NULL UNION ALL SELECT doc_id, 'level_1', p[2] FROM l WHERE p[2] IS NOT NULL""")
def ontology_taxonomy_facets(spark, d):
    """The levels of each fact's schema as facets."""
    return on.taxonomy_facets(valid_facts(spark, d).select("doc_id", F.split("schema_id", ":").alias("levels")))


@query("""WITH v AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1)
SELECT 'tax_' || id AS id, workspace_id AS scope, content, 0.8 AS weight FROM v WHERE schema_id = 'tech:term'""")
def ontology_taxonomy_projections(spark, d):
    return on.taxonomy_projections(valid_facts(spark, d), "agent_a", "tech:term").select("id", "scope", "content", "weight")


@query("""WITH v AS (SELECT doc_id FROM documents_raw WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM v WHERE doc_id % 2 = 0 GROUP BY 1""")
def ingest_delivery(spark, d):
    """A delivery of every second document in one step: some are new, some changed, some older than what is there."""
    valid = materialize(ing.latest(t(spark, d, "documents_raw"), "doc_id", "updated_at", "loaded_at"), "valid")
    given = valid.where("doc_id % 2 = 0").withColumns({
        "content": F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" more"))).otherwise(F.col("content")),
        "updated_at": F.col("updated_at") - F.when(F.col("doc_id") % 7 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day")),
    })
    step = ing.ingest_documents(valid.where("doc_id % 3 != 0"), given)
    return step["report"].groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT min(doc_nanoid) AS n FROM documents_raw WHERE doc_nanoid <> '')
SELECT workspace_id, collection_id, doc_id FROM documents_raw WHERE doc_nanoid = (SELECT n FROM n) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, loaded_at DESC) = 1""")
def ingest_lookup_nanoid(spark, d):
    """The document of a public id."""
    raw = t(spark, d, "documents_raw")
    return ing.lookup_nanoid(raw, raw.where("doc_nanoid != ''").agg(F.min("doc_nanoid")).first()[0])


@query("""WITH e AS (SELECT workspace_id AS ontology_id, lower(trim(table_name)) AS type_name FROM table_semantics WHERE table_name IS NOT NULL),
c AS (SELECT workspace_id AS ontology_id, lower(trim(table_name)) AS type_name, count(*) AS n FROM column_semantics GROUP BY ALL),
g AS (SELECT DISTINCT workspace_id AS ontology_id, edge_type AS type_name FROM relation_semantics WHERE edge_type IS NOT NULL), r AS (SELECT workspace_id AS ontology_id, edge_type AS type_name, count(*) AS n FROM relation_semantics GROUP BY ALL)
SELECT DISTINCT ontology_id, 'entity' AS kind, type_name, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (ontology_id, type_name)
UNION ALL SELECT ontology_id, 'edge', type_name, coalesce(n, 0) FROM g LEFT JOIN r USING (ontology_id, type_name)""")
def ontology_inspect(spark, d):
    """The catalogue's tables as types, with the columns of each; edge types with their relations."""
    fold = F.lower(F.trim("table_name")).alias("entity_type")
    types = t(spark, d, "table_semantics").where("table_name is not null").select(F.col("workspace_id").alias("ontology_id"), fold)
    cols = t(spark, d, "column_semantics").select(F.col("workspace_id").alias("ontology_id"), fold)
    rel = t(spark, d, "relation_semantics").select(F.col("workspace_id").alias("ontology_id"), "edge_type")
    return on.inspect_ontology(types, rel.where("edge_type is not null"), cols, rel)
