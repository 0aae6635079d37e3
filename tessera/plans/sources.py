"""Queries on sources and sinks (round trips through each format) and on changes to stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as co
from ..operators import ingest as ing
from ..operators import ontology as on
from ..operators import textprep as tp
from ..runtime import materialize, new_folder
from ..runtime import table as t
from ..sources import rdf, tabular, toon
from .facets import valid_facts
from .registry import query

_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


def _nations(spark, d):
    return t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query(_NATIONS)
def source_csv(spark, d):
    """Nations written as CSV and read again; all cells are text."""
    folder = new_folder(spark, "csv")
    _nations(spark, d).write.csv(folder, header=True)
    return tabular.read_csv(spark, folder)


@query("SELECT doc_id, source, md5(text) AS digest FROM documents WHERE text <> ''")
def source_csv_texts(spark, d):
    """Texts with separators, quotes and line ends in them, through CSV and back."""
    folder = new_folder(spark, "csv")
    docs = t(spark, d, "documents").where("text != ''").select("doc_id", "source", F.base64(F.encode("text", "UTF-8")).alias("text"))
    docs.write.csv(folder, header=True, quote='"', escape='"')
    back = tabular.read_csv(spark, folder)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5(F.unbase64("text")).alias("digest"))


@query(_NATIONS)
def source_tsv(spark, d):
    folder = new_folder(spark, "tsv")
    _nations(spark, d).write.csv(folder, header=True, sep="\t")
    return tabular.read_tsv(spark, folder)


@query("SELECT event_id, user_id, event_type, props FROM events")
def source_json(spark, d):
    """Events through JSON lines and back, with a schema."""
    folder = new_folder(spark, "json")
    rows = t(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    rows.write.json(folder, ignoreNullFields=False)
    return tabular.read_json(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))


@query(_NATIONS)
def source_toon(spark, d):
    """Nations as a TOON document and back."""
    folder = new_folder(spark, "toon")
    text = toon.to_toon(_nations(spark, d), "nation")
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(folder)
    return toon.read_toon(spark, folder, "nation")


@query("SELECT 'nation' AS \"table\", count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region")
def source_bundle(spark, d):
    """A bundle exported, imported and summed up."""
    folder = new_folder(spark, "bundle")
    tabular.export_bundle({"nation": _nations(spark, d), "region": t(spark, d, "region").select("r_regionkey", "r_name")}, folder)
    return tabular.bundle_summary(tabular.import_bundle(spark, folder))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey >= 3 GROUP BY r_name")
def source_sql(spark, d):
    """A SQL text with a parameter over given tables."""
    tables = {"nation": _nations(spark, d), "region": t(spark, d, "region")}
    return tabular.run_sql(spark, "SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey >= :low GROUP BY r_name", tables, low=3)


_SUBJECT = "'http://example.org/fact#' || doc_id"


@query(f"""WITH v AS (SELECT * FROM agent_facts WHERE doc_id IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1)
SELECT DISTINCT {_SUBJECT} AS subject, 'http://example.org/terms#content' AS predicate, 'literal' AS object_kind, content AS object_value FROM v
UNION SELECT {_SUBJECT}, '{on.RDF_TYPE}', 'iri', 'http://example.org/schema/' || schema_id FROM v""")
def source_ntriples(spark, d):
    """The facts as N-Triples and back: their contents are literals, their schemas types."""
    facts = valid_facts(spark, d).where("doc_id is not null and content is not null")
    subject = F.concat(F.lit("http://example.org/fact#"), F.col("doc_id").cast("string")).alias("subject")
    none = F.lit(None).cast("string")
    row = lambda p, kind, v: facts.select(F.lit("iri").alias("subject_kind"), subject, F.lit(p).alias("predicate"), F.lit(kind).alias("object_kind"), v.alias("object_value"), none.alias("object_language"), none.alias("object_datatype"))
    both = row("http://example.org/terms#content", "literal", F.col("content")).unionByName(row(on.RDF_TYPE, "iri", F.concat(F.lit("http://example.org/schema/"), "schema_id")))
    folder = new_folder(spark, "nt")
    rdf.write_ntriples(both.distinct(), folder)
    return rdf.read_ntriples(spark, folder).select("subject", "predicate", "object_kind", "object_value")


_KNOWN = "known AS (SELECT workspace_id, source_ref, min(id) AS id, max(version) AS version FROM agent_facts WHERE workspace_id IS NOT NULL AND source_ref IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_KNOWN}, asked AS (SELECT workspace_id, source_ref FROM known WHERE version >= 2 UNION ALL SELECT DISTINCT workspace_id, 'new:' || workspace_id FROM known)
SELECT coalesce(k.id, 'facet_' || substr(sha256(a.workspace_id || ':' || a.source_ref), 1, 32)) AS id, a.workspace_id, a.source_ref, coalesce(k.version, 0) + 1 AS version, 'second' AS content FROM asked a LEFT JOIN known k USING (workspace_id, source_ref)
UNION ALL SELECT id, workspace_id, source_ref, version, 'known' FROM known WHERE version < 2""")
def ingest_write_facts(spark, d):
    """Facts written over those there: known sources keep their id and rise by a version."""
    rows = t(spark, d, "agent_facts").where("workspace_id is not null and source_ref is not null")
    known = rows.groupBy("workspace_id", "source_ref").agg(F.min("id").alias("id"), F.max("version").cast("long").alias("version"), F.min("doc_id").alias("doc_id"))
    text = {"schema_id": F.lit("s"), "content": F.lit("known"), "facets_json": F.lit("{}"), "updated_at_unix": F.lit(1).cast("long")}
    facts = materialize(known.withColumns(text), "facts")
    new = facts.select("workspace_id").distinct().select("workspace_id", F.concat(F.lit("new:"), "workspace_id").alias("source_ref"))
    asked = facts.where("version >= 2").select("workspace_id", "source_ref").unionByName(new)
    change = lambda content, seq: asked.select("*", F.lit("s").alias("schema_id"), F.lit(content).alias("content"), F.lit("{}").alias("facets_json"), F.lit(seq).alias("seq"))
    return ing.write_facts(facts, change("first", 1).unionByName(change("second", 2)), 2).select("id", "workspace_id", "source_ref", "version", "content")


@query("""WITH r AS (SELECT DISTINCT relation_semantic_id AS id, source_table_id AS s, target_table_id AS g FROM relation_semantics WHERE relation_semantic_id IS NOT NULL AND source_table_id IS NOT NULL AND target_table_id IS NOT NULL),
dead AS (SELECT * FROM r WHERE id % 5 = 0), live AS (SELECT id, s, g, 0.5 AS c FROM r WHERE id % 5 <> 0), new AS (SELECT id + 1000000 AS id, s, g, 0.25 + id % 2 * 0.5 AS c FROM r WHERE id % 3 = 0),
merged AS (SELECT s AS source_id, g AS target_id, min(id) AS relation_id, max(c) AS confidence FROM (SELECT * FROM live UNION ALL SELECT * FROM new) GROUP BY ALL)
SELECT relation_id, source_id, target_id, confidence, CAST(NULL AS BIGINT) AS deprecated_at FROM merged UNION ALL SELECT id, s, g, 0.5, 7 FROM dead""")
def ingest_relations(spark, d):
    """Relations upserted by their natural key, beside deprecated ones that stay."""
    rows = t(spark, d, "relation_semantics").where("relation_semantic_id is not null and source_table_id is not null and target_table_id is not null")
    rows = rows.select(F.col("relation_semantic_id").alias("id"), "source_table_id", "target_table_id").distinct()
    none = F.lit(None).cast("long")
    made = lambda df, key, confidence, *more: df.select(
        F.lit("refers").alias("relation_type"), F.col("source_table_id").alias("source_id"), F.col("target_table_id").alias("target_id"), F.lit("r").alias("run_id"), key.alias("relation_id"),
        confidence.cast("double").alias("confidence"), none.alias("valid_from"), none.alias("valid_to"), *more,
    )
    old = made(rows, F.col("id"), F.lit(0.5), F.when(F.col("id") % 5 == 0, 7).cast("long").alias("deprecated_at"))
    new = made(rows.where("id % 3 = 0"), F.col("id") + 1000000, 0.25 + F.col("id") % 2 * 0.5, F.lit(1).alias("seq"))
    return ing.upsert_relations(old, new).select("relation_id", "source_id", "target_id", "confidence", "deprecated_at")


@query("""WITH w AS (SELECT DISTINCT workspace_id AS w FROM agent_facts WHERE workspace_id IS NOT NULL), a AS (SELECT 'view:' || w AS artifact_id, w AS workspace_id, length(w) % 3 AS k FROM w)
SELECT artifact_id, workspace_id, CAST(CASE WHEN k = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN k = 0 THEN 'stale' WHEN k = 1 THEN 'stale' ELSE 'frozen' END AS status, CASE WHEN k = 0 THEN 'fresh' ELSE 'old' END AS payload FROM a""")
def composite_views(spark, d):
    """Live answer views refreshed where the version fits, and then marked stale but for frozen ones."""
    spaces = t(spark, d, "agent_facts").where("workspace_id is not null").select("workspace_id").distinct()
    k = F.length("workspace_id") % 3
    views = spaces.select(F.concat(F.lit("view:"), "workspace_id").alias("artifact_id"), "workspace_id", F.lit(1).cast("long").alias("version"), F.when(k == 2, "frozen").otherwise("live").alias("status"), F.lit("old").alias("payload"))
    fresh = spaces.select(F.concat(F.lit("view:"), "workspace_id").alias("artifact_id"), F.when(k == 0, 1).otherwise(9).cast("long").alias("expected_version"), F.lit("fresh").alias("payload"))
    after, _ = co.refresh_views(views, fresh, 5)
    return co.mark_stale(after, [r["workspace_id"] for r in spaces.collect()])


@query("""WITH l AS (SELECT doc_id % 50 AS entity_id, doc_id, chunk_index % 2 AS role, token_count AS c FROM chunks_raw WHERE doc_id IS NOT NULL)
SELECT entity_id, doc_id, role, CAST(max(c) AS DOUBLE) AS confidence FROM l GROUP BY ALL""")
def ingest_evidence_links(spark, d):
    """Evidence once per key, with the greatest confidence."""
    rows = t(spark, d, "chunks_raw").where("doc_id is not null")
    links = rows.select((F.col("doc_id") % 50).alias("entity_id"), "doc_id", (F.col("chunk_index") % 2).alias("role"), F.col("token_count").cast("double").alias("confidence"))
    return ing.evidence_links(links, ["entity_id", "doc_id", "role"])


@query("""SELECT DISTINCT data_type, CASE lower(trim(data_type)) WHEN 'int8' THEN 'bigint' WHEN 'varchar' THEN 'text' ELSE lower(trim(data_type)) END AS name FROM column_semantics""")
def text_map_names(spark, d):
    """Aliases of type names mapped to one name each."""
    rows = t(spark, d, "column_semantics").select("data_type").distinct()
    return rows.select("data_type", tp.map_names(F.lower(F.trim("data_type")), {"int8": "bigint", "varchar": "text"}).alias("name"))


@query("""WITH c AS (SELECT workspace_id, lower(trim(table_name)) AS entity_type, count(*) AS n FROM column_semantics GROUP BY ALL), t AS (SELECT DISTINCT workspace_id, lower(trim(table_name)) AS entity_type FROM table_semantics)
SELECT workspace_id, entity_type, coalesce(n, 0) AS n, t.entity_type IS NOT NULL AS declared FROM c FULL JOIN t USING (workspace_id, entity_type)""".replace("t.entity_type IS NOT NULL", "list_contains((SELECT list(workspace_id || '|' || entity_type) FROM t), workspace_id || '|' || entity_type)"))
def ontology_coverage_types(spark, d):
    """How often each table is used as a type by the column lists, and whether it is declared."""
    fold = F.lower(F.trim("table_name"))
    used = t(spark, d, "column_semantics").select("workspace_id", fold.alias("entity_type"))
    return on.coverage_by_types(used, t(spark, d, "table_semantics").select("workspace_id", fold.alias("type_name")))


@query("""SELECT event_id AS msg_id, CASE WHEN event_id % 4 = 0 AND event_id < 400 THEN 1 ELSE 0 END AS archived FROM events UNION ALL
SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY r_regionkey), 0 FROM region""")
def queue_settle(spark, d):
    """Messages sent behind those there, and some of the old ones archived; new ids are numbered on for the comparison."""
    from pyspark.sql import Window

    zero = F.lit(0)
    old = t(spark, d, "events").select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("queue_name"), zero.alias("read_ct"), F.lit(1).cast("long").alias("enqueued_at_unix"),
        F.lit(None).cast("long").alias("vt_until_unix"), zero.alias("archived"), zero.alias("deleted"), F.col("props").cast("string").alias("message"),
    )
    top = old.agg(F.max("msg_id")).first()[0]
    sent = ing.send(old, "q", t(spark, d, "region").select(F.col("r_name").alias("message")), 2)
    after = ing.settle(sent, list(range(0, 400, 4)), "archived")
    order = Window.orderBy("msg_id")
    new = after.where(F.col("msg_id") > top).select((F.row_number().over(order) + top).cast("long").alias("msg_id"), "archived")
    return after.where(F.col("msg_id") <= top).select("msg_id", "archived").unionByName(new)
