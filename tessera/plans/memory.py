"""Queries on memory: proposition lines of the memory documents, projections made of them and of the facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as me
from ..runtime import table as t
from .facets import valid_facts
from .registry import query

_KINDS = {"en": "FACT", "fr": "GOAL", "nl": "CONSTRAINT", "de": "STEP", "es": "NOTE"}


def projections(spark, d):
    """A memory projection of each memory document: user = collection, type by language, hint = rank of the first line."""
    docs = t(spark, d, "documents").where("doc_kind = 'memory' and text is not null")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("lang")), F.lit("raw"))
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
        F.col("collection_id").alias("user_id"),
        kind.alias("projection_type"),
        F.col("text").alias("content"),
        F.regexp_extract("text", r"rank=([0-9.]+)", 1).try_cast("double").alias("rank_hint"),
        F.lit(0.5).alias("confidence"),
        F.concat(F.lit('{"source":"'), F.col("source"), F.lit('"}')).alias("metadata_json"),
        F.lit("{}").alias("facets_json"),
    )


_PROJ = """proj AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, collection_id AS user_id,
         CASE lang WHEN 'en' THEN 'FACT' WHEN 'fr' THEN 'GOAL' WHEN 'nl' THEN 'CONSTRAINT' WHEN 'de' THEN 'STEP' WHEN 'es' THEN 'NOTE' ELSE 'raw' END AS projection_type,
         text AS content, TRY_CAST(regexp_extract(text, 'rank=([0-9.]+)', 1) AS DOUBLE) AS rank_hint, 0.5 AS confidence, '{"source":"' || source || '"}' AS metadata_json
  FROM documents WHERE doc_kind = 'memory' AND text IS NOT NULL
), kinds AS (SELECT * FROM (VALUES ('FACT', 1.3, 1, 1.2), ('GOAL', 1.2, 1, 1.1), ('CONSTRAINT', 1.0, 2, 1.0), ('STEP', 0.9, 2, 0.9), ('NOTE', 0.7, 3, 0.6)) k(kind, bias, priority, factor))"""


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE doc_kind = 'memory' AND text IS NOT NULL),
ok AS (SELECT doc_id, line_no, regexp_replace(line, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS line FROM lines)
SELECT doc_id, line_no, trim(split_part(line, '|', 1)) AS record_type,
  CASE trim(split_part(line, '|', 1)) WHEN 'fact' THEN 1.2 WHEN 'goal' THEN 1.1 WHEN 'constraint' THEN 1.0 WHEN 'edge' THEN 0.95 WHEN 'step' THEN 0.9 ELSE 0.8 END AS prior
FROM ok WHERE contains(line, '|') AND trim(split_part(line, '|', 1)) <> ''""")
def memory_records(spark, d):
    """Every proposition line of the memory documents."""
    docs = t(spark, d, "documents").where("doc_kind = 'memory' and text is not null")
    return me.records(docs, "doc_id", "text").select("doc_id", "line_no", "record_type", "prior")


@query(f"""WITH {_PROJ} SELECT id, projection_type, round(coalesce(bias, 0.9) + confidence + coalesce(rank_hint, 0) * 0.5, 6) AS score FROM proj LEFT JOIN kinds ON kind = upper(projection_type)
WHERE user_id = 'col_01' AND contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')""")
def memory_rank(spark, d):
    """A user's projections that have a word, with their rank."""
    out = me.rank(projections(spark, d), me.projection_types(spark), "col_01", "The", None, None)
    return out.select("id", "projection_type", F.round("score", 6).alias("score"))


@query(f"""WITH {_PROJ} SELECT id, projection_type, coalesce(priority, CASE lower(projection_type) WHEN 'canonical' THEN 1 WHEN 'proposition' THEN 2 WHEN 'raw' THEN 3 END) AS priority
FROM proj LEFT JOIN kinds ON kind = upper(projection_type) WHERE user_id = 'col_02' AND contains(metadata_json, 'memory')""")
def memory_pack(spark, d):
    """A user's packable projections of a scope with their priority."""
    out = me.pack_context(projections(spark, d), me.projection_types(spark), "col_02", "", "player:memory", None)
    return out.select("id", "projection_type", "priority")


_EDGES = """edges AS (SELECT DISTINCT workspace_id AS user_id, lower(trim(from_table)) AS node_from, lower(trim(to_table)) AS node_to, 1.0 AS weight FROM relation_semantics WHERE to_table IS NOT NULL)"""


@query(f"""WITH {_EDGES}, seed AS (SELECT min(node_from) AS s FROM edges WHERE user_id = 'ws_main'), hop AS (
  SELECT node_to AS node, weight AS w FROM edges, seed WHERE user_id = 'ws_main' AND node_from = s
  UNION ALL SELECT node_from, weight * 0.8 FROM edges, seed WHERE user_id = 'ws_main' AND node_to = s
) SELECT node, round(sum(w), 6) AS score FROM hop GROUP BY node""")
def memory_next_hops(spark, d):
    """Where to go from a table of a workspace."""
    name = lambda c: F.lower(F.trim(c))
    edges = (
        t(spark, d, "relation_semantics")
        .where("to_table is not null")
        .select(F.col("workspace_id").alias("user_id"), name("from_table").alias("node_from"), name("to_table").alias("node_to"), F.lit(1.0).alias("weight"))
        .distinct()
    )
    seed = edges.where("user_id = 'ws_main'").agg(F.min("node_from")).first()[0]
    out = me.next_hops(edges, projections(spark, d), me.projection_types(spark), "ws_main", [seed], None)
    return out.withColumn("score", F.round("score", 6))


def agent_projections(spark, d):
    """A projection of each valid fact: agent = creator, scope = workspace, weight by version."""
    return valid_facts(spark, d).select(
        "id",
        F.col("created_by").alias("agent_id"),
        F.col("workspace_id").alias("scope"),
        F.when(F.col("schema_id").startswith("syndic"), "CONSTRAINT").otherwise("FACT").alias("proj_type"),
        "content",
        (F.col("version") / 8.0).alias("weight"),
        "source_ref",
        F.lit("fact").alias("source_type"),
        F.when(F.col("valid_until_unix").isNull(), "active").otherwise("expired").alias("status"),
    )


_AGENT = """valid AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
ap AS (SELECT id, created_by AS agent_id, workspace_id AS scope, CASE WHEN starts_with(schema_id, 'syndic') THEN 'CONSTRAINT' ELSE 'FACT' END AS proj_type, content, version / 8.0 AS weight,
  CASE WHEN valid_until_unix IS NULL THEN 'active' ELSE 'expired' END AS status FROM valid),
live AS (SELECT * FROM ap WHERE agent_id = 'agent_a' AND status IN ('active', 'blocking'))"""


@query(f"WITH {_AGENT} SELECT id, weight FROM live WHERE contains(lower(content), 'lease') ORDER BY live.weight DESC, id LIMIT 50")
def projections_by_weight(spark, d):
    """An agent's live projections about a word (a top-k report)."""
    return me.materialize_projections(agent_projections(spark, d), "agent_a", 50, query="Lease").select("id", "weight")


@query(f"WITH {_AGENT} SELECT id, proj_type, weight FROM live WHERE scope IS NULL OR scope = 'ws_main' OR starts_with(scope, 'ws_main:') ORDER BY proj_type <> 'CONSTRAINT', live.weight DESC, id LIMIT 50")
def projections_pack(spark, d):
    """Constraints first (a top-k report)."""
    return me.materialize_pack(agent_projections(spark, d), "agent_a", 50, workspace="ws_main").select("id", "proj_type", "weight")


@query(f"""WITH {_AGENT} SELECT id, round(CASE WHEN contains(lower(content), 'owner') THEN weight WHEN contains(lower(content), 'lease') THEN weight * 0.6 END, 6) AS score
FROM live WHERE contains(lower(content), 'owner') OR contains(lower(content), 'lease')""")
def projections_relevance(spark, d):
    out = me.materialize_relevance(agent_projections(spark, d), "agent_a", "owner", "lease", None)
    return out.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_AGENT} SELECT round(coalesce(sum(CASE WHEN contains(lower(content), 'owner') THEN weight WHEN contains(lower(content), 'lease') THEN weight * 0.6 END), 0), 6) AS relevance FROM live""")
def projections_relevance_sum(spark, d):
    return me.projection_relevance(agent_projections(spark, d), "agent_a", "owner", "lease").withColumn("relevance", F.round("relevance", 6))
