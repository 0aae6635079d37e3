"""Composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as co
from ..operators import facets as fa
from ..operators import search as se
from ..runtime import table as t
from .facets import valid_facts
from .memory import agent_projections
from .registry import query
from .search import POSTINGS, TEXT, _EXACT, _scores, index

_FACTS = """valid AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
docs AS (SELECT doc_id FROM valid WHERE schema_id IN ('tech:term', 'mem:note') AND json_extract_string(facets_json, '$.criticality') = 'high'),
refs AS (SELECT DISTINCT source_ref FROM valid JOIN docs USING (doc_id) WHERE source_ref IS NOT NULL),
rel AS (SELECT DISTINCT source_table_id AS a, target_table_id AS b FROM relation_semantics WHERE source_table_id IS NOT NULL AND target_table_id IS NOT NULL),
moves AS (SELECT a, b FROM rel UNION SELECT b, a FROM rel),
walk AS (SELECT min(table_id) AS node, 0 AS depth FROM table_semantics UNION SELECT b, depth + 1 FROM walk JOIN moves ON a = node WHERE depth < 2),
asg AS (SELECT doc_id, 'schema' AS n, schema_id AS v FROM valid UNION SELECT doc_id, 'workspace', workspace_id FROM valid)"""


@query(f"""WITH RECURSIVE {_FACTS}
SELECT 'documents' AS part, CAST(doc_id AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS n FROM docs
UNION ALL SELECT 'facet_counts', n || '=' || v, count(*) FROM asg JOIN docs USING (doc_id) WHERE v IS NOT NULL GROUP BY n, v
UNION ALL SELECT 'reachable', CAST(node AS VARCHAR), min(depth) FROM walk GROUP BY node
UNION ALL SELECT 'source_refs', source_ref, NULL FROM refs
UNION ALL SELECT 'projections', id, NULL FROM valid WHERE created_by = 'agent_a' AND valid_until_unix IS NULL AND source_ref IN (SELECT source_ref FROM refs)""")
def composite_answer(spark, d):
    """Facts by facets, their counts, the tables around one, and an agent's projections of the facts' sources."""
    facts = valid_facts(spark, d)
    assigned = fa.assignments(
        facts,
        "doc_id",
        {"schema": fa.plain("schema_id"), "workspace": fa.plain("workspace_id"), "criticality": fa.plain(F.get_json_object("facets_json", "$.criticality"))},
    )
    rel = t(spark, d, "relation_semantics").where("source_table_id is not null and target_table_id is not null")
    rel = rel.select(
        F.col("relation_semantic_id").alias("relation_id"), F.col("source_table_id").alias("source_id"), F.col("target_table_id").alias("target_id"), F.lit(None).alias("deprecated_at")
    )
    seeds = t(spark, d, "table_semantics").agg(F.min("table_id").alias("node"))
    wanted = {"schema": ["tech:term", "mem:note"], "criticality": "high"}
    parts = co.composite(assigned, wanted, ["schema", "workspace"], rel, seeds, 2, facts.select("doc_id", "source_ref"), agent_projections(spark, d), "agent_a")
    return co.flatten(parts)


@query(f"""WITH {_scores(_EXACT)}, top AS (SELECT max(score) AS m FROM bm), pas AS (SELECT doc_id, score / m AS score FROM bm, top),
lng AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS score FROM documents), knd AS (SELECT doc_id, CASE WHEN doc_kind = 'rule' THEN 1.0 ELSE 0.0 END AS score FROM documents),
al AS (SELECT doc_id, 0.45 * score AS s FROM pas UNION ALL SELECT doc_id, 0.30 * score FROM knd UNION ALL SELECT doc_id, 0.10 * score FROM lng)
SELECT doc_id, round(sum(s), 6) AS score FROM al GROUP BY doc_id""")
def composite_recall(spark, d):
    """A blend of passage, kind and language scores of the documents."""
    found = se.bm25_search(index(spark, d), TEXT, None)
    best = found.agg(F.max("score")).first()[0]
    docs = t(spark, d, "documents")
    flag = lambda c: docs.select("doc_id", F.when(c, 1.0).otherwise(0.0).alias("score"))
    none = found.limit(0)
    out = co.recall(flag(F.col("lang") == "en"), flag(F.col("doc_kind") == "rule"), found.select("doc_id", (F.col("score") / best).alias("score")), none)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {POSTINGS}, hit AS (SELECT DISTINCT doc_id FROM post WHERE term = 'owner')
SELECT collection_id AS workspace_id, doc_id, 1.0 AS score FROM documents JOIN hit USING (doc_id) WHERE collection_id IN ('col_01', 'col_02', 'col_03')""")
def composite_federated(spark, d):
    """One search over several collections."""
    hits = se.matching_documents(index(spark, d), "owner")
    docs = t(spark, d, "documents").select("doc_id", "collection_id").join(hits, "doc_id", "left_semi")
    part = lambda c: docs.where(F.col("collection_id") == c).select("doc_id", F.lit(1.0).alias("score"))
    return co.federated({c: part(c) for c in ("col_01", "col_02", "col_03")}, None)
