"""Queries on the quality of the business graph and of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qu
from ..runtime import materialize
from ..runtime import table as t
from .facets import valid_facts
from .graph import ENTITIES, KIND, LIVE, PROPERTIES, RELATIONS, entities, properties, relations
from .registry import query

_RULES = """[
 {"rule_id": "buys", "entity_type": "customer", "relation_type": "bought", "direction": "out", "target_entity_type": "part", "min_count": 20, "max_count": 60,
  "severity": "high", "metadata_json": {"entity_filter": {"metadata": {"segment": {"one_of": ["BUILDING", "MACHINERY"]}}}}},
 {"rule_id": "home", "entity_type": "nation", "relation_type": "located_in", "direction": "in", "max_count": 65, "severity": "low"},
 {"rule_id": "base", "entity_type": "nation", "relation_type": "based_in", "direction": "either", "target_entity_type": "supplier", "min_count": 4, "severity": "medium",
  "metadata_json": {"entity_filter": {"metadata": {"code": {"not_one_of": ["1", "2"]}}}}}
]"""


def rules(spark):
    return qu.upsert_rules(spark.createDataFrame([], qu.RULE), _RULES)


_STATES = f"""{ENTITIES}, {RELATIONS}, {LIVE}, lent AS (SELECT * FROM ent WHERE deprecated_at IS NULL), kind AS (SELECT entity_id, entity_type FROM lent),
subj AS (
  SELECT 'buys' AS rule_id, entity_id, 20 AS lo, 60 AS hi, 'high' AS severity FROM lent WHERE entity_type = 'customer' AND json_extract_string(metadata_json, '$.segment') IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'home', entity_id, NULL, 65, 'low' FROM lent WHERE entity_type = 'nation'
  UNION ALL SELECT 'base', entity_id, 4, NULL, 'medium' FROM lent WHERE entity_type = 'nation' AND json_extract_string(metadata_json, '$.code') NOT IN ('1', '2')
), cnt AS (
  SELECT 'buys' AS rule_id, source_id AS entity_id, count(*) AS n FROM live JOIN kind k ON k.entity_id = target_id WHERE relation_type = 'bought' AND k.entity_type = 'part' GROUP BY 2
  UNION ALL SELECT 'home', target_id, count(*) FROM live WHERE relation_type = 'located_in' GROUP BY 2
  UNION ALL SELECT 'base', target_id, count(*) FROM live JOIN kind k ON k.entity_id = source_id WHERE relation_type = 'based_in' AND k.entity_type = 'supplier' GROUP BY 2
), st AS (
  SELECT rule_id, s.entity_id, CAST(coalesce(n, 0) AS BIGINT) AS n, severity,
         CASE WHEN coalesce(n, 0) < lo THEN 'missing_required_relation' WHEN coalesce(n, 0) > hi THEN 'too_many_relations' END AS issue
  FROM subj s LEFT JOIN cnt USING (rule_id, entity_id)
)"""


@query(f"WITH {_STATES} SELECT rule_id, entity_id, n, CASE WHEN issue IS NULL THEN 'valid' ELSE 'invalid' END AS state, issue, severity FROM st")
def quality_rule_states(spark, d):
    """Cardinality rules with filters, held against every entity of their types."""
    return qu.rule_states(rules(spark), entities(spark, d), relations(spark, d))


@query(f"""WITH {_STATES}, old AS (SELECT rule_id, entity_id, CASE WHEN n % 2 = 0 THEN 'valid' ELSE 'invalid' END AS was FROM st WHERE rule_id <> 'base'),
new AS (SELECT rule_id, entity_id, CASE WHEN issue IS NULL THEN 'valid' ELSE 'invalid' END AS state FROM st)
SELECT rule_id, entity_id, coalesce(was, 'unknown') AS from_state, state AS to_state, (coalesce(was, 'unknown') = 'invalid' AND state = 'valid') AS remediation
FROM new LEFT JOIN old USING (rule_id, entity_id) WHERE state IS DISTINCT FROM was""")
def quality_rule_events(spark, d):
    """State transitions against an earlier evaluation."""
    now = materialize(qu.rule_states(rules(spark), entities(spark, d), relations(spark, d)), "states")
    before = now.where("rule_id != 'base'").select("rule_id", "entity_id", F.when(F.col("n") % 2 == 0, "valid").otherwise("invalid").alias("state"))
    _, events = qu.rule_transitions(before, now, "run-1")
    return events.drop("event_id")


_TYPES = [("bought", "customer", "part"), ("supplies", "supplier", "part"), ("located_in", "customer", "region"), ("part_of", None, "nation")]
_TYPES_SQL = "decl AS (SELECT * FROM (VALUES ('bought', 'customer', 'part'), ('supplies', 'supplier', 'part'), ('located_in', 'customer', 'region'), ('part_of', NULL, 'nation')) v(et, wants, wantt))"


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE}, {_TYPES_SQL} SELECT 'endpoint_type_mismatch' AS issue_type, 'high' AS severity, CAST(relation_id AS VARCHAR) AS subject,
a.entity_type || ' ' || relation_type || ' ' || b.entity_type AS detail
FROM live JOIN decl ON et = relation_type JOIN ent a ON a.entity_id = source_id JOIN ent b ON b.entity_id = target_id
WHERE (wants IS NOT NULL AND wants <> a.entity_type) OR (wantt IS NOT NULL AND wantt <> b.entity_type)""")
def quality_type_mismatches(spark, d):
    declared = spark.createDataFrame(_TYPES, "edge_type string, source_type string, target_type string")
    return qu.type_mismatches(declared, entities(spark, d), relations(spark, d))


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE} SELECT 'isolated_entity' AS issue_type, 'medium' AS severity, CAST(entity_id AS VARCHAR) AS subject, name AS detail
FROM ent WHERE deprecated_at IS NULL AND entity_id NOT IN (SELECT source_id FROM live UNION SELECT target_id FROM live)""")
def quality_isolated(spark, d):
    return qu.isolated_entities(entities(spark, d), relations(spark, d))


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE}, {PROPERTIES}, links AS (SELECT 3 * {KIND} + o_custkey AS entity_id FROM orders)
SELECT 'missing_entity_evidence' AS issue_type, 'medium' AS severity, CAST(entity_id AS VARCHAR) AS subject, name AS detail FROM ent WHERE deprecated_at IS NULL AND entity_type <> 'part' AND entity_id NOT IN (SELECT entity_id FROM links)
UNION ALL SELECT 'missing_relation_evidence', 'medium', CAST(relation_id AS VARCHAR), relation_type FROM live WHERE relation_type = 'supplies'
  AND relation_id NOT IN (SELECT relation_id FROM prop WHERE property_key = 'quantity' AND value_number >= 10)""")
def quality_evidence(spark, d):
    """Entities without an order, supplies without a substantial quantity as their document."""
    links = t(spark, d, "orders").select((F.lit(3 * KIND) + F.col("o_custkey")).alias("entity_id"))
    props = properties(spark, d).withColumn("ref_doc_id", F.when((F.col("property_key") == "quantity") & (F.col("value_number") >= 10), 1))
    return qu.evidence_gaps(entities(spark, d).where("entity_type != 'part'"), relations(spark, d).where("relation_type = 'supplies'"), links, props)


@query("""WITH RECURSIVE pairs AS (SELECT DISTINCT source_table_id AS a, target_table_id AS b FROM relation_semantics WHERE source_table_id <> target_table_id),
moves AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM moves UNION SELECT m.b, r.root FROM reach r JOIN moves m ON m.a = r.node WHERE r.root < m.b),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT 'small_component' AS issue_type, 'low' AS severity, CAST(c AS VARCHAR) AS subject, CAST(count(*) AS VARCHAR) AS detail FROM comp GROUP BY c HAVING count(*) BETWEEN 2 AND 3""")
def quality_small_components(spark, d):
    """Small groups of tables that refer only to one another."""
    rel = t(spark, d, "relation_semantics").where("source_table_id is not null and target_table_id is not null")
    rel = rel.select(F.col("relation_semantic_id").alias("relation_id"), F.col("source_table_id").alias("source_id"), F.col("target_table_id").alias("target_id"), F.lit(None).alias("deprecated_at"))
    return qu.small_components(rel, 3)


@query(f"""WITH {_STATES}, {_TYPES_SQL}, nb AS (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM live UNION ALL SELECT target_id, source_id FROM live) WHERE a <> b),
few AS (SELECT a FROM nb GROUP BY a HAVING count(*) <= 2),
near AS (SELECT a AS n, a AS m FROM few UNION SELECT a, b FROM nb WHERE a IN (SELECT a FROM few)
  UNION SELECT x.a, y.b FROM nb x JOIN nb y ON y.a = x.b WHERE x.a IN (SELECT a FROM few) AND x.b IN (SELECT a FROM few)),
small AS (SELECT n FROM near GROUP BY n HAVING count(*) <= 3),
open AS (SELECT DISTINCT n FROM near JOIN nb ON nb.a = m WHERE n IN (SELECT n FROM small) AND (n, nb.b) NOT IN (SELECT n, m FROM near)),
comp AS (SELECT DISTINCT min(m) AS c, count(*) AS size FROM near WHERE n IN (SELECT n FROM small) AND n NOT IN (SELECT n FROM open) GROUP BY n)
SELECT issue AS issue_type, severity, CAST(entity_id AS VARCHAR) AS subject, rule_id || ' ' || n AS detail FROM st WHERE issue IS NOT NULL
UNION ALL SELECT 'endpoint_type_mismatch', 'high', CAST(relation_id AS VARCHAR), a.entity_type || ' ' || relation_type || ' ' || b.entity_type
FROM live JOIN decl ON et = relation_type JOIN ent a ON a.entity_id = source_id JOIN ent b ON b.entity_id = target_id
WHERE (wants IS NOT NULL AND wants <> a.entity_type) OR (wantt IS NOT NULL AND wantt <> b.entity_type)
UNION ALL SELECT 'isolated_entity', 'medium', CAST(entity_id AS VARCHAR), name FROM lent WHERE entity_id NOT IN (SELECT source_id FROM live UNION SELECT target_id FROM live)
UNION ALL SELECT 'small_component', 'low', CAST(c AS VARCHAR), CAST(size AS VARCHAR) FROM comp""")
def quality_report(spark, d):
    """The issues of all checks together."""
    e, r = entities(spark, d), relations(spark, d)
    declared = spark.createDataFrame(_TYPES, "edge_type string, source_type string, target_type string")
    return qu.diagnostics([qu.rule_gaps(rules(spark), e, r), qu.type_mismatches(declared, e, r), qu.isolated_entities(e, r), qu.small_components(r)])


_FACTS = """valid AS (SELECT * FROM agent_facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC, doc_id) = 1),
idf AS (SELECT workspace_id, coalesce(json_extract_string(facets_json, '$.node_id'), content) AS id, content, facets_json FROM valid WHERE schema_id IN ('tech:term', 'legal:reference')),
names AS (SELECT DISTINCT workspace_id, 'n' || column_semantic_id AS id FROM column_semantics),
cov AS (SELECT f.*, n.id IS NOT NULL AS covered FROM idf f LEFT JOIN names n ON n.workspace_id = f.workspace_id AND n.id = f.id)"""
_SCHEMAS = ("tech:term", "legal:reference")


def _names(spark, d):
    c = t(spark, d, "column_semantics")
    return c.select("workspace_id", F.concat(F.lit("n"), F.col("column_semantic_id").cast("string")).alias("name"), F.lit(None).cast("long").alias("deprecated_at"), F.lit("column").alias("entity_type"))


@query(f"WITH {_FACTS} SELECT workspace_id, CAST(count(*) FILTER (covered) AS BIGINT) AS covered_nodes, count(*) AS total_nodes, round(avg(CAST(covered AS INT)), 6) AS coverage_ratio FROM cov GROUP BY 1")
def quality_coverage(spark, d):
    """How many term facts of each workspace have a column of their identity."""
    out = qu.coverage(valid_facts(spark, d), _names(spark, d), _SCHEMAS)
    return out.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query(f"""WITH {_FACTS} SELECT workspace_id, id, coalesce(json_extract_string(facets_json, '$.label'), content) AS label, coalesce(json_extract_string(facets_json, '$.entity_type'), 'unknown') AS entity_type,
coalesce(json_extract_string(facets_json, '$.criticality'), 'normal') AS criticality FROM cov WHERE NOT covered""")
def quality_coverage_gaps(spark, d):
    return qu.coverage_gaps(valid_facts(spark, d), _names(spark, d), _SCHEMAS)


@query("""WITH a AS (SELECT DISTINCT workspace_id, table_id FROM table_semantics), b AS (SELECT DISTINCT workspace_id, table_id FROM column_semantics)
SELECT 'only_in_tables' AS issue_type, 'medium' AS severity, workspace_id || '|' || table_id AS subject, 'tables' AS detail FROM a WHERE (workspace_id, table_id) NOT IN (SELECT * FROM b)
UNION ALL SELECT 'only_in_columns', 'medium', workspace_id || '|' || table_id, 'columns' FROM b WHERE (workspace_id, table_id) NOT IN (SELECT * FROM a)""")
def quality_reconcile(spark, d):
    """Tables without columns and columns without a table."""
    return qu.reconcile(t(spark, d, "table_semantics"), t(spark, d, "column_semantics"), ["workspace_id", "table_id"], "tables", "columns")


_COUNTS = """cnt AS (
  SELECT workspace_id, count(DISTINCT table_id) AS registry_nodes, 0 AS registry_edges, 0 AS entity_types, 0 AS edge_labels, 0 AS graph_entities FROM table_semantics GROUP BY 1
  UNION ALL SELECT workspace_id, 0, count(DISTINCT relation_semantic_id), 0, count(DISTINCT edge_type), 0 FROM relation_semantics GROUP BY 1
  UNION ALL SELECT workspace_id, 0, 0, count(DISTINCT table_id), 0, count(DISTINCT column_semantic_id) FROM column_semantics GROUP BY 1
), c AS (SELECT workspace_id, sum(registry_nodes) AS rn, sum(registry_edges) AS re, sum(entity_types) AS et, sum(edge_labels) AS el, sum(graph_entities) AS ge FROM cnt GROUP BY 1)"""


@query(f"""WITH {_COUNTS}
SELECT workspace_id, 'native_entity_registry_mismatch' AS issue_type, 'high' AS severity, 0.9 AS confidence FROM c WHERE rn <> et
UNION ALL SELECT workspace_id, 'native_edge_registry_granularity_mismatch', 'medium', 0.85 FROM c WHERE re > 0 AND el > 0 AND re <> el
UNION ALL SELECT workspace_id, 'runtime_graph_relation_materialization_gap', 'critical', 0.95 FROM c WHERE re > 0 AND ge > 0""")
def quality_convergence(spark, d):
    """What the layer counts of each workspace call for."""
    n = F.count_distinct
    a = t(spark, d, "table_semantics").groupBy("workspace_id").agg(n("table_id").alias("registry_nodes"))
    b = t(spark, d, "relation_semantics").groupBy("workspace_id").agg(n("relation_semantic_id").alias("registry_edges"), n("edge_type").alias("edge_labels"))
    c = t(spark, d, "column_semantics").groupBy("workspace_id").agg(n("table_id").alias("entity_types"), n("column_semantic_id").alias("graph_entities"))
    counts = a.join(b, "workspace_id", "full").join(c, "workspace_id", "full")
    zero = F.lit(0)
    return qu.convergence_actions(counts.withColumns({"graph_relations": zero, "coverage_gaps": zero, "diagnostics_issues": zero}))


@query(f"""WITH {RELATIONS}, {LIVE}, t AS (SELECT DISTINCT source_id, relation_type, target_id FROM live WHERE relation_type = 'bought')
SELECT source_id, relation_type, count(*) OVER (PARTITION BY source_id) AS n_targets, target_id FROM t QUALIFY count(*) OVER (PARTITION BY source_id) > 1""")
def quality_exclusive_conflicts(spark, d):
    return qu.exclusive_conflicts(relations(spark, d), ["bought"])


@query(f"""WITH {RELATIONS}, {LIVE}, r AS (SELECT relation_id, source_id, target_id, coalesce(valid_from, -4611686018427387904) AS b, coalesce(valid_to, 4611686018427387904) AS e FROM live WHERE relation_type = 'supplies')
SELECT r.relation_id, max({{'e': p.e, 'id': p.relation_id}}).id AS other_id FROM r JOIN r p
ON p.source_id = r.source_id AND p.target_id <> r.target_id AND p.b <= r.b AND (p.b < r.b OR p.relation_id < r.relation_id) AND p.e >= r.b GROUP BY r.relation_id""")
def quality_overlap_conflicts(spark, d):
    """Supplies of one supplier that overlap in time, against the plain self-join."""
    return qu.overlap_conflicts(relations(spark, d), ["supplies"])


def _versions(spark, d):
    """The references of the catalogue as relations from table to table, valid from one delivery of a row to its latest."""
    rel = t(spark, d, "relation_semantics").where("relation_semantic_id is not null and source_table_id is not null and target_table_id is not null")
    seconds = lambda c: F.unix_timestamp(c)
    return rel.groupBy("relation_semantic_id", "source_table_id", "target_table_id").agg(F.min(seconds("updated_at")).alias("b"), F.max(seconds("ingested_at")).alias("e")).select(
        F.col("relation_semantic_id").alias("relation_id"), F.lit("refers").alias("relation_type"), F.col("source_table_id").alias("source_id"), F.col("target_table_id").alias("target_id"),
        F.col("b").alias("valid_from"), F.when(F.col("relation_semantic_id") % 3 != 0, F.col("e")).alias("valid_to"), F.lit(None).cast("long").alias("deprecated_at"),
    )


_VERSIONS = """ver AS (SELECT relation_semantic_id AS relation_id, source_table_id AS source_id, target_table_id AS target_id, CAST(epoch(date_trunc('second', min(updated_at))) AS BIGINT) AS b,
CASE WHEN relation_semantic_id % 3 <> 0 THEN CAST(epoch(date_trunc('second', max(ingested_at))) AS BIGINT) END AS e
FROM relation_semantics WHERE relation_semantic_id IS NOT NULL AND source_table_id IS NOT NULL AND target_table_id IS NOT NULL GROUP BY relation_semantic_id, source_table_id, target_table_id)"""


@query(f"""WITH {_VERSIONS} SELECT x.relation_id, y.relation_id AS other_id, CASE WHEN x.target_id = y.target_id THEN 'same_target' ELSE 'different_target' END AS kind
FROM ver x JOIN ver y ON x.source_id = y.source_id AND x.relation_id < y.relation_id
WHERE coalesce(x.b, -4e18) <= coalesce(y.e, 4e18) AND coalesce(y.b, -4e18) <= coalesce(x.e, 4e18)""")
def quality_overlap_pairs(spark, d):
    """All pairs of references of one table that overlap in time, of which a table has few."""
    return qu.overlap_pairs(_versions(spark, d), ["refers"])


@query(f"WITH {_VERSIONS} SELECT relation_id, source_id, 'refers' AS relation_type, e AS valid_from, b AS valid_to FROM ver WHERE e > b")
def quality_invalid_intervals(spark, d):
    """References whose begin and end are changed about."""
    rel = _versions(spark, d)
    changed = {"valid_from": F.col("valid_to"), "valid_to": F.col("valid_from")}
    return qu.invalid_intervals(rel.select(*[changed.get(c, F.col(c)).alias(c) for c in rel.columns]))


_TREE = [("customer", "nation"), ("supplier", "nation"), ("nation", "region"), ("part", None)]


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE}, k AS (SELECT entity_id, entity_type FROM ent),
pairs AS (SELECT relation_id, source_id, 'near' AS relation_type, target_id FROM live WHERE relation_type IN ('located_in', 'part_of')
  UNION ALL SELECT -l.relation_id, l.source_id, 'near', r.target_id FROM live l JOIN live r ON r.source_id = l.target_id AND r.relation_type = 'part_of' WHERE l.relation_type = 'located_in'),
typed AS (SELECT pairs.*, entity_type FROM pairs JOIN k ON entity_id = target_id),
tree AS (SELECT * FROM (VALUES ('customer', 'nation'), ('supplier', 'nation'), ('nation', 'region')) v(fine, coarse))
SELECT f.relation_id, min(c.relation_id) AS coarse_relation_id, count(*) AS n_coarse, f.source_id, f.relation_type, fine AS fine_type, coarse AS coarse_type
FROM typed f JOIN tree ON fine = f.entity_type JOIN typed c ON c.source_id = f.source_id AND c.entity_type = coarse GROUP BY ALL""")
def quality_granularity_conflicts(spark, d):
    """Customers said to be near a nation and near its region."""
    rel = relations(spark, d).where("relation_type in ('located_in', 'part_of')")
    up = rel.where("relation_type = 'part_of'").select(F.col("source_id").alias("target_id"), F.col("target_id").alias("region"))
    wide = rel.where("relation_type = 'located_in'").join(up, "target_id").withColumns({"relation_id": -F.col("relation_id"), "target_id": F.col("region")}).drop("region")
    rel = rel.unionByName(wide).withColumn("relation_type", F.lit("near"))
    return qu.granularity_conflicts(rel, entities(spark, d), spark.createDataFrame(_TREE, "entity_type string, parent_type string"))


@query("""WITH r AS (SELECT DISTINCT relation_semantic_id AS relation_id, source_table_id AS source_id, target_table_id AS target_id FROM relation_semantics),
g AS (SELECT source_id, target_id, count(*) AS n, min(relation_id) AS keep_relation_id FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT 'refers' AS relation_type, g.source_id, g.target_id, n, keep_relation_id, relation_id, 'redundant_fact' AS kind
FROM g JOIN r ON r.source_id IS NOT DISTINCT FROM g.source_id AND r.target_id IS NOT DISTINCT FROM g.target_id""")
def quality_redundant(spark, d):
    """References that say the same."""
    rel = t(spark, d, "relation_semantics").select(
        F.col("relation_semantic_id").alias("relation_id"), F.lit("refers").alias("relation_type"), F.col("source_table_id").alias("source_id"), F.col("target_table_id").alias("target_id"), F.lit(None).alias("deprecated_at")
    )
    return qu.redundant_relations(rel.distinct())


@query(f"""WITH {_COUNTS}, a AS (SELECT workspace_id, 'native_entity_registry_mismatch' AS issue_type, 'high' AS severity FROM c WHERE rn <> et
UNION ALL SELECT workspace_id, 'native_edge_registry_granularity_mismatch', 'medium' FROM c WHERE re > 0 AND el > 0 AND re <> el
UNION ALL SELECT workspace_id, 'runtime_graph_relation_materialization_gap', 'critical' FROM c WHERE re > 0 AND ge > 0)
SELECT workspace_id, issue_type, severity, CASE WHEN severity = 'critical' THEN 'applied' WHEN severity = 'high' THEN 'approved' WHEN issue_type LIKE 'native_edge%' THEN 'rejected' END AS status,
CASE WHEN severity = 'critical' THEN 300 END AS applied_at, CASE WHEN severity = 'critical' THEN 300 ELSE 200 END AS updated_at FROM a""")
def quality_decisions(spark, d):
    """The proposed actions decided by severity, and the critical ones carried out."""
    found = quality_convergence(spark, d)
    actions = qu.propose_actions(None, found, "run-1", 100)
    actions = materialize(qu.propose_actions(actions, found, "run-2", 150), "actions")
    decision = F.when(F.col("severity") == "medium", "rejected").otherwise("approved").alias("decision")
    decided = materialize(qu.decide_actions(actions, actions.select("action_id", decision, F.lit("reviewer").alias("actor"), F.lit(None).cast("string").alias("note")), 200), "actions")
    done = decided.where("severity = 'critical'").select("action_id", F.lit("applied").alias("status"), F.lit('{"ok":true}').alias("result_json"))
    return qu.record_results(decided, done, 300).select("workspace_id", "issue_type", "severity", "status", "applied_at", "updated_at")


@query("""WITH decl AS (SELECT DISTINCT workspace_id, lower(trim(table_name)) AS type_name FROM table_semantics WHERE table_name IS NOT NULL)
SELECT DISTINCT 'columns_unknown_type' AS issue_type, 'warning' AS severity, workspace_id || '|' || lower(trim(table_name)) AS subject, 'columns' AS detail FROM column_semantics
WHERE table_name IS NOT NULL AND (workspace_id, lower(trim(table_name))) NOT IN (SELECT * FROM decl)
UNION ALL SELECT DISTINCT 'references_unknown_type', 'warning', workspace_id || '|' || lower(trim(to_table)), 'references' FROM relation_semantics
WHERE to_table IS NOT NULL AND workspace_id IS NOT NULL AND (workspace_id, lower(trim(to_table))) NOT IN (SELECT * FROM decl)""")
def quality_reconcile_layers(spark, d):
    """Table names that the column lists and the references use but no table has."""
    name = lambda df, c: df.select("workspace_id", F.lower(F.trim(c)).alias("n"))
    declared = name(t(spark, d, "table_semantics"), "table_name").select("workspace_id", F.col("n").alias("type_name")).where("type_name is not null").distinct()
    rel = name(t(spark, d, "relation_semantics").where("workspace_id is not null"), "to_table")
    return qu.reconcile_layers({"columns": (name(t(spark, d, "column_semantics"), "table_name"), "n", declared), "references": (rel, "n", declared)})


@query(f"""WITH {_FACTS}, w AS (SELECT min(workspace_id) AS workspace_id FROM valid)
SELECT workspace_id, CAST(count(*) FILTER (covered) AS BIGINT) AS covered_nodes, count(*) AS total_nodes, round(avg(CAST(covered AS INT)), 6) AS coverage_ratio FROM cov WHERE workspace_id = (SELECT workspace_id FROM w) GROUP BY 1""")
def quality_coverage_by_domain(spark, d):
    """Coverage of the workspace that a domain stands for."""
    facts = valid_facts(spark, d)
    first = facts.agg(F.min("workspace_id")).first()[0]
    spaces = facts.select("workspace_id", F.when(F.col("workspace_id") == first, "first").otherwise("other").alias("domain"), F.lit(None).cast("string").alias("label")).distinct()
    return qu.coverage_by_domain(facts, _names(spark, d), spaces, "first", _SCHEMAS).withColumn("coverage_ratio", F.round("coverage_ratio", 6))
