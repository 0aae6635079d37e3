"""Queries on the catalogue tables: schema drift (problem 2) and orphan references (problem 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, references
from ..runtime import table as t
from .registry import query

_LISTS = r"""
kinds AS (SELECT DISTINCT lower(trim(alias)) AS alias, canonical FROM label_aliases WHERE alias_kind = 'data_type'),
applied AS (SELECT id AS migration_id, min(applied_at) AS applied_at FROM mindbrain_schema_migrations GROUP BY id),
cols AS (
  SELECT table_id, migration_id, column_semantic_id, column_name AS name, lower(trim(column_name)) AS folded, data_type
  FROM column_semantics
  QUALIFY row_number() OVER (PARTITION BY table_id, migration_id, column_semantic_id
                             ORDER BY updated_at DESC, column_name DESC, data_type DESC) = 1
), files AS (
  SELECT table_id, migration_id, row_number() OVER (PARTITION BY table_id ORDER BY applied_at, migration_id) AS seq
  FROM (SELECT DISTINCT table_id, migration_id FROM cols) JOIN applied USING (migration_id)
), lists AS (
  SELECT c.table_id, c.migration_id, f.seq, c.column_semantic_id, c.name, c.folded,
         coalesce(k.canonical, lower(trim(c.data_type))) AS type
  FROM cols c JOIN files f ON f.table_id = c.table_id AND f.migration_id = c.migration_id
  LEFT JOIN kinds k ON k.alias = lower(trim(c.data_type))
), steps AS (
  SELECT *, lag(seq) OVER w AS pseq, lag(folded) OVER w AS pfolded, lag(name) OVER w AS pname, lag(type) OVER w AS ptype, lead(seq) OVER w AS nseq
  FROM lists WINDOW w AS (PARTITION BY table_id, column_semantic_id ORDER BY seq)
), found AS (
  SELECT table_id, migration_id, column_semantic_id, 'added' AS change FROM steps WHERE seq > 1 AND (pseq IS NULL OR pseq < seq - 1)
  UNION ALL SELECT table_id, migration_id, column_semantic_id, 'renamed' FROM steps WHERE pseq = seq - 1 AND pfolded <> folded
  UNION ALL SELECT table_id, migration_id, column_semantic_id, 'retyped' FROM steps WHERE pseq = seq - 1 AND ptype <> type
  UNION ALL SELECT s.table_id, f.migration_id, s.column_semantic_id, 'removed'
            FROM steps s JOIN files f ON f.table_id = s.table_id AND f.seq = s.seq + 1
            WHERE s.nseq IS NULL OR s.nseq > s.seq + 1
)"""


@query(f"WITH {_LISTS} SELECT * FROM found")
def p2_found(spark, d):
    """Added, removed, renamed and retyped columns of each file against the table's file before it."""
    report = drift.drift_report(t(spark, d, "column_semantics"), t(spark, d, "mindbrain_schema_migrations"), t(spark, d, "label_aliases"))
    return report.select("table_id", "migration_id", "column_semantic_id", "change")


_REPORT = """
  SELECT table_id, migration_id, column_semantic_id, 'added' AS change, NULL AS before, name AS after, NULL AS alternative FROM steps WHERE seq > 1 AND (pseq IS NULL OR pseq < seq - 1)
  UNION ALL SELECT table_id, migration_id, column_semantic_id, 'renamed', pname, name, NULL FROM steps WHERE pseq = seq - 1 AND pfolded <> folded
  UNION ALL SELECT table_id, migration_id, column_semantic_id, 'retyped', ptype, type, seq = (SELECT min(o.seq) FROM steps o WHERE o.table_id = s.table_id AND o.column_semantic_id = s.column_semantic_id AND o.type = s.type)
            FROM steps s WHERE pseq = seq - 1 AND ptype <> type
  UNION ALL SELECT s.table_id, f.migration_id, s.column_semantic_id, 'removed', s.name, NULL, NULL
            FROM steps s JOIN files f ON f.table_id = s.table_id AND f.seq = s.seq + 1 WHERE s.nseq IS NULL OR s.nseq > s.seq + 1"""


@query(f"WITH {_LISTS} {_REPORT}")
def p2_report(spark, d):
    return drift.drift_report(t(spark, d, "column_semantics"), t(spark, d, "mindbrain_schema_migrations"), t(spark, d, "label_aliases"))


@query(f"""WITH {_LISTS}, kind AS (SELECT table_id, column_semantic_id, type, min(seq) AS s, arg_min(migration_id, seq) AS since FROM lists GROUP BY ALL),
fused AS (SELECT table_id, column_semantic_id, string_agg(type || ' since ' || since, '; ' ORDER BY s) AS alternatives, count(*) AS n, min(type) AS one,
  bool_and(type IN ('bigint', 'integer')) AS whole, bool_and(type IN ('bigint', 'integer', 'double', 'numeric')) AS number FROM kind GROUP BY ALL),
last AS (SELECT table_id, column_semantic_id, arg_max(name, seq) AS name FROM lists GROUP BY ALL)
SELECT table_id, column_semantic_id, name, CASE WHEN n = 1 THEN one WHEN whole THEN 'bigint' WHEN number THEN 'double' ELSE 'text' END AS type, alternatives, n > 1 AS conflicting
FROM fused JOIN last USING (table_id, column_semantic_id)""")
def p2_schema(spark, d):
    return drift.unified_schema(t(spark, d, "column_semantics"), t(spark, d, "mindbrain_schema_migrations"), t(spark, d, "label_aliases"))


_UNIFIED = r"""
kind AS (SELECT table_id, column_semantic_id, type, min(seq) AS s FROM lists GROUP BY ALL),
fused AS (SELECT table_id, column_semantic_id, CASE WHEN count(*) = 1 THEN min(type) WHEN bool_and(type IN ('bigint', 'integer')) THEN 'bigint'
  WHEN bool_and(type IN ('bigint', 'integer', 'double', 'numeric')) THEN 'double' ELSE 'text' END AS canonical_type FROM kind GROUP BY ALL),
last AS (SELECT table_id, column_semantic_id, arg_max(name, seq) AS name FROM lists GROUP BY ALL),
listed AS (SELECT table_id, migration_id, column_semantic_id, folded, type AS tag, name, canonical_type FROM lists l JOIN fused USING (table_id, column_semantic_id)
  JOIN (SELECT table_id AS ti, column_semantic_id AS ci, name AS nm FROM last) ON ti = table_id AND ci = column_semantic_id),
named AS (SELECT l.* EXCLUDE (name), n.name FROM listed l JOIN last n USING (table_id, column_semantic_id)),
rec AS (SELECT DISTINCT record_id, table_id, migration_id, payload, payload IS NOT NULL AND coalesce(json_valid(payload), false) AS whole FROM import_records),
fields AS (SELECT record_id, table_id, migration_id, payload, lower(trim(k)) AS k, json_extract_string(payload, '$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(payload)) AS k FROM rec WHERE whole)),
cells AS (
  SELECT r.record_id, r.table_id, r.migration_id, n.column_semantic_id, n.name, n.tag, n.canonical_type, f.v AS raw, CASE WHEN f.k IS NULL THEN 'missing' ELSE 'field' END AS here
  FROM rec r JOIN named n ON n.table_id = r.table_id AND n.migration_id = r.migration_id
  LEFT JOIN fields f ON f.record_id IS NOT DISTINCT FROM r.record_id AND f.table_id = r.table_id AND f.migration_id = r.migration_id AND f.payload = r.payload AND f.k = n.folded WHERE r.whole
  UNION ALL SELECT f.record_id, f.table_id, f.migration_id, NULL, f.k, NULL, NULL, f.v, 'unlisted' FROM fields f
  LEFT JOIN named n ON n.table_id = f.table_id AND n.migration_id = f.migration_id AND n.folded = f.k WHERE n.folded IS NULL
  UNION ALL SELECT record_id, table_id, migration_id, NULL, NULL, NULL, NULL, payload, 'unreadable' FROM rec WHERE NOT whole
), typed AS (
  SELECT *, CASE WHEN regexp_full_match(raw, '\s*-?\d+,\d+\s*') THEN replace(raw, ',', '.') ELSE raw END AS num,
    CASE WHEN regexp_full_match(raw, '\s*-?\d+\s*') THEN try_cast(trim(raw) AS BIGINT) END AS whole,
    CASE WHEN lower(raw) IN ('true', 't', 'yes') THEN true WHEN lower(raw) IN ('false', 'f', 'no') THEN false END AS truth,
    coalesce(CASE WHEN regexp_matches(raw, '^\s*\d{4}-\d\d-\d\d') THEN try_cast(replace(trim(raw), 'Z', '') AS TIMESTAMP) END,
      CASE WHEN regexp_full_match(raw, '\s*\d\d/\d\d/\d{4}\s*') THEN try_strptime(trim(raw), '%d/%m/%Y') END) AS tm FROM cells
), parsed AS (
  SELECT *, CASE WHEN regexp_full_match(num, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*') THEN try_cast(trim(num) AS DOUBLE) END AS rl,
    tag = 'json' AND json_valid(raw) AS jsonok FROM typed
), held AS (
  SELECT *, CASE WHEN here <> 'field' THEN here WHEN raw IS NULL THEN 'null'
    WHEN CASE WHEN tag IN ('bigint', 'integer') THEN whole IS NOT NULL WHEN tag IN ('double', 'numeric') THEN rl IS NOT NULL WHEN tag = 'boolean' THEN truth IS NOT NULL
      WHEN tag = 'timestamp' THEN tm IS NOT NULL WHEN tag = 'json' THEN jsonok ELSE true END THEN 'ok' ELSE 'wrong type' END AS status FROM parsed
)"""


@query(f"""WITH {_LISTS}, {_UNIFIED}
SELECT record_id, table_id, migration_id, column_semantic_id, name, tag, canonical_type, raw, status,
  CASE WHEN tag IN ('bigint', 'integer') OR status = 'wrong type' THEN whole END AS v_bigint,
  CASE WHEN tag = 'double' OR canonical_type = 'double' OR (status = 'wrong type' AND whole IS NULL) THEN round(rl, 6) END AS v_double,
  CASE WHEN tag = 'numeric' THEN round(rl, 4) END AS v_decimal,
  CASE WHEN tag = 'boolean' OR (status = 'wrong type' AND whole IS NULL AND rl IS NULL) THEN truth END AS v_boolean,
  CASE WHEN tag = 'timestamp' OR (status = 'wrong type' AND whole IS NULL AND rl IS NULL AND truth IS NULL) THEN strftime(tm, '%Y-%m-%d %H:%M:%S') END AS v_timestamp,
  CASE WHEN jsonok THEN raw END AS v_json, raw AS v_text FROM held""")
def p2_table(spark, d):
    """The records of all files as one typed table; numbers rounded and times to the second, for the comparison."""
    table = drift.unified_records(
        t(spark, d, "import_records"), t(spark, d, "column_semantics"), t(spark, d, "mindbrain_schema_migrations"), t(spark, d, "label_aliases")
    )
    return table.withColumns(
        {
            "v_double": F.round("v_double", 6),
            "v_decimal": F.round(F.col("v_decimal").cast("double"), 4),
            "v_timestamp": F.date_format("v_timestamp", "yyyy-MM-dd HH:mm:ss"),
        }
    )


_REFS = r"""
rel AS (
  SELECT * FROM relation_semantics
  QUALIFY row_number() OVER (PARTITION BY relation_semantic_id ORDER BY ingested_at DESC, updated_at DESC, to_table, source_table_id, target_table_id) = 1
), tab AS (
  SELECT DISTINCT table_id, workspace_id, lower(trim(table_schema)) AS s, lower(trim(table_name)) AS n, registered_at, deleted_at
  FROM table_semantics
), refs AS (
  SELECT r.relation_semantic_id AS id, 'source_table_id' AS f, r.updated_at AS u, t.registered_at AS b, t.deleted_at AS e, t.table_id AS k
  FROM rel r LEFT JOIN tab t ON t.workspace_id = r.workspace_id AND t.table_id = r.source_table_id WHERE r.source_table_id IS NOT NULL
  UNION ALL
  SELECT r.relation_semantic_id, 'target_table_id', r.updated_at, t.registered_at, t.deleted_at, t.table_id
  FROM rel r LEFT JOIN tab t ON t.workspace_id = r.workspace_id AND t.table_id = r.target_table_id WHERE r.target_table_id IS NOT NULL
  UNION ALL
  SELECT r.relation_semantic_id, 'to_table', r.updated_at, t.registered_at, t.deleted_at, t.table_id
  FROM rel r LEFT JOIN tab t ON t.workspace_id = r.workspace_id AND t.s = lower(trim(r.to_schema)) AND t.n = lower(trim(r.to_table))
  WHERE trim(r.to_table) <> ''
), judged AS (
  SELECT id AS relation_semantic_id, f AS ref_field,
         min(k) AS found, any_value(u) AS u, CASE WHEN bool_and(k IS NULL) THEN 'missing'
              WHEN bool_or(coalesce(b <= u, true) AND NOT coalesce(e <= u, false)) THEN NULL
              WHEN bool_or(coalesce(e <= u, false)) THEN 'deleted' ELSE 'late' END AS kind
  FROM refs GROUP BY id, f
)"""


@query(f"WITH {_REFS} SELECT relation_semantic_id, ref_field, kind FROM judged WHERE kind IS NOT NULL")
def p7_found(spark, d):
    """References to tables that are missing, deleted or registered later: the cascade's direct orphans (level 0)."""
    found = references.orphan_cascade(t(spark, d, "relation_semantics"), t(spark, d, "table_semantics"))
    return found.where("level = 0").select("relation_semantic_id", "ref_field", "kind")


_CASCADE = """direct AS (SELECT relation_semantic_id AS id, ref_field, kind, 0 AS level, date_trunc('month', u) AS period FROM judged WHERE kind IS NOT NULL),
src AS (SELECT relation_semantic_id AS id, found AS t FROM judged WHERE ref_field = 'source_table_id' AND found IS NOT NULL),
sound AS (SELECT relation_semantic_id AS id, ref_field, found, date_trunc('month', u) AS period FROM judged WHERE kind IS NULL AND ref_field <> 'source_table_id' AND found IS NOT NULL),
hop AS (SELECT DISTINCT found AS a, t AS b FROM sound JOIN src USING (id)),
tables AS (SELECT a FROM hop UNION SELECT b FROM hop),
lv AS (SELECT t, 1 AS level FROM direct JOIN src USING (id) UNION SELECT b, level + 1 FROM lv JOIN hop ON a = t WHERE level <= (SELECT count(*) FROM tables)),
least AS (SELECT t, min(level) AS level FROM lv GROUP BY t),
cascade AS (SELECT id AS relation_semantic_id, ref_field, kind, level, period FROM direct UNION ALL SELECT id, ref_field, 'inherited', level, period FROM sound JOIN least ON t = found)"""


@query(f"WITH RECURSIVE {_REFS}, {_CASCADE} SELECT * FROM cascade")
def p7_cascade(spark, d):
    return references.orphan_cascade(t(spark, d, "relation_semantics"), t(spark, d, "table_semantics"))


@query(f"WITH RECURSIVE {_REFS}, {_CASCADE} SELECT ref_field, period, kind, level, count(*) AS orphans FROM cascade GROUP BY ALL")
def p7_report(spark, d):
    return references.orphan_report(t(spark, d, "relation_semantics"), t(spark, d, "table_semantics"))
