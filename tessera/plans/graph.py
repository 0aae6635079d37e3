"""Queries on the property graph that the business tables make: places, customers, suppliers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import gpq
from ..operators import graph as g
from ..runtime import kept, materialize
from ..runtime import table as t
from .registry import query

KIND = 10**15  # entity ids: number of the type times KIND plus the table's key
RELATION = 10**18  # relation ids: number of the type times RELATION plus source key * 10^9 plus target key

ENTITIES = f"""ent AS (
  SELECT 1 * {KIND} + r_regionkey AS entity_id, 'region' AS entity_type, r_name AS name, 1.0 AS confidence,
         '{{"domain":"place","code":"' || r_regionkey || '"}}' AS metadata_json, CAST(NULL AS BIGINT) AS deprecated_at FROM region
  UNION ALL SELECT 2 * {KIND} + n_nationkey, 'nation', n_name, 0.75, '{{"domain":"place","code":"' || n_nationkey || '"}}', NULL FROM nation
  UNION ALL SELECT 3 * {KIND} + c_custkey, 'customer', c_name, (c_acctbal + 1000.0) / 11000.0, '{{"domain":"trade","segment":"' || c_mktsegment || '"}}',
         CASE WHEN c_acctbal < -900 THEN 1 END FROM customer
  UNION ALL SELECT 4 * {KIND} + s_suppkey, 'supplier', s_name, (s_acctbal + 1000.0) / 11000.0, '{{"domain":"trade"}}', NULL FROM supplier
  UNION ALL SELECT 5 * {KIND} + p_partkey, 'part', p_name, 0.5, '{{"domain":"goods","brand":"' || p_brand || '","type":"' || p_type || '"}}', NULL FROM part
)"""
RELATIONS = f"""rel AS (
  SELECT 1 * {RELATION} + CAST(n_nationkey AS BIGINT) * 1000000000 + n_regionkey AS relation_id, 'part_of' AS relation_type, 2 * {KIND} + n_nationkey AS source_id,
         1 * {KIND} + n_regionkey AS target_id, CAST(NULL AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, 1.0 AS confidence,
         CAST(NULL AS BIGINT) AS deprecated_at FROM nation
  UNION ALL SELECT 2 * {RELATION} + CAST(c_custkey AS BIGINT) * 1000000000 + c_nationkey, 'located_in', 3 * {KIND} + c_custkey, 2 * {KIND} + c_nationkey, NULL, NULL, 0.9,
         CASE WHEN c_acctbal < -900 THEN 1 END FROM customer
  UNION ALL SELECT 3 * {RELATION} + CAST(s_suppkey AS BIGINT) * 1000000000 + s_nationkey, 'based_in', 4 * {KIND} + s_suppkey, 2 * {KIND} + s_nationkey, NULL, NULL, 0.9, NULL FROM supplier
  UNION ALL SELECT 4 * {RELATION} + CAST(l_suppkey AS BIGINT) * 1000000000 + l_partkey, 'supplies', 4 * {KIND} + l_suppkey, 5 * {KIND} + l_partkey,
         CAST(epoch(min(l_shipdate)) AS BIGINT), CAST(epoch(max(l_shipdate)) AS BIGINT), least(1.0, count(*) / 4.0), NULL FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 5 * {RELATION} + CAST(o_custkey AS BIGINT) * 1000000000 + l_partkey, 'bought', 3 * {KIND} + o_custkey, 5 * {KIND} + l_partkey,
         CAST(epoch(min(l_shipdate)) AS BIGINT), NULL, 0.5, NULL FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
)"""
PROPERTIES = f"""prop AS (
  SELECT 4 * {RELATION} + CAST(l_suppkey AS BIGINT) * 1000000000 + l_partkey AS relation_id, 'quantity' AS property_key, 'number' AS value_type, CAST(NULL AS VARCHAR) AS value_text,
         sum(l_quantity) AS value_number, CAST(NULL AS BIGINT) AS value_integer FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 4 * {RELATION} + CAST(l_suppkey AS BIGINT) * 1000000000 + l_partkey, 'last_flag', 'text', max(l_returnflag), NULL, NULL FROM lineitem GROUP BY l_suppkey, l_partkey
)"""


def entities(spark, d):
    """The entities, stored once in a session."""
    return spark.read.parquet(kept(spark, "entities", d, lambda path: made_entities(spark, d).write.parquet(path)))


def relations(spark, d):
    """The relations, stored once in a session by their type."""
    made = lambda path: made_relations(spark, d).repartition("relation_type", F.pmod(F.xxhash64("source_id"), F.lit(8))).sortWithinPartitions("relation_type", "source_id")
    return spark.read.parquet(kept(spark, "relations", d, lambda path: made(path).write.parquet(path)))


def made_entities(spark, d):
    def one(table, number, kind, key, name, confidence, meta, dead=None):
        rows = t(spark, d, table)
        return rows.select(
            (F.lit(number * KIND) + F.col(key)).alias("entity_id"),
            F.lit(kind).alias("entity_type"),
            F.col(name).alias("name"),
            confidence.cast("double").alias("confidence"),
            F.concat(*[F.col(x[1:]).cast("string") if x[:1] == "@" else F.lit(x) for x in meta]).alias("metadata_json"),
            (dead if dead is not None else F.lit(None)).cast("long").alias("deprecated_at"),
        )

    balance = lambda c: (F.col(c) + 1000.0) / 11000.0
    parts = [
        one("region", 1, "region", "r_regionkey", "r_name", F.lit(1.0), ('{"domain":"place","code":"', "@r_regionkey", '"}')),
        one("nation", 2, "nation", "n_nationkey", "n_name", F.lit(0.75), ('{"domain":"place","code":"', "@n_nationkey", '"}')),
        one(
            "customer", 3, "customer", "c_custkey", "c_name", balance("c_acctbal"), ('{"domain":"trade","segment":"', "@c_mktsegment", '"}'),
            F.when(F.col("c_acctbal") < -900, 1),
        ),
        one("supplier", 4, "supplier", "s_suppkey", "s_name", balance("s_acctbal"), ('{"domain":"trade"}',)),
        one("part", 5, "part", "p_partkey", "p_name", F.lit(0.5), ('{"domain":"goods","brand":"', "@p_brand", '","type":"', "@p_type", '"}')),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def made_relations(spark, d):
    def one(rows, number, kind, source, target, a, b, confidence, start=None, end=None, dead=None):
        null = F.lit(None)
        return rows.select(
            (F.lit(number * RELATION) + F.col(a).cast("long") * 1000000000 + F.col(b)).alias("relation_id"),
            F.lit(kind).alias("relation_type"),
            (F.lit(source * KIND) + F.col(a)).alias("source_id"),
            (F.lit(target * KIND) + F.col(b)).alias("target_id"),
            (start if start is not None else null).cast("long").alias("valid_from"),
            (end if end is not None else null).cast("long").alias("valid_to"),
            confidence.cast("double").alias("confidence"),
            (dead if dead is not None else null).cast("long").alias("deprecated_at"),
        )

    lines = t(spark, d, "lineitem")
    ends = [F.unix_timestamp(F.min("l_shipdate")).alias("s"), F.unix_timestamp(F.max("l_shipdate")).alias("e"), F.count("*").alias("n")]
    supplied = lines.groupBy("l_suppkey", "l_partkey").agg(*ends)
    sold = lines.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(ends[0])
    dead = F.when(F.col("c_acctbal") < -900, 1)
    parts = [
        one(t(spark, d, "nation"), 1, "part_of", 2, 1, "n_nationkey", "n_regionkey", F.lit(1.0)),
        one(t(spark, d, "customer"), 2, "located_in", 3, 2, "c_custkey", "c_nationkey", F.lit(0.9), dead=dead),
        one(t(spark, d, "supplier"), 3, "based_in", 4, 2, "s_suppkey", "s_nationkey", F.lit(0.9)),
        one(supplied, 4, "supplies", 4, 5, "l_suppkey", "l_partkey", F.least(F.lit(1.0), F.col("n") / 4.0), F.col("s"), F.col("e")),
        one(sold, 5, "bought", 3, 5, "o_custkey", "l_partkey", F.lit(0.5), F.col("s")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


stored = relations  # traversals walk over the stored relations


def properties(spark, d):
    by = t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    key = (F.lit(4 * RELATION) + F.col("l_suppkey").cast("long") * 1000000000 + F.col("l_partkey")).alias("relation_id")
    null = F.lit(None)
    each = lambda k, kind, text, number: F.struct(
        F.lit(k).alias("property_key"), F.lit(kind).alias("value_type"), text.cast("string").alias("value_text"),
        number.cast("double").alias("value_number"), null.cast("long").alias("value_integer"),
    )
    both = F.array(each("quantity", "number", null, F.col("q")), each("last_flag", "text", F.col("f"), null))
    return by.select(key, F.explode(both).alias("p")).select("relation_id", "p.*")


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


LIVE = "live AS (SELECT * FROM rel WHERE deprecated_at IS NULL)"


def _bfs(seed: str, where: str, hops: int, both: bool = True) -> str:
    """SQL of (node, depth) by levels; a recursive table that keeps what earlier levels reached."""
    back = f"UNION ALL SELECT target_id, source_id FROM live WHERE {where}" if both else ""
    return f"""moves AS (SELECT source_id AS here, target_id AS there FROM live WHERE {where} {back}), walk AS (
  {seed} UNION SELECT m.there, w.depth + 1 FROM walk w JOIN moves m ON m.here = w.node WHERE w.depth < {hops}
), bfs AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


_PLACES = "relation_type IN ('part_of', 'based_in', 'located_in')"


@query(f"WITH RECURSIVE {RELATIONS}, {LIVE}, {_bfs(f'SELECT 4 * {KIND} + 1 AS node, 0 AS depth', _PLACES, 3)} SELECT node, depth FROM bfs")
def graph_k_hops(spark, d):
    """All within three undirected hops of a supplier over places."""
    f = g.EdgeFilter(types=["part_of", "based_in", "located_in"])
    return g.k_hops(relations(spark, d), _seed(spark, 4 * KIND + 1), 3, f)


_CUT = 757382400  # 1994-01-01


@query(f"""WITH RECURSIVE {RELATIONS}, {LIVE}, {_bfs(f"SELECT 4 * {KIND} + 1 AS node, 0 AS depth", f"relation_type = 'supplies' AND confidence >= 0.25 AND confidence <= 0.75 AND (valid_to IS NULL OR valid_to >= {_CUT})", 2)}
SELECT node, depth FROM bfs""")
def graph_k_hops_filtered(spark, d):
    """Two hops with filters on type, confidence and time."""
    f = g.EdgeFilter(types=["supplies"], confidence_min=0.25, confidence_max=0.75, valid_after=_CUT)
    return g.k_hops(relations(spark, d), _seed(spark, 4 * KIND + 1), 2, f)


@query(f"""WITH RECURSIVE {RELATIONS}, {PROPERTIES}, live AS (SELECT * FROM rel WHERE deprecated_at IS NULL
  AND relation_id IN (SELECT relation_id FROM prop WHERE property_key = 'quantity' AND value_number >= 40)
  AND relation_id IN (SELECT relation_id FROM prop WHERE property_key = 'last_flag' AND value_text IN ('A', 'R'))),
{_bfs(f"SELECT 4 * {KIND} + 1 AS node, 0 AS depth", "true", 2)} SELECT node, depth FROM bfs""")
def graph_k_hops_properties(spark, d):
    """Two hops over relations with typed properties."""
    f = g.EdgeFilter(properties=[("quantity", "gte", 40), ("last_flag", "in_text", "A", "R")])
    return g.k_hops(relations(spark, d), _seed(spark, 4 * KIND + 1), 2, f, properties(spark, d))


@query(f"""WITH RECURSIVE {RELATIONS}, {LIVE}, {_bfs(f"SELECT 3 * {KIND} + 2 AS node, 0 AS depth", "true", 4)}
SELECT 3 * {KIND} + 2 AS source, 3 * {KIND} + 3 AS target, depth AS hops FROM bfs WHERE node = 3 * {KIND} + 3""")
def graph_shortest_path(spark, d):
    """The length of the shortest way between two customers."""
    a, b = 3 * KIND + 2, 3 * KIND + 3
    hops = g.shortest_path_hops(stored(spark, d), a, b, 4)
    return spark.createDataFrame([(a, b, hops)] if hops is not None else [], "source long, target long, hops int")


@query(f"""WITH RECURSIVE {RELATIONS}, {LIVE}, {_bfs(f"SELECT 3 * {KIND} + 2 AS node, 0 AS depth", "true", 4)}
SELECT unnest(range(1, depth + 1)) AS depth, true AS is_edge, true AS connected FROM bfs WHERE node = 3 * {KIND} + 3""")
def graph_path_edges(spark, d):
    """The steps of that way: as there are several shortest ones, whether each is an edge that goes on where the last one ended."""
    rels = stored(spark, d)
    a, b = 3 * KIND + 2, 3 * KIND + 3
    path = g.shortest_path(rels, a, b, 4) or []
    rows = [(x["depth"], x["from"], x["to"], x["relation_id"], x["from"] == y and (x["to"] == b) == (x is path[-1])) for x, y in zip(path, [a, *[p["to"] for p in path]])]
    walked = spark.createDataFrame(rows, "depth long, source long, target long, relation_id long, connected boolean")
    live = rels.where("deprecated_at is null").select("relation_id", F.array("source_id", "target_id").alias("ends"))
    known = walked.join(live, "relation_id", "left")
    is_edge = F.coalesce(F.array_sort("ends") == F.array_sort(F.array("source", "target")), F.lit(False))
    return known.select("depth", is_edge.alias("is_edge"), "connected")


@query(f"""WITH RECURSIVE {RELATIONS}, {ENTITIES}, {LIVE}, start AS (SELECT min(entity_id) AS node FROM ent WHERE name = (SELECT s_name FROM supplier WHERE s_suppkey = 1) AND deprecated_at IS NULL),
{_bfs("SELECT node, 0 AS depth FROM start", "relation_type IN ('based_in', 'part_of', 'supplies')", 3, False)}
SELECT depth, node, name FROM bfs JOIN ent ON entity_id = node""")
def graph_traverse(spark, d):
    """A directed search by name, three levels outbound."""
    name = t(spark, d, "supplier").where("s_suppkey = 1").first()["s_name"]
    ents = entities(spark, d)
    return g.traverse(ents, relations(spark, d), name, "outbound", ["based_in", "part_of", "supplies"], 3).select("depth", "node", "name")


@query(f"""WITH RECURSIVE {RELATIONS}, {LIVE}, dep AS (
  SELECT target_id AS entity_id, relation_type, 1 AS depth FROM live WHERE source_id = 3 * {KIND} + 2 AND confidence >= 0.6
  UNION SELECT l.target_id, l.relation_type, p.depth + 1 FROM dep p JOIN live l ON l.source_id = p.entity_id WHERE l.confidence >= 0.6 AND p.depth < 4
) SELECT entity_id, relation_type, depth FROM dep""")
def graph_dependencies(spark, d):
    """All directed walks from a customer over sure relations."""
    kinds = ["part_of", "located_in", "based_in", "supplies", "bought"]
    return g.dependencies(stored(spark, d), 3 * KIND + 2, kinds, 4, 0.6)


@query(f"""WITH RECURSIVE {RELATIONS}, {LIVE}, {_bfs(f"SELECT 2 * {KIND} + 6 AS node, 0 AS depth", _PLACES, 2)}, walked AS (
  SELECT relation_id, min(depth) + 1 AS depth FROM (
    SELECT relation_id, depth FROM live JOIN bfs ON node = source_id WHERE depth < 2 AND {_PLACES}
    UNION ALL SELECT relation_id, depth FROM live JOIN bfs ON node = target_id WHERE depth < 2 AND {_PLACES}) GROUP BY relation_id
) SELECT CASE WHEN depth = 0 THEN 'seed_node' ELSE 'node' END AS kind, node AS id, depth FROM bfs
UNION ALL SELECT 'edge', relation_id, depth FROM walked UNION ALL SELECT 'done', NULL, 3""")
def graph_subgraph_events(spark, d):
    """The surroundings of a nation as an ordered stream of events."""
    f = g.EdgeFilter(types=["part_of", "based_in", "located_in"])
    return g.subgraph_events(relations(spark, d), _seed(spark, 2 * KIND + 6), 2, f)


@query(f"""WITH {RELATIONS}, {LIVE}
SELECT * FROM (SELECT 'out' AS direction, relation_id, relation_type, target_id AS other_id, confidence FROM live WHERE source_id = 4 * {KIND} + 2 ORDER BY confidence DESC, relation_id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'in', relation_id, relation_type, source_id, confidence FROM live WHERE target_id = 4 * {KIND} + 2 ORDER BY confidence DESC, relation_id LIMIT 15)""")
def graph_neighbourhood(spark, d):
    """The fifteen strongest relations either way (a top-k report)."""
    return g.neighbourhood(relations(spark, d), 4 * KIND + 2, 15, 15)


@query(f"""WITH {RELATIONS}, {ENTITIES}, {LIVE}, o AS (SELECT source_id AS id, count(*) AS n FROM live GROUP BY 1), i AS (SELECT target_id AS id, count(*) AS n FROM live GROUP BY 1)
SELECT entity_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS total_degree
FROM ent LEFT JOIN o ON o.id = entity_id LEFT JOIN i ON i.id = entity_id""")
def graph_degrees(spark, d):
    return g.degrees(entities(spark, d), relations(spark, d))


@query(f"""WITH {RELATIONS}, {LIVE}
SELECT source_id AS entity_id, 'out' AS direction, CAST(0 AS INT) AS block, list_sort(list_distinct(list(relation_id))) AS relation_ids FROM live GROUP BY 1
UNION ALL SELECT target_id, 'in', CAST(0 AS INT), list_sort(list_distinct(list(relation_id))) FROM live GROUP BY 1""")
def graph_adjacency(spark, d):
    """The relations of each node, in one block each as none has over 10,000."""
    return g.adjacency(relations(spark, d))


@query(f"WITH {ENTITIES} SELECT entity_type, count(*) AS n FROM ent GROUP BY 1")
def graph_type_counts(spark, d):
    """Entities per type, deprecated ones too."""
    return entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTITIES} SELECT entity_id, name FROM ent WHERE deprecated_at IS NULL AND entity_type = 'customer'
AND json_extract_string(metadata_json, '$.segment') = 'BUILDING' AND json_extract_string(metadata_json, '$.domain') = 'trade'""")
def graph_find_by_metadata(spark, d):
    return g.find_entities(entities(spark, d), "customer", metadata={"segment": "BUILDING", "domain": "trade"}).select("entity_id", "name")


_TOKS = "list_filter(regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9A-Za-z]|[^\\x00-\\x7F])+'), lambda x: octet_length(encode(x)) > 1)"
_SEARCH = f"""tok AS (SELECT *, {_TOKS.format(x="name")} AS tn, {_TOKS.format(x="metadata_json")} AS tm, {_TOKS.format(x="entity_type")} AS tt,
  {_TOKS.format(x="coalesce(json_extract_string(metadata_json, '$.domain'), '')")} AS td FROM ent WHERE deprecated_at IS NULL),
scored AS (SELECT *,
  CASE WHEN list_contains(tn, 'brand') THEN 2.0 WHEN list_contains(tm, 'brand') THEN 1.0 WHEN list_contains(tt, 'brand') OR list_contains(td, 'brand') THEN 0.5 END
  + CASE WHEN list_contains(tn, 'part') THEN 2.0 WHEN list_contains(tm, 'part') THEN 1.0 WHEN list_contains(tt, 'part') OR list_contains(td, 'part') THEN 0.5 END
  + CASE WHEN list_contains(tn, 'brand') AND list_contains(tn, 'part') THEN 1.0 ELSE 0.0 END + CASE WHEN tn = ['brand', 'part'] THEN 0.5 ELSE 0.0 END
  + CASE WHEN (NOT list_contains(tn, 'brand') AND list_contains(tm, 'brand')) OR (NOT list_contains(tn, 'part') AND list_contains(tm, 'part')) THEN 0.25 ELSE 0.0 END AS rank
FROM tok)"""


@query(f"WITH {ENTITIES}, {_SEARCH} SELECT entity_id, rank FROM scored WHERE rank IS NOT NULL")
def graph_entity_search(spark, d):
    """Entities in which every word of a query occurs, with their rank."""
    return g.entity_text_search(entities(spark, d), "Brand part", limit=None).select("entity_id", "rank")


@query(f"""WITH {ENTITIES}, s AS (SELECT entity_id, CASE WHEN contains(lower(name), 'pa') THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(entity_type), 'pa') THEN 3.0 ELSE 0 END
+ CASE WHEN contains(lower(metadata_json), 'pa') THEN 1.0 ELSE 0 END AS score FROM ent WHERE deprecated_at IS NULL) SELECT * FROM s WHERE score > 0""")
def graph_substring_search(spark, d):
    return g.substring_search(entities(spark, d), ["pa"], None).select("entity_id", "score")


@query(f"""WITH {RELATIONS}, {ENTITIES}, k AS (SELECT entity_id, entity_type FROM ent)
SELECT a.entity_type AS source_type, relation_type, b.entity_type AS target_type, count(*) AS n, count(DISTINCT source_id) AS n_sources,
count(DISTINCT target_id) AS n_targets, max(valid_from) AS last_valid_from
FROM rel JOIN k a ON a.entity_id = source_id JOIN k b ON b.entity_id = target_id WHERE deprecated_at IS NULL GROUP BY ALL""")
def graph_schema_patterns(spark, d):
    return g.schema_patterns(entities(spark, d), relations(spark, d))


@query(f"""WITH {ENTITIES}, touched AS (SELECT 3 * {KIND} + o_custkey AS entity_id, max(CAST(epoch(o_orderdate) AS BIGINT)) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT entity_id, round(CASE WHEN seen IS NULL THEN 0.1 ELSE confidence * pow(0.5, greatest(0.0, (904608000.0 - seen) / 86400.0) / 365) END, 6) AS decayed
FROM ent LEFT JOIN touched USING (entity_id)""")
def graph_confidence_decay(spark, d):
    """Confidence decayed since the last finished order, half in a year, as of 1998-09-01."""
    orders = t(spark, d, "orders").where("o_orderstatus = 'F'")
    touched = orders.select((F.lit(3 * KIND) + F.col("o_custkey")).alias("entity_id"), F.unix_timestamp("o_orderdate").alias("at"))
    return g.confidence_decay(entities(spark, d), touched, 904608000, 365).withColumn("decayed", F.round("decayed", 6))


@query(f"""WITH {RELATIONS}, {ENTITIES}, {LIVE}, {_SEARCH}, hit AS (SELECT entity_id, rank FROM scored WHERE rank IS NOT NULL ORDER BY rank DESC, confidence DESC, name, entity_id LIMIT 200),
moves AS (SELECT source_id AS here, target_id AS there FROM live WHERE relation_type = 'supplies' UNION ALL SELECT target_id, source_id FROM live WHERE relation_type = 'supplies'),
near AS (SELECT entity_id AS node FROM hit UNION SELECT there FROM moves JOIN hit ON here = entity_id),
deg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM live UNION ALL SELECT target_id FROM live) GROUP BY id),
m AS (SELECT e.entity_id, e.name, coalesce(rank, 0.1) * e.confidence * CASE WHEN rank IS NULL THEN 1.0 ELSE 1.5 END * (1 + least(0.5, ln(coalesce(n, 0) + 1) / 8)) AS composite,
  least(1.0, ln(coalesce(n, 0) + 1) / 4) AS hub_score FROM ent e JOIN near ON node = e.entity_id LEFT JOIN hit h ON h.entity_id = e.entity_id LEFT JOIN deg ON id = e.entity_id WHERE e.deprecated_at IS NULL)
SELECT entity_id, round(composite, 6) AS composite, round(hub_score, 6) AS hub_score FROM m ORDER BY m.composite DESC, name, entity_id LIMIT 50""")
def graph_marketplace(spark, d):
    """The fifty best entities around the hits of a search (a top-k report)."""
    out = g.marketplace_search(entities(spark, d), relations(spark, d), "Brand part", ["supplies"], 1, limit=50)
    return out.select("entity_id", F.round("composite", 6).alias("composite"), F.round("hub_score", 6).alias("hub_score"))


@query(f"""WITH RECURSIVE pairs AS (SELECT DISTINCT source_table_id AS a, target_table_id AS b FROM relation_semantics WHERE source_table_id <> target_table_id),
moves AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM moves UNION SELECT m.b, r.root FROM reach r JOIN moves m ON m.a = r.node WHERE r.root < m.b)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def graph_components(spark, d):
    """Connected components of the tables that refer to one another, each named by its least id."""
    rel = t(spark, d, "relation_semantics").select(
        F.col("relation_semantic_id").alias("relation_id"), F.lit("refers").alias("relation_type"), F.col("source_table_id").alias("source_id"),
        F.col("target_table_id").alias("target_id"), F.lit(None).cast("long").alias("deprecated_at"), F.lit(1.0).alias("confidence"),
    )
    return g.components(rel.where("source_id is not null and target_id is not null"))


# --- graph pattern queries ---------------------------------------------------------------------------------------

_NODES = """WORKSPACE trade
MATCH (c:customer)
WHERE c.metadata.segment = "BUILDING"
AND c.confidence >= 0.5
PROJECT c.entity_id, c.name, c.confidence
LIMIT 1000"""


@query(f"""WITH {ENTITIES} SELECT entity_id AS "c.entity_id", name AS "c.name", round(confidence, 6) AS "c.confidence" FROM ent
WHERE deprecated_at IS NULL AND entity_type = 'customer' AND json_extract_string(metadata_json, '$.segment') = 'BUILDING' AND confidence >= 0.5
ORDER BY confidence DESC, entity_id LIMIT 1000""")
def gpq_nodes(spark, d):
    """A pattern of one node."""
    out = gpq.execute(gpq.parse(_NODES), entities(spark, d), relations(spark, d))
    return out.withColumn("c.confidence", F.round(F.col("`c.confidence`"), 6))


_EDGES = """WORKSPACE trade
MATCH (s:supplier)-[r:supplies]->(p:part)
WHERE r.prop.quantity >= 150
AND r.confidence > 0.5
AND p.metadata.domain = "goods"
PROJECT s.entity_id, p.entity_id, r.relation_id, r.prop.quantity
LIMIT 1000"""


@query(f"""WITH {ENTITIES}, {RELATIONS}, {PROPERTIES} SELECT s.entity_id AS "s.entity_id", p.entity_id AS "p.entity_id", r.relation_id AS "r.relation_id", q.value_number AS "r.prop.quantity"
FROM rel r JOIN ent s ON s.entity_id = source_id JOIN ent p ON p.entity_id = target_id JOIN prop q ON q.relation_id = r.relation_id AND q.property_key = 'quantity'
WHERE r.relation_type = 'supplies' AND r.deprecated_at IS NULL AND s.deprecated_at IS NULL AND p.deprecated_at IS NULL AND s.entity_type = 'supplier' AND p.entity_type = 'part'
AND q.value_number >= 150 AND r.confidence > 0.5 ORDER BY r.confidence DESC, r.relation_id LIMIT 1000""")
def gpq_edges(spark, d):
    """A pattern of one relation with a typed property."""
    return gpq.execute(gpq.parse(_EDGES), entities(spark, d), relations(spark, d), properties(spark, d))


@query(f"""WITH RECURSIVE {ENTITIES}, {RELATIONS}, {LIVE}, hop AS (
  SELECT target_id AS node, 1 AS depth FROM live WHERE source_id = (SELECT min(entity_id) FROM ent WHERE entity_type = 'supplier' AND name = (SELECT s_name FROM supplier WHERE s_suppkey = 2)) AND relation_type IN ('based_in', 'part_of')
  UNION SELECT l.target_id, h.depth + 1 FROM hop h JOIN live l ON l.source_id = h.node WHERE relation_type IN ('based_in', 'part_of') AND h.depth < 3
) SELECT node AS "x.entity_id", name AS "x.name", depth FROM hop JOIN ent ON entity_id = node""")
def gpq_hops(spark, d):
    """A pattern of one to three hops from a named supplier."""
    name = t(spark, d, "supplier").where("s_suppkey = 2").first()["s_name"]
    text = f"""WORKSPACE trade
MATCH (s:supplier {{name: "{name}"}})-[r]->(x)
WHERE r.relation_type IN ("based_in", "part_of")
HOPS 1..3
PROJECT x.entity_id, x.name
LIMIT 100"""
    return gpq.execute(gpq.parse(text), entities(spark, d), relations(spark, d))


# --- look-ups ----------------------------------------------------------------------------------------------------


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE} SELECT relation_id, target_id FROM live
WHERE relation_type = 'supplies' AND source_id IN (SELECT entity_id FROM ent WHERE deprecated_at IS NULL AND name = (SELECT s_name FROM supplier WHERE s_suppkey = 3))""")
def graph_relations_by_name(spark, d):
    """What a named supplier supplies."""
    name = t(spark, d, "supplier").where("s_suppkey = 3").first()["s_name"]
    return g.find_relations_by_names(entities(spark, d), relations(spark, d), name, None, "supplies").select("relation_id", "target_id")


@query(f"""SELECT 3 * {KIND} + o_custkey AS entity_id, o_orderkey AS doc_id, 1 AS table_id, o_orderpriority AS role, max(CASE WHEN o_orderstatus = 'F' THEN 0.9 ELSE 0.5 END) AS confidence
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def graph_entity_documents(spark, d):
    """The orders of the customers of a segment as their documents."""
    links = t(spark, d, "orders").select(
        (F.lit(3 * KIND) + F.col("o_custkey")).alias("entity_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("table_id"), F.col("o_orderpriority").alias("role"),
        F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.5).alias("confidence"),
    )
    wanted = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select((F.lit(3 * KIND) + F.col("c_custkey")).alias("entity_id"))
    return g.entity_documents(links, wanted, 1)


@query(f"""WITH {RELATIONS}, {LIVE}, {PROPERTIES} SELECT target_id, relation_type, count(value_number) AS n, sum(value_number) AS total
FROM live JOIN prop USING (relation_id) WHERE property_key = 'quantity' GROUP BY ALL""")
def graph_property_sums(spark, d):
    """The quantity of each part over its suppliers."""
    return g.property_sums(properties(spark, d), relations(spark, d), "quantity")


@query(f"""WITH {RELATIONS}, {PROPERTIES} SELECT relation_id, property_key, value_text, value_number FROM prop WHERE relation_id IN (SELECT relation_id FROM rel WHERE confidence >= 0.5)""")
def graph_project_properties(spark, d):
    """Properties of the relations that exist in a derived graph."""
    kept = relations(spark, d).where("confidence >= 0.5")
    return g.project_properties(properties(spark, d), kept).select("relation_id", "property_key", "value_text", "value_number")


@query("""SELECT DISTINCT lower(trim(column_name)) AS term, table_id AS entity_id, 0.5 AS confidence FROM column_semantics
WHERE lower(trim(column_name)) IN ('status', 'amount', 'owner_name') AND table_id IN (SELECT table_id FROM table_semantics WHERE deleted_at IS NULL)""")
def graph_resolve_terms(spark, d):
    """Tables by exact aliases: the names of their columns."""
    named = t(spark, d, "column_semantics").select(F.lower(F.trim("column_name")).alias("term"), F.col("table_id").alias("entity_id"), F.lit(0.5).alias("confidence")).distinct()
    tables = t(spark, d, "table_semantics").select(F.col("table_id").alias("entity_id"), F.col("deleted_at").alias("deprecated_at"))
    return g.resolve_terms(named, tables, ["status", "amount", "owner_name"], 0.4)


@query(f"""WITH {ENTITIES}, {RELATIONS}, {LIVE} SELECT relation_id FROM live WHERE source_id NOT IN (SELECT entity_id FROM ent WHERE starts_with(name, 'Supplier#00000000'))
AND target_id NOT IN (SELECT entity_id FROM ent WHERE starts_with(name, 'Supplier#00000000')) AND relation_type IN ('based_in', 'supplies')""")
def graph_cleanup(spark, d):
    """The supplies that are left when the entities of a name's prefix are removed."""
    _, kept = g.remove_entities(entities(spark, d), relations(spark, d), "Supplier#00000000")
    return kept.where("relation_type in ('based_in', 'supplies') and deprecated_at is null").select("relation_id")
