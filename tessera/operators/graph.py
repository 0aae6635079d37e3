"""Property graph operators over two DataFrames.

entities: entity_id, entity_type, name, confidence, metadata_json, deprecated_at (and any more columns);
relations: relation_id, relation_type, source_id, target_id, valid_from, valid_to (epoch seconds), confidence, deprecated_at.
Deprecated rows take part only with ``include_deprecated``. Traversals are loops over joins in which only the frontier
meets the edges; each round's frontier is written to the shared folder, so the lineage stays short and a lost executor
costs no more than one round. Every result has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import blocked_lists, materialize
from .search import ascii_lower, pure_tokens


@dataclass
class EdgeFilter:
    """Which relations take part. ``valid_after`` drops those that ended before it, ``valid_before`` those that begin
    after it (null ends are open). ``properties`` are (key, op, value...) on relation_properties, all of which must hold.
    ``doc_types`` and ``jurisdictions`` are taken and have no effect, as relations carry neither."""

    types: list[str] | None = None
    confidence_min: float | None = None
    confidence_max: float | None = None
    valid_after: int | None = None
    valid_before: int | None = None
    include_deprecated: bool = False
    properties: list[tuple] = field(default_factory=list)
    doc_types: list[str] | None = None
    jurisdictions: list[str] | None = None


def property_predicate(op: str, *values) -> Column:
    """A test of a typed property: exists, eq, lt, lte, gt, gte, between, in_text."""
    number = F.coalesce(F.col("value_number"), F.col("value_integer").cast("double"))
    if op == "exists":
        return F.lit(True)
    if op == "in_text":
        return F.col("value_text").isin(*values)
    if op == "between":
        return number.between(values[0], values[1])
    if op == "eq":
        return F.col("value_text") == values[0] if isinstance(values[0], str) else number == values[0]
    tests = {"lt": number < values[0], "lte": number <= values[0], "gt": number > values[0], "gte": number >= values[0]}
    if op not in tests:
        raise ValueError(f"unknown property operator {op}")
    return tests[op]


def filter_edges(relations: DataFrame, f: EdgeFilter | None = None, properties: DataFrame | None = None) -> DataFrame:
    """The relations that pass the filter; property predicates are semi-joins with ``properties``."""
    f = f or EdgeFilter()
    keep = [F.lit(True)]
    if f.types is not None:
        keep.append(F.col("relation_type").isin(*f.types) if f.types else F.lit(False))
    if f.confidence_min is not None:
        keep.append(F.col("confidence") >= f.confidence_min)
    if f.confidence_max is not None:
        keep.append(F.col("confidence") <= f.confidence_max)
    if f.valid_after is not None:
        keep.append(F.col("valid_to").isNull() | (F.col("valid_to") >= f.valid_after))
    if f.valid_before is not None:
        keep.append(F.col("valid_from").isNull() | (F.col("valid_from") <= f.valid_before))
    if not f.include_deprecated:
        keep.append(F.col("deprecated_at").isNull())
    out = relations.where(reduce(lambda a, b: a & b, keep))
    for key, op, *values in f.properties:
        if properties is None:
            raise ValueError("property predicates need the table of properties")
        hit = properties.where((F.col("property_key") == key) & property_predicate(op, *values))
        out = out.join(hit.select("relation_id"), "relation_id", "left_semi")
    return out


def sort_by_property(relations: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Relations with the property's number as sort_value, to be ordered by it (nulls last), then relation_id."""
    p = properties.where(F.col("property_key") == key).select(
        "relation_id", F.coalesce("value_number", F.col("value_integer").cast("double")).alias("sort_value")
    )
    return relations.join(p, "relation_id", "left").orderBy(F.asc_nulls_last("sort_value"), "relation_id")


def steps(relations: DataFrame, direction: str = "both") -> DataFrame:
    """(here, there, relation_id): the relations as steps, 'outbound', 'inbound' or 'both'."""
    out = relations.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "relation_id")
    back = relations.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "relation_id")
    if direction == "outbound":
        return out
    if direction == "inbound":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(f"unknown direction {direction}")


def bfs(seeds: DataFrame, moves: DataFrame, max_hops: int, target: int | None = None) -> DataFrame:
    """(node, depth, parent, relation_id) of all nodes within ``max_hops`` steps of the seeds (node), by levels.

    A node is reached at its least depth; its parent is the least (parent, relation_id) that reaches it then. With a
    target the search ends with the level that finds it. A hub's edges meet the frontier by a join on ``here``: a small
    frontier is broadcast by its known size, so that the edges aren't shuffled, a large one is joined by shuffle, where
    adaptive execution splits the hub. Each level is reduced to one row per node before it is written.
    """
    none = F.lit(None).cast("long")
    first = seeds.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth"), none.alias("parent"), none.alias("relation_id"))
    level, n = _level(first, True)
    levels = [level]
    for depth in range(1, max_hops + 1):
        if not n or (target is not None and not level.where(F.col("node") == target).isEmpty()):
            break
        seen = reduce(lambda a, b: a.unionByName(b), [x.select("node") for x in levels])
        level, n = _next_level(level, n, moves, seen, depth)
        if n:
            levels.append(level)
    return reduce(lambda a, b: a.unionByName(b), levels)


# Levels of up to so many nodes are kept by the driver (some 100 KB), others written to the shared folder.
SMALL_LEVEL = 4096


def _level(rows: DataFrame, small: bool) -> tuple[DataFrame, int]:
    """(level, its number of nodes). With ``small`` it is tried whether the driver can keep it, which saves the writing and gives the
    planner its size; if not, or without, it is written."""
    if small:
        kept = rows.limit(SMALL_LEVEL + 1).toArrow()
        if kept.num_rows <= SMALL_LEVEL:
            return rows.sparkSession.createDataFrame(kept, rows.schema), kept.num_rows
    written = materialize(rows, "bfs")
    return written, written.count()


def _next_level(level: DataFrame, n: int, moves: DataFrame, seen: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """The nodes one step beyond a level of ``n`` that aren't in ``seen`` (node), each with its least way, and their number."""
    found = level.select(F.col("node").alias("here")).join(moves, "here")
    found = found.groupBy(F.col("there").alias("node")).agg(F.min(F.struct("here", "relation_id")).alias("via"))
    fresh = found.join(seen, "node", "left_anti")
    fresh = fresh.select("node", F.lit(depth).alias("depth"), F.col("via.here").alias("parent"), F.col("via.relation_id").alias("relation_id"))
    return _level(fresh, n <= SMALL_LEVEL // 16)


def k_hops(relations: DataFrame, seeds: DataFrame, max_hops: int, f: EdgeFilter | None = None, properties=None, direction: str = "both") -> DataFrame:
    """(node, depth) of the seeds and all nodes within ``max_hops`` of them, on the undirected graph unless told otherwise."""
    return bfs(seeds, steps(filter_edges(relations, f, properties), direction), max_hops).select("node", "depth")


def shortest_path(relations: DataFrame, source: int, target: int, max_depth: int = 6, f: EdgeFilter | None = None) -> list[dict] | None:
    """The steps of a shortest undirected path ([] for source = target), or None if there is none within ``max_depth``.

    Searched from both ends, a level at a time on the side whose last level is smaller, until a level meets the other side's
    last one. Of several shortest paths it is one by the least ids that the levels keep. Only the levels' parents on
    the way back are read by the driver, one row per step.
    """
    if source == target:
        return []
    moves = steps(filter_edges(relations, f))
    none = F.lit(None).cast("long")
    first = relations.sparkSession.range(1)
    start = lambda i: first.select(F.lit(i).cast("long").alias("node"), F.lit(0).alias("depth"), none.alias("parent"), none.alias("relation_id"))
    sides = {"source": [start(source)], "target": [start(target)]}
    sizes = {"source": 1, "target": 1}
    for _ in range(max_depth):
        near = "source" if sizes["source"] <= sizes["target"] else "target"
        far = "target" if near == "source" else "source"
        tree = reduce(lambda a, b: a.unionByName(b), sides[near])
        level, sizes[near] = _next_level(sides[near][-1], sizes[near], moves, tree.select("node"), len(sides[near]))
        if not sizes[near]:
            return None
        sides[near].append(level)
        met = level.join(sides[far][-1].select("node"), "node", "left_semi").agg(F.min("node")).first()[0]
        if met is not None:
            break
    else:
        return None
    ahead, back = _way_back(sides["source"], met), _way_back(sides["target"], met)
    out = [(parent, node, rel) for node, parent, rel in ahead[::-1]] + [(node, parent, rel) for node, parent, rel in back]
    return [{"from": a, "to": b, "relation_id": rel, "depth": i + 1} for i, (a, b, rel) in enumerate(out)]


def _way_back(levels: list[DataFrame], node: int) -> list[tuple]:
    """(node, parent, relation_id) from a node of the last level to the root, one row read for each level."""
    out = []
    for level in levels[:0:-1]:
        row = level.where(F.col("node") == node).first()
        out.append((node, row["parent"], row["relation_id"]))
        node = row["parent"]
    return out


def shortest_path_hops(relations: DataFrame, source: int, target: int, max_depth: int = 6, f: EdgeFilter | None = None) -> int | None:
    """The number of steps of a shortest path, 0 for source = target, None without one."""
    path = shortest_path(relations, source, target, max_depth, f)
    return None if path is None else len(path)


def traverse(
    entities: DataFrame, relations: DataFrame, start: str, direction: str = "outbound", types: list[str] | None = None, depth: int = 3, target: str | None = None
) -> DataFrame:
    """(depth, node, name, parent, relation_id) of a directed search from the entity named ``start``.

    With a target name that is reached only the path to it comes out. An unknown start gives no rows.
    """
    live = entities.where(F.col("deprecated_at").isNull())
    by_name = lambda n: live.where(F.col("name") == n).agg(F.min("entity_id")).first()[0]
    first, goal = by_name(start), by_name(target) if target is not None else None
    spark = entities.sparkSession
    seeds = spark.createDataFrame([(first,)] if first is not None else [], "node long")
    tree = bfs(seeds, steps(filter_edges(relations, EdgeFilter(types=types)), direction), depth, goal)
    if goal is not None:
        tree = materialize(tree, "tree")
        path, at = [], goal
        while at is not None and (row := tree.where(F.col("node") == at).first()) is not None:
            path.append(at)
            at = row["parent"]
        if path:
            tree = tree.where(F.col("node").isin(*path))
    names = entities.select(F.col("entity_id").alias("node"), "name")
    return tree.join(names, "node", "left").select("depth", "node", "name", "parent", "relation_id")


def dependencies(relations: DataFrame, entity: int, types: list[str], max_depth: int = 5, min_confidence: float = 0.0) -> DataFrame:
    """(entity_id, relation_type, depth): all directed walks of the given types, repeated (id, type, depth) once."""
    edges = filter_edges(relations, EdgeFilter(types=types, confidence_min=min_confidence))
    edges = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("entity_id"), "relation_type")
    level = relations.sparkSession.createDataFrame([(entity,)], "here long")
    out = []
    for depth in range(1, max_depth + 1):
        found = materialize(level.join(edges, "here").select("entity_id", "relation_type").distinct(), "deps")
        if found.isEmpty():
            break
        out.append(found.withColumn("depth", F.lit(depth)))
        level = found.select(F.col("entity_id").alias("here")).distinct()
    empty = relations.select(F.col("target_id").alias("entity_id"), "relation_type", F.lit(0).alias("depth")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), out, empty)


def subgraph(relations: DataFrame, seeds: DataFrame, max_hops: int, f: EdgeFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth) and edges (relation_id, source_id, target_id, relation_type, depth) around the seeds.

    An edge belongs to the level that first walks over it; one with both ends in the last level isn't walked.
    """
    edges = filter_edges(relations, f)
    nodes = materialize(k_hops(edges, seeds, max_hops, EdgeFilter(include_deprecated=True)), "nodes")
    reached = nodes.where(F.col("depth") < max_hops).select(F.col("node").alias("here"), "depth")
    walked = steps(edges).join(reached, "here").groupBy("relation_id").agg((F.min("depth") + 1).alias("depth"))
    return nodes, walked.join(edges.select("relation_id", "source_id", "target_id", "relation_type"), "relation_id")


def subgraph_events(relations: DataFrame, seeds: DataFrame, max_hops: int, f: EdgeFilter | None = None) -> DataFrame:
    """(seq, kind, id, depth): the subgraph as a stream of seed_node, edge and node events and a last done event."""
    nodes, edges = subgraph(relations, seeds, max_hops, f)
    n = nodes.select(F.when(F.col("depth") == 0, "seed_node").otherwise("node").alias("kind"), F.col("node").alias("id"), "depth")
    e = edges.select(F.lit("edge").alias("kind"), F.col("relation_id").alias("id"), "depth")
    done = nodes.sparkSession.range(1).select(F.lit("done").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(max_hops + 1).alias("depth"))
    every = n.unionByName(e).unionByName(done)
    order = F.when(F.col("kind") == "edge", 0).otherwise(1)
    return every.withColumn("seq", F.struct("depth", order.alias("o"), "id")).orderBy("seq").select("kind", "id", "depth")


def neighbourhood(relations: DataFrame, entity: int, max_out: int = 20, max_in: int = 20, min_confidence: float = 0.0) -> DataFrame:
    """(direction, relation_id, relation_type, other_id, confidence): the strongest relations out of and into an entity."""
    edges = filter_edges(relations, EdgeFilter(confidence_min=min_confidence))
    pick = lambda side, other, name, n: (
        edges.where(F.col(side) == entity)
        .orderBy(F.desc("confidence"), "relation_id")
        .limit(n)
        .select(F.lit(name).alias("direction"), "relation_id", "relation_type", F.col(other).alias("other_id"), "confidence")
    )
    return pick("source_id", "target_id", "out", max_out).unionByName(pick("target_id", "source_id", "in", max_in))


def degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, out_degree, in_degree, total_degree) over live relations, zero-filled; hubs are pre-aggregated."""
    live = filter_edges(relations)
    ends = live.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias("entity_id")).agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    zero = F.lit(0).cast("long")
    return entities.select("entity_id").join(counts, "entity_id", "left").select(
        "entity_id",
        F.coalesce("o", zero).alias("out_degree"),
        F.coalesce("i", zero).alias("in_degree"),
        (F.coalesce("o", zero) + F.coalesce("i", zero)).alias("total_degree"),
    )


def adjacency(relations: DataFrame, block_size: int = 10_000) -> DataFrame:
    """(entity_id, direction, block, relation_ids): the sorted relations of each node, for stores that want them grouped.

    A hub's come in several blocks of about ``block_size`` relations at most, numbered from 0.
    """
    live = filter_edges(relations)
    out = live.select(F.col("source_id").alias("entity_id"), F.lit("out").alias("direction"), "relation_id")
    back = live.select(F.col("target_id").alias("entity_id"), F.lit("in").alias("direction"), "relation_id")
    return blocked_lists(out.unionByName(back), ["entity_id", "direction"], "relation_id", "relation_ids", block_size)


# --- entities ----------------------------------------------------------------------------------------------------


def find_entities(entities: DataFrame, entity_type: str | None = None, names: list[str] | None = None, metadata: dict | None = None, ids: list[int] | None = None) -> DataFrame:
    """The live entities of a type, with one of the names or ids, whose metadata has all pairs of ``metadata``."""
    out = entities.where(F.col("deprecated_at").isNull())
    if entity_type is not None:
        out = out.where(F.col("entity_type") == entity_type)
    if names is not None:
        out = out.where(F.col("name").isin(*names) if names else F.lit(False))
    if ids is not None:
        out = out.where(F.col("entity_id").isin(*ids) if ids else F.lit(False))
    for k, v in (metadata or {}).items():
        out = out.where(F.get_json_object("metadata_json", f"$.{k}") == str(v))
    return out


def get_entity(entities: DataFrame, **wanted) -> DataFrame:
    """find_entities() that raises KeyError when nothing is found."""
    out = find_entities(entities, **wanted)
    if out.isEmpty():
        raise KeyError(f"no entity {wanted}")
    return out


def entity_text_search(
    entities: DataFrame, query: str, types: list[str] | None = None, domain: str | None = None, min_confidence: float = 0.0, limit: int | None = 20
) -> DataFrame:
    """(entity_id, name, entity_type, confidence, rank): entities in which every token of the query occurs.

    Each token scores by the first field that has it: name 2, metadata 1, type or domain 0.5. All tokens in the name
    add 1, a name of just these tokens 0.5, any token scored by the metadata 0.25. Best first, then confidence, name.
    """
    live = entities.where(F.col("deprecated_at").isNull() & (F.col("confidence") >= min_confidence))
    if types is not None:
        live = live.where(F.col("entity_type").isin(*types))
    domain_of = F.get_json_object("metadata_json", "$.domain")
    if domain is not None:
        live = live.where(domain_of == domain)
    asked = list(dict.fromkeys(entities.sparkSession.range(1).select(pure_tokens(F.lit(query)).alias("t")).first()["t"]))
    if not asked:
        return live.select("entity_id", "name", "entity_type", "confidence", F.lit(0.0).alias("rank")).limit(0)
    none = F.array().cast("array<string>")
    live = live.withColumns(
        {
            "_n": F.coalesce(pure_tokens(F.col("name")), none),
            "_m": F.coalesce(pure_tokens(F.col("metadata_json")), none),
            "_t": F.coalesce(pure_tokens(F.col("entity_type")), none),
            "_d": F.coalesce(pure_tokens(domain_of), none),
        }
    )
    has = lambda f, q: F.array_contains(f, q)
    points = [
        F.when(has("_n", q), 2.0).when(has("_m", q), 1.0).when(has("_t", q), 0.5).when(has("_d", q), 0.5) for q in asked
    ]
    in_name = reduce(lambda a, b: a & b, [has("_n", q) for q in asked])
    by_meta = reduce(lambda a, b: a | b, [~has("_n", q) & has("_m", q) for q in asked])
    rank = reduce(lambda a, b: a + b, points) + F.when(in_name, 1.0).otherwise(0.0)
    rank = rank + F.when(F.col("_n") == F.array(*[F.lit(q) for q in asked]), 0.5).otherwise(0.0) + F.when(by_meta, 0.25).otherwise(0.0)
    found = live.withColumn("rank", rank).where(F.col("rank").isNotNull()).select("entity_id", "name", "entity_type", "confidence", "rank")
    return found if limit is None else found.orderBy(F.desc("rank"), F.desc("confidence"), "name", "entity_id").limit(limit)


def substring_search(entities: DataFrame, terms: list[str], limit: int | None = 20) -> DataFrame:
    """(entity_id, name, entity_type, score): 4 for each term in the name, 3 in the type, 1 in the metadata, any case.

    Without terms every live entity scores its confidence.
    """
    live = entities.where(F.col("deprecated_at").isNull())
    within = lambda c, q: F.contains(ascii_lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q.lower()))
    parts = [F.when(within(c, q), w).otherwise(0.0) for q in terms for c, w in (("name", 4.0), ("entity_type", 3.0), ("metadata_json", 1.0))]
    score = reduce(lambda a, b: a + b, parts) if parts else F.col("confidence")
    found = live.select("entity_id", "name", "entity_type", "confidence", score.alias("score")).where("score > 0")
    if limit is not None:
        found = found.orderBy(F.desc("score"), F.desc("confidence"), "entity_id").limit(limit)
    return found.drop("confidence")


def marketplace_search(
    entities: DataFrame, relations: DataFrame, query: str, types: list[str], max_hops: int = 2, min_confidence: float = 0.0, limit: int = 20, seeds: int | None = 200
) -> DataFrame:
    """(entity_id, name, composite, hub_score): search hits and what lies within ``max_hops`` of the ``seeds`` best of them.

    composite = (rank or 0.1) * confidence * (1.5 for a hit) * (1 + min(0.5, ln(degree + 1) / 8)); hub_score =
    min(1, ln(degree + 1) / 4). Degrees are counted for the entities found only. With ``seeds`` None every hit is one.
    """
    hits = materialize(entity_text_search(entities, query, min_confidence=min_confidence, limit=seeds), "seeds")
    near = k_hops(relations, hits.select(F.col("entity_id").alias("node")), max_hops, EdgeFilter(types=types)).select(F.col("node").alias("entity_id"))
    live = entities.where(F.col("deprecated_at").isNull() & (F.col("confidence") >= min_confidence))
    found = materialize(live.join(near, "entity_id", "left_semi").select("entity_id", "name", "confidence"), "near")
    ends = filter_edges(relations).select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    degree = ends.join(found.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("total_degree"))
    found = found.join(hits.select("entity_id", "rank"), "entity_id", "left").join(degree, "entity_id", "left").fillna(0, ["total_degree"])
    log = F.log1p(F.col("total_degree").cast("double"))
    composite = (
        F.coalesce("rank", F.lit(0.1)) * F.col("confidence") * F.when(F.col("rank").isNotNull(), 1.5).otherwise(1.0) * (1 + F.least(F.lit(0.5), log / 8))
    )
    out = found.select("entity_id", "name", composite.alias("composite"), F.least(F.lit(1.0), log / 4).alias("hub_score"))
    return out.orderBy(F.desc("composite"), "name", "entity_id").limit(limit)


def resolve_terms(aliases: DataFrame, entities: DataFrame, terms: list[str], min_confidence: float = 0.0) -> DataFrame:
    """(term, entity_id, confidence): live entities whose alias is exactly one of the terms."""
    hit = aliases.where(F.col("term").isin(*terms) & (F.col("confidence") >= min_confidence)) if terms else aliases.limit(0)
    return hit.join(entities.where(F.col("deprecated_at").isNull()).select("entity_id"), "entity_id", "left_semi").select("term", "entity_id", "confidence")


def confidence_decay(entities: DataFrame, touched: DataFrame, now: int, half_life_days: int = 90) -> DataFrame:
    """(entity_id, decayed): confidence * 0.5 ^ (age in days / half life) by the last success, 0.1 without one.

    ``touched`` has entity_id and at (epoch seconds) of successful runs; a half life of 0 is 90 days.
    """
    half = half_life_days or 90
    last = touched.groupBy("entity_id").agg(F.max("at").alias("at"))
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - F.col("at")) / 86400.0)
    decayed = F.col("confidence") * F.pow(F.lit(0.5), age / half)
    return entities.join(last, "entity_id", "left").select("entity_id", F.when(F.col("at").isNull(), 0.1).otherwise(decayed).alias("decayed"))


def schema_patterns(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_type, relation_type, target_type, n, n_sources, n_targets, last_valid_from): how often each pattern occurs."""
    kind = entities.select("entity_id", "entity_type")
    live = filter_edges(relations)
    both = live.join(kind.withColumnsRenamed({"entity_id": "source_id", "entity_type": "source_type"}), "source_id").join(
        kind.withColumnsRenamed({"entity_id": "target_id", "entity_type": "target_type"}), "target_id"
    )
    return both.groupBy("source_type", "relation_type", "target_type").agg(
        F.count("*").alias("n"),
        F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct("target_id").alias("n_targets"),
        F.max("valid_from").alias("last_valid_from"),
    )


def components(relations: DataFrame) -> DataFrame:
    """(node, component): the least node id of each connected component of the live undirected graph.

    Large-star and small-star rounds: each links all greater neighbours of a node to its least one, and all lesser ones
    to the least of them, until a round changes nothing, by the edges' number and the sum of their hashes. A round is one
    grouping for the minimum and one join back, so a hub is pre-aggregated and never gathered; the number of rounds
    grows with the logarithm of a component's size.
    """
    edges = filter_edges(relations).where("source_id != target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).distinct()
    edges = materialize(edges, "cc")
    nodes = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
    last = mark(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u != v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        low = small_in.groupBy("a").agg(F.min("b").alias("m"))
        small = small_in.join(low, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u != v")
        edges = materialize(small.union(low.select(F.col("m").alias("u"), F.col("a").alias("v"))).where("u != v").distinct(), "cc")
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


# --- look-ups and changes ----------------------------------------------------------------------------------------


def find_relations(
    relations: DataFrame, source: int | None = None, target: int | None = None, relation_type: str | None = None, include_deprecated: bool = False
) -> DataFrame:
    """The live relations with the given ends and type; what isn't given isn't asked."""
    out = relations if include_deprecated else relations.where(F.col("deprecated_at").isNull())
    for column, value in (("source_id", source), ("target_id", target), ("relation_type", relation_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def find_relations_by_names(entities: DataFrame, relations: DataFrame, source: str, target: str | None = None, relation_type: str | None = None) -> DataFrame:
    """find_relations() for live entities of the given names; every entity of a name counts."""
    named = lambda n, c: entities.where(F.col("deprecated_at").isNull() & (F.col("name") == n)).select(F.col("entity_id").alias(c))
    out = find_relations(relations, relation_type=relation_type).join(named(source, "source_id"), "source_id", "left_semi")
    return out if target is None else out.join(named(target, "target_id"), "target_id", "left_semi")


def entity_documents(links: DataFrame, entities: DataFrame, table_id: int | None = None) -> DataFrame:
    """The links (entity_id, doc_id, table_id, role, confidence) of the given entities (entity_id), once per key with the
    greatest confidence, of one table if it is given."""
    rows = links if table_id is None else links.where(F.col("table_id") == table_id)
    rows = rows.join(entities.select("entity_id"), "entity_id", "left_semi")
    return rows.groupBy("entity_id", "doc_id", "table_id", "role").agg(F.max("confidence").alias("confidence"))


def project_properties(properties: DataFrame, relations: DataFrame) -> DataFrame:
    """The properties whose relation exists, once per relation and key (the greatest row counts)."""
    key = ["relation_id", "property_key"]
    rest = [c for c in properties.columns if c not in key]
    kept = properties.join(relations.select("relation_id"), "relation_id", "left_semi")
    one = kept.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r"))
    return one.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def property_sums(properties: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(target_id, relation_type, n, total): a numeric property summed over the live relations into each target."""
    p = properties.where(F.col("property_key") == key).select("relation_id", F.coalesce("value_number", F.col("value_integer").cast("double")).alias("v"))
    return filter_edges(relations).join(p, "relation_id").groupBy("target_id", "relation_type").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


def deprecate(rows: DataFrame, key: str, ids: list[int], at: int) -> DataFrame:
    """``rows`` with those of the given ids deprecated at a time; what is deprecated already keeps its time."""
    hit = F.col(key).isin(*ids) if ids else F.lit(False)
    return rows.withColumn("deprecated_at", F.coalesce("deprecated_at", F.when(hit, F.lit(at).cast("long"))))


def remove_entities(entities: DataFrame, relations: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Entities without those whose name begins with ``prefix``, and relations without those at them."""
    if not prefix:
        raise ValueError("an empty prefix would remove everything")
    gone = entities.where(F.startswith("name", F.lit(prefix))).select("entity_id")
    kept = relations.join(gone.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti").join(
        gone.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti"
    )
    return entities.join(gone, "entity_id", "left_anti"), kept.select(*relations.columns)
