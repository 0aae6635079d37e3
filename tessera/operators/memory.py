"""Memory operators: the proposition line format, ranking and packing of projections, next hops, agents' projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import ascii_lower

# The types of projections with aliases, rank bias, pack priority, next-hop multiplier, structured.
PROJECTION_TYPES = [
    ("FACT", ["canonical", "proposition"], 1.3, 1, 1.2, True),
    ("GOAL", ["canonical", "proposition"], 1.2, 1, 1.1, True),
    ("CONSTRAINT", ["proposition"], 1.0, 2, 1.0, True),
    ("STEP", ["proposition"], 0.9, 2, 0.9, True),
    ("NOTE", ["raw"], 0.7, 3, 0.6, False),
]
# What holds for other types, the priority of types that are only aliases, and the priors of record types.
DEFAULT_BIAS, DEFAULT_PRIORITY, DEFAULT_MULTIPLIER = 0.9, 100, 0.8
LEGACY_PRIORITY = {"canonical": 1, "proposition": 2, "raw": 3}
RECORD_PRIOR = {"fact": 1.2, "goal": 1.1, "constraint": 1.0, "edge": 0.95, "step": 0.9}
OTHER_PRIOR = 0.8
NODE_KEYS = ("subject", "object", "from", "to", "id")
TYPE_SCHEMA = "type_name string, aliases array<string>, rank_bias double, pack_priority int, next_hop_multiplier double, structured boolean"


def projection_types(spark: SparkSession) -> DataFrame:
    """The seed rows of the type policy; a handful of rows, broadcast by the joins below."""
    return spark.createDataFrame(PROJECTION_TYPES, TYPE_SCHEMA)


# --- propositions ------------------------------------------------------------------------------------------------


def parse_line(line: Column) -> Column:
    """struct(record_type, fields): a line 'type|key=value|...' trimmed; null without a bar or a type.

    Of a key that occurs twice the last value counts; segments without '=' or with an empty key are left out.
    """
    text = F.regexp_replace(line, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    kind = F.trim(F.substring_index(text, "|", 1))
    parts = F.transform(F.slice(F.split(text, r"\|"), F.lit(2), F.greatest(F.size(F.split(text, r"\|")) - 1, F.lit(0))), lambda s: F.trim(s))
    keyed = F.filter(parts, lambda s: F.instr(s, "=") > 1)
    pairs = F.transform(keyed, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^=]*=", "")).alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    record = F.struct(kind.alias("record_type"), last.alias("fields"))
    return F.when((F.instr(text, "|") > 0) & (kind != ""), record)


def records(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_no, record_type, fields, prior, confidence): all proposition lines of the contents."""
    lines = rows.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    parsed = lines.withColumn("r", parse_line(F.col("line"))).where("r is not null")
    return parsed.select(
        key,
        "line_no",
        "r.record_type",
        "r.fields",
        type_prior(F.col("r.record_type")).alias("prior"),
        F.coalesce(F.col("r.fields")["conf"].try_cast("double"), F.col("r.fields")["confidence"].try_cast("double"), F.lit(1.0)).alias("confidence"),
    )


def first_record(content: Column) -> Column:
    """The first line of a content that is a proposition."""
    return F.get(F.filter(F.transform(F.split(content, "\n"), parse_line), lambda r: r.isNotNull()), F.lit(0))


def type_prior(record_type: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(record_type == kv[0], kv[1]), RECORD_PRIOR.items(), F).otherwise(OTHER_PRIOR)


# --- projections of a user's memory ------------------------------------------------------------------------------


def _contains(text: Column, query: str) -> Column:
    """Whether a text has the query, ASCII letters in any case; an empty query is in every text."""
    return F.contains(ascii_lower(F.coalesce(text, F.lit(""))), ascii_lower(F.lit(query)))


def matches_scope(scope: str | None, *texts: str) -> Column:
    """Whether any of the columns has the scope, with or without its 'player:' prefix; no scope matches all."""
    if not scope:
        return F.lit(True)
    bare = scope.removeprefix("player:")
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(s)) for c in texts for s in {scope, bare}])


def _with_policy(rows: DataFrame, types: DataFrame) -> DataFrame:
    policy = types.withColumn("_t", F.upper("type_name")).select("_t", "aliases", "rank_bias", "pack_priority", "next_hop_multiplier", "structured")
    return rows.withColumn("_t", F.upper("projection_type")).join(policy, "_t", "left").drop("_t")


def type_matches(requested: list[str] | None) -> Column:
    """Whether a row's type, or one of its aliases, is requested (any case); nothing requested matches all."""
    if not requested:
        return F.lit(True)
    wanted = [x.lower() for x in requested]
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).isin(*wanted))
    return F.lower("projection_type").isin(*wanted) | alias


def rank(projections: DataFrame, types: DataFrame, user: str, query: str = "", requested: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """(id, projection_type, content, score) of a user's projections, best first, ties by id.

    score = bias + confidence + hint for an empty query, else bias + confidence + hint / 2 for contents that have the
    query; what scores 0 or less is left out.
    """
    rows = _with_policy(projections.where((F.col("user_id") == user) & _contains(F.col("content"), query)), types).where(type_matches(requested))
    hint = F.coalesce("rank_hint", F.lit(0.0)) * (1.0 if query == "" else 0.5)
    score = F.coalesce("rank_bias", F.lit(DEFAULT_BIAS)) + F.coalesce("confidence", F.lit(0.0)) + hint
    out = rows.select("id", "projection_type", "content", score.alias("score")).where("score > 0")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def pack_context(projections: DataFrame, types: DataFrame, user: str, query: str = "", scope: str | None = None, limit: int | None = 20) -> DataFrame:
    """(id, projection_type, content, priority, rank_hint): what to pack, by priority, hint (null last), id.

    Only known types, or those that are just aliases of them, are packed.
    """
    rows = projections.where((F.col("user_id") == user) & _contains(F.col("content"), query) & matches_scope(scope, "metadata_json", "facets_json"))
    legacy = reduce(lambda acc, kv: acc.when(F.lower("projection_type") == kv[0], kv[1]), LEGACY_PRIORITY.items(), F)
    out = _with_policy(rows, types).withColumn("priority", F.coalesce("pack_priority", legacy)).where("priority is not null")
    out = out.select("id", "projection_type", "content", "priority", "rank_hint")
    return out if limit is None else out.orderBy("priority", F.desc(F.coalesce("rank_hint", F.lit(-1e9))), "id").limit(limit)


def next_hops(edges: DataFrame, projections: DataFrame, types: DataFrame, user: str, seeds: list[str], limit: int | None = 20) -> DataFrame:
    """(node, score): where to go from the seeds, best first, ties by node.

    An edge gives its weight forwards and 0.8 of it backwards. A projection whose first proposition names a seed gives
    each other node it names its confidence times the multiplier of its type, if that is structured, else times the
    prior of the proposition.
    """
    own = edges.where(F.col("user_id") == user)
    ahead = own.where(F.col("node_from").isin(*seeds)).select(F.col("node_to").alias("node"), F.col("weight").alias("s"))
    back = own.where(F.col("node_to").isin(*seeds)).select(F.col("node_from").alias("node"), (F.col("weight") * 0.8).alias("s"))
    rows = _with_policy(projections.where(F.col("user_id") == user), types).withColumn("r", first_record(F.col("content"))).where("r is not null")
    nodes = F.filter(F.array(*[F.col("r.fields")[k] for k in NODE_KEYS]), lambda x: x.isNotNull())
    factor = F.when(F.col("structured"), F.col("next_hop_multiplier")).otherwise(type_prior(F.col("r.record_type")))
    rows = rows.select(nodes.alias("nodes"), (F.col("confidence") * factor).alias("s"))
    named = rows.select("nodes", "s", F.explode(F.array(*[F.lit(x) for x in seeds])).alias("seed")).where(F.array_contains("nodes", F.col("seed")))
    other = named.select("seed", "s", F.explode("nodes").alias("node")).where("node != seed").select("node", "s")
    out = ahead.unionByName(back).unionByName(other).groupBy("node").agg(F.sum("s").alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "node").limit(limit)


# --- projections of agents ---------------------------------------------------------------------------------------

_AGENT = ["id", "agent_id", "scope", "proj_type", "content", "weight", "source_ref", "source_type", "status"]


def live_projections(
    projections: DataFrame, agent: str, workspace: str | None = None, query: str = "", source_refs: list[str] | None = None
) -> DataFrame:
    """An agent's active or blocking projections that lie in the workspace, have the query and one of the sources.

    The scope is null, the workspace itself, or begins with the workspace and a colon; no workspace takes all.
    """
    out = projections.where((F.col("agent_id") == agent) & F.col("status").isin("active", "blocking") & _contains(F.col("content"), query))
    if workspace is not None:
        out = out.where(F.col("scope").isNull() | (F.col("scope") == workspace) | F.col("scope").startswith(workspace + ":"))
    if source_refs is not None:
        out = out.where(F.col("source_ref").isin(*source_refs) if source_refs else F.lit(False))
    return out.select(*_AGENT)


def materialize_projections(projections: DataFrame, agent: str, limit: int = 20, **options) -> DataFrame:
    """live_projections() by weight, then id."""
    return live_projections(projections, agent, **options).orderBy(F.desc("weight"), "id").limit(limit)


def materialize_pack(projections: DataFrame, agent: str, limit: int = 20, **options) -> DataFrame:
    """live_projections() with constraints first, then by weight and id."""
    return live_projections(projections, agent, **options).orderBy((F.col("proj_type") != "CONSTRAINT").cast("int"), F.desc("weight"), "id").limit(limit)


def materialize_relevance(projections: DataFrame, agent: str, entity: str, query: str, limit: int | None = 20, **options) -> DataFrame:
    """(id, proj_type, content, weight, score): the weight where the content names the entity, else 0.6 of it for the query."""
    rows = live_projections(projections, agent, **options)
    score = F.when(_contains(F.col("content"), entity) & F.lit(entity != ""), F.col("weight")).when(
        _contains(F.col("content"), query) & F.lit(query != ""), F.col("weight") * 0.6
    )
    out = rows.select("id", "proj_type", "content", "weight", score.alias("score")).where("score is not null")
    return out if limit is None else out.orderBy(F.desc("score"), F.desc("weight"), "id").limit(limit)


def projection_relevance(projections: DataFrame, agent: str, entity: str, query: str, **options) -> DataFrame:
    """(relevance): the sum of materialize_relevance()'s scores, 0 without any."""
    every = materialize_relevance(projections, agent, entity, query, None, **options)
    return every.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("relevance"))
