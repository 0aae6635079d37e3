"""Graph pattern queries: a line language over entities and relations, parsed by the driver and run as DataFrame plans.

    WORKSPACE <id>
    MATCH (v:type {name: 'x'})              or   MATCH (a:type)-[r:type]->(b:type)
    WHERE / AND <var>.<path> <op> <value>    op: = > >= < <= IN; values: numbers, quoted text, (list) for IN
    HOPS 1..n                                directed walks; needs a named source and r.relation_type IN (...)
    PROJECT <var>.<path>, ...                or   PROJECT BUNDLE projection_get
    LIMIT <1..1000>                          100 unless given

Entity paths: entity_id, entity_type, name, confidence, metadata.<key>; relation paths: relation_id, relation_type,
confidence, metadata.<key>, prop.<key>. A number never equals a JSON text, nor a text a JSON number. Anything the language
hasn't raises ValueError; nothing is silently left out.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*(?:\{\s*name\s*:\s*(?:'([^']*)'|\"([^\"]*)\")\s*\})?\s*\)"
_MATCH_NODE = re.compile(_NODE)
_MATCH_EDGE = re.compile(_NODE + r"\s*-\s*\[\s*(\w+)\s*(?::\s*(\w+))?\s*\]\s*->\s*" + _NODE)
_TEST = re.compile(r"(\w+)\.([\w.]+)\s*(>=|<=|=|>|<|IN\b)\s*(.+)", re.IGNORECASE)
_ITEM = re.compile(r"'([^']*)'|\"([^\"]*)\"")
ENTITY_PATHS = ("entity_id", "entity_type", "name", "confidence")
RELATION_PATHS = ("relation_id", "relation_type", "confidence")


@dataclass
class Node:
    var: str
    type: str | None = None
    name: str | None = None


@dataclass
class Edge:
    source: Node
    var: str
    type: str | None
    target: Node


@dataclass
class Test:
    var: str
    path: str
    op: str
    value: object


@dataclass
class Query:
    workspace: str
    match: Node | Edge
    tests: list[Test] = field(default_factory=list)
    project: list[tuple[str, str]] = field(default_factory=list)
    bundle: bool = False
    limit: int = 100
    hops: tuple[int, int] | None = None


def _value(text: str):
    text = text.strip()
    if m := _ITEM.fullmatch(text):
        return m[1] if m[1] is not None else m[2]
    try:
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
    except ValueError:
        raise ValueError(f"not a value: {text}") from None


def _test(text: str) -> Test:
    m = _TEST.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a predicate: {text}")
    op = m[3].upper()
    if op == "IN":
        body = m[4].strip()
        if not (body.startswith("(") and body.endswith(")")):
            raise ValueError(f"IN needs a list: {text}")
        value: object = [_value(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s]+", body[1:-1])]
        if not value:
            raise ValueError("IN needs at least one value")
    else:
        value = _value(m[4])
    return Test(m[1], m[2], op, value)


def parse(text: str) -> Query:
    """The query that a text has; raises ValueError for what the language hasn't."""
    q = Query("", Node(""))
    seen = set()
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            continue
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        seen.add(word)
        if word == "WORKSPACE":
            q.workspace = rest
        elif word == "MATCH":
            if m := _MATCH_EDGE.fullmatch(rest):
                g = m.groups()
                q.match = Edge(Node(g[0], g[1], g[2] or g[3]), g[4], g[5], Node(g[6], g[7], g[8] or g[9]))
            elif m := _MATCH_NODE.fullmatch(rest):
                q.match = Node(m[1], m[2], m[3] or m[4])
            else:
                raise ValueError(f"not a pattern: {rest}")
        elif word in ("WHERE", "AND"):
            q.tests.append(_test(rest))
        elif word == "PROJECT" and rest.startswith("BUNDLE "):
            if rest[7:].strip() != "projection_get":
                raise ValueError("the only bundle is projection_get")
            q.bundle = True
        elif word == "PROJECT":
            for f in rest.split(","):
                var, dot, path = f.strip().partition(".")
                if not dot or not path:
                    raise ValueError(f"not a field: {f}")
                q.project.append((var, path))
        elif word == "LIMIT":
            q.limit = int(rest) if rest.isdigit() else 0
            if not 1 <= q.limit <= 1000:
                raise ValueError("the limit must be from 1 to 1000")
        elif word == "HOPS":
            m = re.fullmatch(r"(\d+)\.\.(\d+)", rest)
            if not m or not 1 <= int(m[1]) <= int(m[2]):
                raise ValueError("hops must be given as low..high")
            q.hops = int(m[1]), int(m[2])
        else:
            raise ValueError(f"not a clause: {line}")
    for need in ("WORKSPACE", "MATCH", "PROJECT"):
        if need not in seen:
            raise ValueError(f"{need} is missing")
    _validate(q)
    return q


def _roles(q: Query) -> dict[str, str]:
    if isinstance(q.match, Node):
        return {q.match.var: "node"}
    return {q.match.source.var: "source", q.match.var: "relation", q.match.target.var: "target"}


def _validate(q: Query) -> None:
    roles = _roles(q)
    for var, path in [(t.var, t.path) for t in q.tests] + q.project:
        if var not in roles:
            raise ValueError(f"unknown variable {var}")
        known = RELATION_PATHS if roles[var] == "relation" else ENTITY_PATHS
        free = ("metadata.", "prop.") if roles[var] == "relation" else ("metadata.",)
        if path not in known and not path.startswith(free):
            raise ValueError(f"unknown path {var}.{path}")
    if q.hops:
        if isinstance(q.match, Node) or q.match.source.name is None or q.hops[0] != 1:
            raise ValueError("HOPS needs a relation, a named source and 1 as its low end")
        only = [t for t in q.tests if t.var == q.match.var and t.path == "relation_type" and t.op == "IN"]
        if len(only) != 1 or len(q.tests) != 1:
            raise ValueError("HOPS needs relation_type IN (...) of the relation, and no other predicate")
        if any(var != q.match.target.var for var, _ in q.project):
            raise ValueError("with HOPS only the target can be projected")
    elif any(t.op == "IN" for t in q.tests):
        raise ValueError("IN is for relation_type with HOPS")
    if q.bundle and not (isinstance(q.match, Node) and any(t.path == "metadata.projection_id" and t.op == "=" for t in q.tests)):
        raise ValueError("the bundle needs one node and its metadata.projection_id")


def to_ast(q: Query) -> str:
    """The query as canonical JSON."""
    node = lambda n: {"kind": "node", "var": n.var, "type": n.type} | ({"name": n.name} if n.name is not None else {})
    if isinstance(q.match, Node):
        match = [node(q.match)]
    else:
        match = [node(q.match.source), {"kind": "edge", "var": q.match.var, "type": q.match.type, "direction": "out"}, node(q.match.target)]
    key = lambda v: "value_list" if isinstance(v, list) else "value" if isinstance(v, str) else "value_integer" if isinstance(v, int) else "value_number"
    out = {
        "workspace_id": q.workspace,
        "match": match,
        "where": [{"path": f"{t.var}.{t.path}", "op": t.op, key(t.value): t.value} for t in q.tests],
        "project": {"bundle": "projection_get"} if q.bundle else [f"{v}.{p}" for v, p in q.project],
        "limit": q.limit,
    }
    if q.hops:
        out["hops"] = {"min": q.hops[0], "max": q.hops[1]}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _json_test(document: Column, key: str, op: str, value) -> Column:
    """A typed test of a JSON field: a text only meets JSON texts, a number only JSON numbers."""
    got = F.get_json_object(document, f"$.{key}")
    variant = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    is_text = F.schema_of_variant(variant) == "STRING"
    if isinstance(value, str):
        return is_text & _compare(got, op, F.lit(value))
    return ~is_text & _compare(got.try_cast("double"), op, F.lit(float(value)))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _condition(t: Test, prefix: str) -> Column:
    if t.path.startswith("metadata."):
        return _json_test(F.col(f"{prefix}metadata_json"), t.path[9:], t.op, t.value)
    return _compare(F.col(f"{prefix}{t.path}"), t.op, F.lit(t.value))


def _field(path: str, prefix: str) -> Column:
    if path.startswith("metadata."):
        return F.get_json_object(F.col(f"{prefix}metadata_json"), f"$.{path[9:]}")
    return F.col(f"{prefix}{path}")


def _prefixed(df: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    have = [c for c in (*columns, "metadata_json") if c in df.columns]
    return df.select(*[F.col(c).alias(prefix + c) for c in have])


def _nodes(entities: DataFrame, n: Node, prefix: str, tests: list[Test]) -> DataFrame:
    live = entities.where(F.col("deprecated_at").isNull())
    if n.type is not None:
        live = live.where(F.col("entity_type") == n.type)
    if n.name is not None:
        live = live.where(F.col("name") == n.name)
    out = _prefixed(live, prefix, ENTITY_PATHS)
    for t in tests:
        out = out.where(_condition(t, prefix))
    return out


def _property(t: Test) -> Column:
    number = F.coalesce(F.col("value_number"), F.col("value_integer").cast("double"))
    return _compare(F.col("value_text"), t.op, F.lit(t.value)) if isinstance(t.value, str) else _compare(number, t.op, F.lit(float(t.value)))


def execute(q: Query, entities: DataFrame, relations: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """The result of a query, one column per projected field (named 'var.path'), HOPS with their depth.

    Rows come by confidence and id, with HOPS by depth and id. Where the tables have a workspace_id, only rows of
    the query's workspace take part. Predicates reach the scans of the sides they are about before the joins.
    """
    scope = lambda df: df.where(F.col("workspace_id") == q.workspace) if "workspace_id" in df.columns else df
    entities, relations = scope(entities), scope(relations)
    of = lambda var: [t for t in q.tests if t.var == var]
    if isinstance(q.match, Node):
        found = _nodes(entities, q.match, "n_", of(q.match.var))
        found = found.orderBy(F.desc("n_confidence"), "n_entity_id").limit(q.limit)
        if q.bundle:
            return found.select(*[F.col(c).alias(c[2:]) for c in found.columns])
        return found.select(*[_field(p, "n_").alias(f"{v}.{p}") for v, p in q.project])
    e = q.match
    live = relations.where(F.col("deprecated_at").isNull())
    if q.hops:
        return _hops(q, entities, live)
    if e.type is not None:
        live = live.where(F.col("relation_type") == e.type)
    edge = live.select("source_id", "target_id", *[F.col(c).alias("r_" + c) for c in (*RELATION_PATHS, "metadata_json") if c in live.columns])
    for t in of(e.var):
        if t.path.startswith("prop."):
            if properties is None:
                raise ValueError("prop paths need the table of properties")
            hit = properties.where((F.col("property_key") == t.path[5:]) & _property(t)).select(F.col("relation_id").alias("r_relation_id"))
            edge = edge.join(hit, "r_relation_id", "left_semi")
        else:
            edge = edge.where(_condition(t, "r_"))
    out = edge.join(_nodes(entities, e.source, "s_", of(e.source.var)), F.col("source_id") == F.col("s_entity_id"))
    out = out.join(_nodes(entities, e.target, "t_", of(e.target.var)), F.col("target_id") == F.col("t_entity_id"))
    out = out.orderBy(F.desc("r_confidence"), "r_relation_id").limit(q.limit)
    prefix = {e.source.var: "s_", e.var: "r_", e.target.var: "t_"}
    wanted = sorted({p[5:] for v, p in q.project if v == e.var and p.startswith("prop.")})
    for i, key in enumerate(wanted):
        value = F.coalesce(F.col("value_number"), F.col("value_integer").cast("double"))
        p = properties.where(F.col("property_key") == key).select(
            F.col("relation_id").alias("r_relation_id"),
            (value if _numeric(q, e.var, key) else F.coalesce(F.col("value_text"), value.cast("string"))).alias(f"p_{i}"),
        )
        out = out.join(p, "r_relation_id", "left")
    pick = lambda v, p: F.col(f"p_{wanted.index(p[5:])}") if v == e.var and p.startswith("prop.") else _field(p, prefix[v])
    return out.select(*[pick(v, p).alias(f"{v}.{p}") for v, p in q.project])


def _numeric(q: Query, var: str, key: str) -> bool:
    """Whether the query itself treats a property as a number."""
    return any(t.var == var and t.path == f"prop.{key}" and not isinstance(t.value, str) for t in q.tests)


def _hops(q: Query, entities: DataFrame, live: DataFrame) -> DataFrame:
    from .graph import dependencies

    e = q.match
    seed = _nodes(entities, e.source, "s_", []).agg(F.min("s_entity_id")).first()[0]
    types = q.tests[0].value
    found = dependencies(live, seed if seed is not None else -1, types, q.hops[1]).select("entity_id", "depth").distinct()
    nodes = _prefixed(entities.where(F.col("deprecated_at").isNull()), "t_", ENTITY_PATHS)
    out = found.join(nodes, F.col("entity_id") == F.col("t_entity_id")).orderBy("depth", "entity_id").limit(q.limit)
    return out.select(*[_field(p, "t_").alias(f"{v}.{p}") for v, p in q.project], "depth")
