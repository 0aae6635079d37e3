"""LinkML schemas: a subset of YAML, compiled to ontology tables and back. Schemas are small and read by the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parse_yaml(text: str):
    """Block maps, block and flow lists, scalars and comments; nothing else of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        s = s.split(" #")[0].strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if s in ("", "null", "~"):
            return None
        if s in ("{}",):
            return {}
        if s in ("true", "false"):
            return s == "true"
        return int(s) if s.lstrip("-").isdigit() else s

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- "):
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                out.append(scalar(lines[at][1][2:]))
                at += 1
            return out, at
        tree: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"not a map entry: {lines[at][1]}")
            at += 1
            if rest.strip() and not rest.strip().startswith("#"):
                tree[key.strip().strip("'\"")] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                tree[key.strip().strip("'\"")], at = block(at, lines[at][0])
            else:
                tree[key.strip().strip("'\"")] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"wrong indent: {lines[at][1]}")
        return tree, at

    return block(0, lines[0][0])[0] if lines else {}


def load(name: str, read: Callable[[str], str], _open: tuple[str, ...] = ()) -> dict:
    """A schema with its imports merged in (its own entries win); a cycle of imports raises ValueError."""
    if name in _open:
        raise ValueError("imports form a cycle: " + " -> ".join((*_open, name)))
    own = parse_yaml(read(name)) or {}
    out: dict = {"classes": {}, "slots": {}, "enums": {}}
    for imported in own.get("imports") or []:
        if ":" not in imported:
            other = load(imported, read, (*_open, name))
            for part in out:
                out[part].update(other[part])
    for part in out:
        out[part].update(own.get(part) or {})
    return out | {k: v for k, v in own.items() if k not in out}


def compile_schema(spark: SparkSession, schema: dict, ontology: str) -> dict[str, DataFrame]:
    """entity_types, edge_types, properties and values of a schema: slots that range over a class are edges, over an enum
    or a scalar properties; a class has its own slots and those of its is_a and mixins."""
    classes, slots, enums = schema.get("classes") or {}, schema.get("slots") or {}, schema.get("enums") or {}

    def slots_of(c: str, seen: tuple[str, ...] = ()) -> list[str]:
        if c in seen or c not in classes:
            return []
        d = classes[c] or {}
        above = [x for p in [d.get("is_a"), *(d.get("mixins") or [])] if p for x in slots_of(p, (*seen, c))]
        return list(dict.fromkeys([*above, *(d.get("slots") or []), *(d.get("attributes") or {})]))

    types, edges, props = [], [], []
    for c, d in classes.items():
        types.append((ontology, c, (d or {}).get("is_a"), bool((d or {}).get("abstract"))))
        for s in slots_of(c):
            spec = (slots.get(s) or {}) | (((d or {}).get("attributes") or {}).get(s) or {})
            target = spec.get("range") or schema.get("default_range") or "string"
            flags = bool(spec.get("required")), bool(spec.get("multivalued"))
            (edges if target in classes else props).append((ontology, c, s, target, *flags))
    values = [(ontology, e, v) for e, d in enums.items() for v in ((d or {}).get("permissible_values") or {})]
    link = "ontology_id string, class_name string, slot string, range string, required boolean, multivalued boolean"
    return {
        "entity_types": spark.createDataFrame(types, "ontology_id string, entity_type string, parent_type string, abstract boolean"),
        "edge_types": spark.createDataFrame(edges, link),
        "properties": spark.createDataFrame(props, link),
        "values": spark.createDataFrame(values, "ontology_id string, dimension string, value string"),
    }


def export_schema(tables: dict[str, DataFrame], ontology: str) -> str:
    """The tables of one ontology as LinkML text; they are schemas, thus small."""
    of = lambda n: sorted(tables[n].where(tables[n]["ontology_id"] == ontology).collect())
    links = [*of("edge_types"), *of("properties")]
    out = [f"name: {ontology}", "classes:"]
    for t in of("entity_types"):
        out.append(f"  {t['entity_type']}:")
        out += [f"    is_a: {t['parent_type']}"] * bool(t["parent_type"]) + ["    abstract: true"] * t["abstract"]
        mine = sorted({r["slot"] for r in links if r["class_name"] == t["entity_type"]})
        out += ["    slots:", *[f"      - {s}" for s in mine]] if mine else []
    out.append("slots:")
    for s in sorted({r["slot"] for r in links}):
        r = next(x for x in links if x["slot"] == s)
        out += [f"  {s}:", f"    range: {r['range']}"] + ["    required: true"] * r["required"] + ["    multivalued: true"] * r["multivalued"]
    values = of("values")
    if values:
        out.append("enums:")
        for e in dict.fromkeys(v["dimension"] for v in values):
            out += [f"  {e}:", "    permissible_values:", *[f"      {v['value']}: {{}}" for v in values if v["dimension"] == e]]
    return "\n".join(out) + "\n"
