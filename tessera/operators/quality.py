"""Graph quality: diagnostics, cardinality rules with state, coverage, reconciliation, conflicts, convergence.

All checks are anti-joins, aggregations and equi-joins over the whole tables; issues share one schema:
(issue_type, severity, subject, detail).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_small, materialize, ranged
from .graph import components, filter_edges

# The issue types, "missing_required_relation", "too_many_relations", "endpoint_type_mismatch", "isolated_entity",
# "small_component", "missing_entity_evidence", "missing_relation_evidence", the convergence issues with their severity and
# confidence, and the weights of the evidence score, all named where they are made.
ISSUE = ["issue_type", "severity", "subject", "detail"]
RULE = "rule_id string, entity_type string, relation_type string, direction string, target_entity_type string, min_count int, max_count int, severity string, metadata_json string"


def _issues(rows: DataFrame, kind: str | Column, severity: str | Column, subject: Column, detail: Column) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(text(kind).alias("issue_type"), text(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deprecated_at").isNull())


# --- rules -------------------------------------------------------------------------------------------------------


def upsert_rules(rules: DataFrame, text: str) -> DataFrame:
    """``rules`` with those of a JSON list added or replaced by rule_id; unknown directions or a missing id raise ValueError."""
    rows = []
    for r in json.loads(text):
        if not r.get("rule_id") or r.get("direction", "out") not in ("out", "in", "either"):
            raise ValueError(f"bad rule {r}")
        meta = r.get("metadata_json")
        rows.append(
            (
                r["rule_id"], r["entity_type"], r["relation_type"], r.get("direction", "out"), r.get("target_entity_type"),
                r.get("min_count"), r.get("max_count"), r.get("severity", "medium"), meta if meta is None or isinstance(meta, str) else json.dumps(meta),
            )
        )
    new = rules.sparkSession.createDataFrame(rows, RULE)
    return rules.join(new.select("rule_id"), "rule_id", "left_anti").select(*new.columns).unionByName(new)


def delete_rules(rules: DataFrame, ids: list[str]) -> DataFrame:
    """``rules`` without the given ids."""
    return rules.where(~F.col("rule_id").isin(*ids)) if ids else rules


def rule_filter(entity_metadata: Column, rule_metadata: Column) -> Column:
    """Whether an entity passes its rule's filters entity_filter.metadata.<field>: one_of, not_one_of, eq.

    A missing field fails one_of and eq and passes not_one_of; a rule without filters takes every entity.
    """
    filters = F.from_json(
        F.get_json_object(rule_metadata, "$.entity_filter.metadata"), "map<string,struct<one_of:array<string>,not_one_of:array<string>,eq:string>>"
    )
    values = F.from_json(entity_metadata, "map<string,string>")

    def passes(e: Column) -> Column:
        v, f = F.try_element_at(values, e["key"]), e["value"]
        one = f["one_of"].isNull() | F.coalesce(F.array_contains(f["one_of"], v), F.lit(False))
        none = f["not_one_of"].isNull() | v.isNull() | ~F.coalesce(F.array_contains(f["not_one_of"], v), F.lit(False))
        same = f["eq"].isNull() | F.coalesce(v == f["eq"], F.lit(False))
        return one & none & same

    return F.coalesce(F.forall(F.map_entries(filters), passes), F.lit(True))


def rule_states(rules: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(rule_id, entity_id, n, state, issue, severity): each rule held against every live entity of its type.

    n is the number of live relations of the rule's type out of, into or at either side of the entity whose other end
    has the wanted type; state is 'invalid' below the minimum (missing_required_relation) or above the maximum
    (too_many_relations), else 'valid'. Relations are counted once per side by type before they meet the rules.
    """
    kinds = _live(entities).select("entity_id", "entity_type")
    live = filter_edges(relations).select("relation_id", "relation_type", "source_id", "target_id")
    side = lambda a, b, d: live.select(F.col(a).alias("entity_id"), F.col(b).alias("other"), "relation_type", F.lit(d).alias("d"), (F.col("source_id") == F.col("target_id")).alias("loop"))
    ends = side("source_id", "target_id", "out").unionByName(side("target_id", "source_id", "in"))
    ends = ends.join(kinds.withColumnsRenamed({"entity_id": "other", "entity_type": "other_type"}), "other", "left")
    counts = ends.groupBy("entity_id", "relation_type", "other_type").agg(
        F.sum((F.col("d") == "out").cast("long")).alias("n_out"),
        F.sum((F.col("d") == "in").cast("long")).alias("n_in"),
        F.sum((~((F.col("d") == "in") & F.col("loop"))).cast("long")).alias("n_either"),
    )
    asked = broadcast_small(rules).alias("r")
    subjects = asked.join(_live(entities).select("entity_id", "entity_type", F.col("metadata_json").alias("_m")).alias("e"), F.col("r.entity_type") == F.col("e.entity_type"))
    subjects = subjects.where(rule_filter(F.col("_m"), F.col("r.metadata_json"))).select("r.*", "e.entity_id")
    joined = subjects.alias("s").join(counts.alias("c"), ["entity_id", "relation_type"], "left")
    fits = F.col("s.target_entity_type").isNull() | (F.col("s.target_entity_type") == F.col("c.other_type"))
    n = F.when(fits, F.when(F.col("s.direction") == "out", F.col("n_out")).when(F.col("s.direction") == "in", F.col("n_in")).otherwise(F.col("n_either")))
    total = joined.groupBy("rule_id", "entity_id", "min_count", "max_count", "severity").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))
    issue = F.when(F.col("n") < F.col("min_count"), "missing_required_relation").when(F.col("n") > F.col("max_count"), "too_many_relations")
    return total.select("rule_id", "entity_id", "n", F.when(issue.isNull(), "valid").otherwise("invalid").alias("state"), issue.alias("issue"), "severity")


def rule_transitions(before: DataFrame | None, now: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """The new states (rule_id, entity_id, state) and the events of those that changed: (event_id, rule_id, entity_id,
    from_state, to_state, remediation).

    The first evaluation comes from 'unknown'; remediation is set where an invalid state became valid. Event ids are a
    hash of the run and the change, so a repeated run makes no second event. States of rules or entities that are no
    longer evaluated are kept without an event.
    """
    now = now.select("rule_id", "entity_id", "state")
    if before is None:
        before = now.select("rule_id", "entity_id", F.lit("").alias("state")).limit(0)
    both = before.withColumnRenamed("state", "was").join(now, ["rule_id", "entity_id"], "full")
    changed = both.where(F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("was")))
    old = F.coalesce("was", F.lit("unknown"))
    events = changed.select(
        F.sha2(F.concat_ws("|", F.lit(run), "rule_id", F.col("entity_id").cast("string"), old, "state"), 256).alias("event_id"),
        "rule_id", "entity_id", old.alias("from_state"), F.col("state").alias("to_state"),
        ((old == "invalid") & (F.col("state") == "valid")).alias("remediation"),
    )
    return both.select("rule_id", "entity_id", F.coalesce("state", "was").alias("state")), events


# --- diagnostics -------------------------------------------------------------------------------------------------


def rule_gaps(rules: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    bad = rule_states(rules, entities, relations).where("issue is not null")
    return _issues(bad, F.col("issue"), F.col("severity"), F.col("entity_id"), F.concat_ws(" ", "rule_id", F.col("n").cast("string")))


def type_mismatches(edge_types: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Live relations whose ends don't have the types that ``edge_types`` (edge_type, source_type, target_type) declares."""
    kinds = entities.select("entity_id", "entity_type")
    r = filter_edges(relations).join(broadcast_small(edge_types), F.col("relation_type") == F.col("edge_type"))
    r = r.join(kinds.toDF("source_id", "st"), "source_id").join(kinds.toDF("target_id", "tt"), "target_id")
    off = lambda want, got: F.col(want).isNotNull() & (F.col(want) != F.col(got))
    bad = r.where(off("source_type", "st") | off("target_type", "tt"))
    return _issues(bad, "endpoint_type_mismatch", "high", F.col("relation_id"), F.concat_ws(" ", "st", "relation_type", "tt"))


def isolated_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Live entities without a live relation."""
    live = filter_edges(relations)
    ends = live.select(F.col("source_id").alias("entity_id")).unionByName(live.select(F.col("target_id").alias("entity_id")))
    return _issues(_live(entities).join(ends, "entity_id", "left_anti"), "isolated_entity", "medium", F.col("entity_id"), F.col("name"))


def small_components(relations: DataFrame, max_size: int = 3) -> DataFrame:
    """Connected components of 2 to ``max_size`` entities, each named by its least id."""
    sizes = components(relations).groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_size))
    return _issues(sizes, "small_component", "low", F.col("component"), F.col("n"))


def evidence_gaps(entities: DataFrame, relations: DataFrame, links: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """Live entities without a document or chunk in ``links`` (entity_id), live relations without a ref_doc_id property."""
    bare = _live(entities).join(links.select("entity_id"), "entity_id", "left_anti")
    out = _issues(bare, "missing_entity_evidence", "medium", F.col("entity_id"), F.col("name"))
    if properties is not None:
        cited = properties.where(F.col("ref_doc_id").isNotNull()).select("relation_id")
        unproved = filter_edges(relations).join(cited, "relation_id", "left_anti")
        out = out.unionByName(_issues(unproved, "missing_relation_evidence", "medium", F.col("relation_id"), F.col("relation_type")))
    return out


def diagnostics(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """The issues of all checks together, by type and subject, at most ``limit`` where one is given."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every if limit is None else every.orderBy("issue_type", "subject", "detail").limit(limit)


# --- coverage ----------------------------------------------------------------------------------------------------


def fact_identity() -> Column:
    """The first of node_id, entity_id, name, label in a fact's JSON, else its content."""
    fields = [F.get_json_object("facets_json", f"$.{k}") for k in ("node_id", "entity_id", "name", "label")]
    return F.coalesce(*fields, F.col("content"))


def coverage(facts: DataFrame, entities: DataFrame, schemas: tuple[str, ...], entity_types: list[str] | None = None) -> DataFrame:
    """(workspace_id, covered_nodes, total_nodes, coverage_ratio) of each workspace's ontology facts.

    A fact is covered if a live entity of its workspace has its identity as name; ``entities`` has workspace_id and name.
    """
    marked = _covered(facts, entities, schemas, entity_types)
    return marked.groupBy("workspace_id").agg(
        F.sum(F.col("covered").cast("long")).alias("covered_nodes"), F.count("*").alias("total_nodes"), F.avg(F.col("covered").cast("double")).alias("coverage_ratio")
    )


def coverage_by_domain(facts: DataFrame, entities: DataFrame, workspaces: DataFrame, domain: str, schemas: tuple[str, ...], entity_types: list[str] | None = None) -> DataFrame:
    """coverage() of the workspace that a domain stands for: the one of that id, else the least id among those of that domain or
    label (``workspaces``: workspace_id, domain, label). An unknown domain gives no rows."""
    asked = F.lit(domain)
    hits = workspaces.where((F.col("workspace_id") == asked) | (F.col("domain") == asked) | (F.col("label") == asked))
    found = hits.orderBy((F.col("workspace_id") != asked), "workspace_id").limit(1).collect()
    wanted = found[0]["workspace_id"] if found else None
    mine = lambda df: df.where(F.col("workspace_id") == F.lit(wanted)) if wanted is not None else df.limit(0)
    return coverage(mine(facts), mine(entities), schemas, entity_types)


def decayed_gaps(gaps: DataFrame, entities: DataFrame, decayed: DataFrame) -> DataFrame:
    """coverage_gaps() with decayed_confidence: that of the live entity (workspace_id, name) that has the gap's label, the least id of
    several, from ``decayed`` (entity_id, decayed); null without one."""
    named = _live(entities).groupBy("workspace_id", F.col("name").alias("label")).agg(F.min("entity_id").alias("entity_id"))
    valued = named.join(decayed.select("entity_id", "decayed"), "entity_id").select("workspace_id", "label", F.col("decayed").alias("decayed_confidence"))
    return gaps.join(valued, ["workspace_id", "label"], "left").select(*gaps.columns, "decayed_confidence")


def undeclared_types(rows: DataFrame, column: str, declared: DataFrame, kind: str, section: str) -> DataFrame:
    """Issues for each distinct type of ``rows`` (workspace_id, column) that ``declared`` (workspace_id, type_name) lacks: one layer of a
    reconciliation report; the layers are put together by diagnostics()."""
    used = rows.where(F.col(column).isNotNull()).select("workspace_id", F.col(column).alias("type_name")).distinct()
    return _issues(used.join(declared.select("workspace_id", "type_name"), ["workspace_id", "type_name"], "left_anti"), kind, "warning", F.concat_ws("|", "workspace_id", "type_name"), F.lit(section))


def reconcile_layers(layers: dict[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """The reconciliation report over any number of layers (registry, raw graph, runtime graph, rules, facets, bindings):
    {section: (rows, column, declared)}; each gives '<section>_unknown_type' issues by undeclared_types()."""
    return diagnostics([undeclared_types(rows, column, declared, f"{name}_unknown_type", name) for name, (rows, column, declared) in layers.items()])


def coverage_gaps(facts: DataFrame, entities: DataFrame, schemas: tuple[str, ...], entity_types: list[str] | None = None) -> DataFrame:
    """(workspace_id, id, label, entity_type, criticality) of the facts that aren't covered."""
    get = lambda k: F.get_json_object("facets_json", f"$.{k}")
    return _covered(facts, entities, schemas, entity_types).where("not covered").select(
        "workspace_id",
        "id",
        F.coalesce(get("label"), F.col("content")).alias("label"),
        F.coalesce(get("entity_type"), F.lit("unknown")).alias("entity_type"),
        F.coalesce(get("criticality"), F.lit("normal")).alias("criticality"),
    )


def _covered(facts: DataFrame, entities: DataFrame, schemas: tuple[str, ...], entity_types: list[str] | None) -> DataFrame:
    rows = facts.where(F.col("schema_id").isin(*schemas))
    if entity_types:
        rows = rows.where(F.get_json_object("facets_json", "$.entity_type").isin(*entity_types))
        entities = entities.where(F.col("entity_type").isin(*entity_types))
    rows = rows.select("workspace_id", fact_identity().alias("id"), "content", "facets_json")
    names = _live(entities).select("workspace_id", F.col("name").alias("id"), F.lit(True).alias("covered")).distinct()
    return rows.join(names, ["workspace_id", "id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# --- reconciliation and convergence ------------------------------------------------------------------------------


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str) -> DataFrame:
    """Issues for keys that only one of two layers has: 'only_in_<layer>'."""
    subject = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = lambda x, y, name: _issues(x.join(y, keys, "left_anti"), f"only_in_{name}", "medium", subject, F.lit(name))
    return only(a, b, left_name).unionByName(only(b, a, right_name))


def convergence_actions(counts: DataFrame) -> DataFrame:
    """(workspace_id, issue_type, severity, confidence) that one row of layer counts per workspace calls for.

    Columns: registry_nodes, registry_edges, entity_types, edge_labels, graph_entities, graph_relations, coverage_gaps,
    diagnostics_issues; null counts are 0.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    one = lambda cond, kind, severity, confidence: F.when(
        cond, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    )
    rows = F.array(
        one(c("registry_nodes") != c("entity_types"), "native_entity_registry_mismatch", "high", 0.9),
        one(
            (c("registry_edges") > 0) & (c("edge_labels") > 0) & (c("registry_edges") != c("edge_labels")), "native_edge_registry_granularity_mismatch", "medium", 0.85
        ),
        one(
            (c("registry_edges") > 0) & (c("graph_entities") > 0) & (c("graph_relations") == 0), "runtime_graph_relation_materialization_gap", "critical", 0.95
        ),
        one(c("coverage_gaps") > 0, "ontology_coverage_gap", "high", 0.9),
        one(c("diagnostics_issues") > 0, "graph_diagnostics_issues", "high", 0.9),
    )
    return counts.select("workspace_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("a")).select("workspace_id", "a.*")


# The states of a remediation action.
STATES = ("proposed", "approved", "rejected", "applied", "failed", "skipped")


def propose_actions(actions: DataFrame | None, found: DataFrame, run: str, now: int) -> DataFrame:
    """The table of remediation actions with those that convergence_actions() found in a run added as 'proposed'.

    Actions are keyed by workspace and idempotency_key (a hash of workspace and issue type), so what an earlier run proposed stays
    as it is, with its decision. Columns: action_id, run_id, workspace_id, issue_type, severity, confidence, idempotency_key,
    status, decision_actor, decision_note, result_json, created_at, updated_at, decided_at, applied_at.
    """
    none = F.lit(None)
    key = F.sha2(F.concat_ws("|", "workspace_id", "issue_type"), 256)
    at = F.lit(now).cast("long")
    new = found.select(
        F.sha2(F.concat_ws("|", F.lit(run), key), 256).alias("action_id"), F.lit(run).alias("run_id"), "workspace_id", "issue_type", "severity", "confidence",
        key.alias("idempotency_key"), F.lit("proposed").alias("status"), none.cast("string").alias("decision_actor"), none.cast("string").alias("decision_note"),
        F.lit("{}").alias("result_json"), at.alias("created_at"), at.alias("updated_at"), none.cast("long").alias("decided_at"), none.cast("long").alias("applied_at"),
    ).dropDuplicates(["workspace_id", "idempotency_key"])
    return new if actions is None else actions.unionByName(new.join(actions, ["workspace_id", "idempotency_key"], "left_anti").select(*actions.columns))


def decide_actions(actions: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """The actions after decisions (action_id, decision, actor, note): 'approved' or 'rejected', for those not yet carried out.

    Actions that are applied, failed or skipped keep their state; of several decisions on one action the last by ``seq``, if there is such
    a column, else the least by name counts. Another decision makes the whole update fail.
    """
    ok = F.col("decision").isin("approved", "rejected")
    checked = decisions.withColumn("decision", F.when(ok, F.col("decision")).otherwise(F.raise_error(F.lit("a decision is approved or rejected"))))
    order = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    last = checked.groupBy("action_id").agg(F.max_by(F.struct("decision", "actor", "note"), F.struct(order.alias("o"), F.col("decision"))).alias("_d"))
    free = F.col("_d").isNotNull() & F.col("status").isin("proposed", "approved", "rejected")
    at = F.lit(now).cast("long")
    put = lambda c, v: F.when(free, v).otherwise(F.col(c)).alias(c)
    new = {"status": F.col("_d.decision"), "decision_actor": F.col("_d.actor"), "decision_note": F.col("_d.note"), "decided_at": at, "updated_at": at}
    return actions.join(last, "action_id", "left").select(*[put(c, new[c]) if c in new else F.col(c) for c in actions.columns])


def record_results(actions: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """The actions after results (action_id, status, result_json): any of STATES; 'applied' sets applied_at. Others make the update fail."""
    ok = F.col("status").isin(*STATES)
    checked = results.select("action_id", F.when(ok, F.col("status")).otherwise(F.raise_error(F.lit("unknown status of an action"))).alias("_s"), F.coalesce("result_json", F.lit("{}")).alias("_r"))
    last = checked.groupBy("action_id").agg(F.max(F.struct("_s", "_r")).alias("_x"))
    at, hit = F.lit(now).cast("long"), F.col("_x").isNotNull()
    new = {"status": F.col("_x._s"), "result_json": F.col("_x._r"), "updated_at": at, "applied_at": F.when(F.col("_x._s") == "applied", at).otherwise(F.col("applied_at"))}
    return actions.join(last, "action_id", "left").select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in actions.columns])


def list_actions(actions: DataFrame, run: str, status: str | None = None) -> DataFrame:
    """A run's actions, of one status if it is given, by severity (as text, falling) and id."""
    rows = actions.where(F.col("run_id") == run)
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("severity"), "action_id")


def list_runs(actions: DataFrame) -> DataFrame:
    """(run_id, workspace_id, n_actions, n_open, last_update): the runs with their actions, of which open ones await a decision."""
    return actions.groupBy("run_id", "workspace_id").agg(
        F.count("*").alias("n_actions"), F.count_if(F.col("status") == "proposed").alias("n_open"), F.max("updated_at").alias("last_update")
    )


# --- conflicts ---------------------------------------------------------------------------------------------------


def exclusive_conflicts(relations: DataFrame, types: list[str]) -> DataFrame:
    """(source_id, relation_type, n_targets, target_id): sources with several targets of a relation that allows one, a row for
    each of the targets, so that no row grows with a hub."""
    live = filter_edges(relations).where(F.col("relation_type").isin(*types)).select("source_id", "relation_type", "target_id").distinct()
    live = live.where(F.col("target_id").isNotNull())
    many = live.groupBy("source_id", "relation_type").agg(F.count("*").alias("n_targets")).where("n_targets > 1")
    return live.join(many, ["source_id", "relation_type"]).select("source_id", "relation_type", "n_targets", "target_id")


def invalid_intervals(relations: DataFrame) -> DataFrame:
    """(relation_id, source_id, relation_type, valid_from, valid_to) of live relations that end before they begin."""
    bad = filter_edges(relations).where(F.col("valid_from") > F.col("valid_to"))
    return bad.select("relation_id", "source_id", "relation_type", "valid_from", "valid_to")


def granularity_conflicts(relations: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """(relation_id, coarse_relation_id, n_coarse, source_id, relation_type, fine_type, coarse_type): relations whose target has a
    type of which the same source has, by the same relation, also a target of the parent type.

    ``parents`` has entity_type and parent_type. Each fine relation comes once for each parent type, with the least of its coarse ones and
    their number, so a source with n of either has n rows, not n * n.
    """
    kinds = entities.select(F.col("entity_id").alias("target_id"), "entity_type")
    typed = filter_edges(relations).select("relation_id", "source_id", "relation_type", "target_id").join(kinds, "target_id")
    coarse = typed.groupBy("source_id", "relation_type", F.col("entity_type").alias("coarse_type")).agg(
        F.min("relation_id").alias("coarse_relation_id"), F.count("*").alias("n_coarse")
    )
    tree = broadcast_small(parents.select("entity_type", F.col("parent_type").alias("coarse_type")).distinct())
    fine = typed.join(tree, "entity_type").where(F.col("entity_type") != F.col("coarse_type"))
    return fine.join(coarse, ["source_id", "relation_type", "coarse_type"]).select(
        "relation_id", "coarse_relation_id", "n_coarse", "source_id", "relation_type", F.col("entity_type").alias("fine_type"), "coarse_type"
    )


def overlap_conflicts(relations: DataFrame, types: list[str], hot_rows: int = 1_000_000) -> DataFrame:
    """(relation_id, other_id): relations of one source and type, to different targets, whose times overlap (null is open).

    Found by a sweep: within a source and type, by begin, a relation conflicts with the one of latest end among those
    before it with a different target, if that lasts beyond its begin. Each relation that overlaps one before it comes
    once, with that one, so a source with n overlapping relations gives n - 1 rows, not n * n; overlap_pairs() has all.
    Relations without a target take no part.

    The sweep carries the latest end and the latest among the other targets: whenever two targets meet, the lesser of
    the row and the latest before it stays a candidate for the second, whose target then never is that of the latest. Groups of over
    ``hot_rows`` relations are swept range by range, what the ranges before hold at best being carried over, so none is one task.
    """
    key = ["source_id", "relation_type"]
    rows = _spans(relations, types).withColumn("own", F.struct("e", "relation_id", "target_id"))
    hot = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*key)
    hot = materialize(hot.where(F.col("source_id").isNotNull()), "hot")
    if hot.isEmpty():
        last = _best_before(rows, key)
    else:
        small = broadcast_small(hot)
        last = _best_before(rows.join(small, key, "left_anti"), key).unionByName(_carried(rows.join(small, key, "left_semi"), key))
    return last.where(F.col("other.e") >= F.col("b")).select("relation_id", F.col("other.relation_id").alias("other_id"))


def _best_before(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with other: of those before each in its group, the one of latest end with another target."""
    w = Window.partitionBy(*key).orderBy("b", "relation_id").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("before", F.max("own").over(w))
    differs = F.col("before.target_id") != F.col("target_id")
    second = F.max(F.when(differs, F.least("own", "before"))).over(w)
    return last.withColumn("other", F.when(differs, F.col("before")).otherwise(second)).drop("before")


def _carried(rows: DataFrame, key: list[str]) -> DataFrame:
    """_best_before() for groups of many rows: within ranges of a group, then with what the ranges before hold at best, the latest
    end and the latest with another target than that."""
    parts = ranged(rows, key, ["b", "relation_id"])
    at = [*key, "_p"]
    best = parts.groupBy(*at).agg(F.max("own").alias("x"))
    other = parts.join(best, at).where("own.target_id != x.target_id").groupBy(*at).agg(F.max("own").alias("y"))
    tops = best.join(other, at, "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_p", "x", "y"))).alias("l"))
    pick = lambda all_, t: F.array_max(F.filter(all_, lambda s: s.isNotNull() & (t.isNull() | (s["target_id"] != t))))
    none = F.lit(None).cast("int")

    def merge(acc: Column, r: Column) -> Column:
        every = F.array(acc["x"], acc["y"], r["x"], r["y"])
        first = pick(every, none)
        state = F.struct(r["_p"].alias("_p"), acc["x"].alias("x"), acc["y"].alias("y"))  # what came before this range
        return F.struct(first.alias("x"), pick(every, first["target_id"]).alias("y"), F.concat(acc["out"], F.array(state)).alias("out"))

    kind = rows.schema["own"].dataType.simpleString()
    null = F.lit(None).cast(kind)
    start = F.struct(null.alias("x"), null.alias("y"), F.array().cast(f"array<struct<_p:int,x:{kind},y:{kind}>>").alias("out"))
    before = tops.select(*key, F.inline(F.aggregate("l", start, merge)["out"]).alias("_p", "x", "y"))
    within = _best_before(parts, at).join(before, at)
    carried = F.when(F.col("x.target_id") != F.col("target_id"), F.col("x")).otherwise(F.col("y"))
    return within.withColumn("other", F.greatest("other", carried)).drop("_p", "x", "y")


def overlap_pairs(relations: DataFrame, types: list[str]) -> DataFrame:
    """(relation_id, other_id, kind): every pair of relations of one source and type whose times overlap (null is open).

    kind is 'same_target' or 'different_target'; relation_id is the lesser id. A source with n overlapping relations
    gives n * (n - 1) / 2 rows.
    """
    rows = _spans(relations, types)
    other = rows.select("source_id", "relation_type", *[F.col(c).alias(f"o_{c}") for c in ("relation_id", "target_id", "b", "e")])
    both = rows.join(other, ["source_id", "relation_type"])
    both = both.where((F.col("relation_id") < F.col("o_relation_id")) & (F.col("b") <= F.col("o_e")) & (F.col("o_b") <= F.col("e")))
    kind = F.when(F.col("target_id") == F.col("o_target_id"), "same_target").otherwise("different_target")
    return both.select("relation_id", F.col("o_relation_id").alias("other_id"), kind.alias("kind"))


def _spans(relations: DataFrame, types: list[str]) -> DataFrame:
    """The live relations of the types that have a target, with begin b and end e."""
    lo, hi = F.lit(-(2**62)), F.lit(2**62)
    live = filter_edges(relations).where(F.col("relation_type").isin(*types) & F.col("target_id").isNotNull())
    return live.select("relation_id", "source_id", "relation_type", "target_id", F.coalesce("valid_from", lo).alias("b"), F.coalesce("valid_to", hi).alias("e"))


def redundant_relations(relations: DataFrame) -> DataFrame:
    """(relation_type, source_id, target_id, n, keep_relation_id, relation_id, kind): relations that say the same, a row for each.

    kind is 'redundant_fact' where all have the same validity (null equals null), else 'temporal_conflict'; keep_relation_id is the
    least id. Inputs without validity have it null.
    """
    key = ["relation_type", "source_id", "target_id"]
    span = [F.col(c) if c in relations.columns else F.lit(None).cast("long") for c in ("valid_from", "valid_to")]
    live = filter_edges(relations).select(*key, "relation_id", *[c.cast("string").alias(n) for c, n in zip(span, ("_b", "_e"))])
    spans = F.count_distinct(F.struct(F.coalesce("_b", F.lit("")), F.coalesce("_e", F.lit(""))))
    many = live.groupBy(*key).agg(F.count("*").alias("n"), F.min("relation_id").alias("keep_relation_id"), spans.alias("_spans")).where("n > 1")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    both = live.alias("a").join(many.alias("b"), reduce(lambda x, y: x & y, same))
    kind = F.when(F.col("_spans") == 1, "redundant_fact").otherwise("temporal_conflict").alias("kind")
    return both.select(*[F.col(f"a.{c}").alias(c) for c in key], "n", "keep_relation_id", "relation_id", kind)


def evidence_score(rows: DataFrame) -> DataFrame:
    """``rows`` with evidence_score = 0.35 doc_ref + 0.25 chunk + 0.2 confidence + 0.1 agreement + 0.1 recency, nulls 0."""
    weights = {"doc_ref": 0.35, "chunk": 0.25, "confidence": 0.2, "agreement": 0.1, "recency": 0.1}
    return rows.withColumn("evidence_score", reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()]))
