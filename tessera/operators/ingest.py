"""Ingest: upserts by key, structured import, rebuilds from the raw layer, audits, the message queue, facts, profiles.

An upsert is a rewrite: the rows of the target and of the change meet in one grouping by key, in which the last by
sequence wins or a rule merges them. Stores with MERGE can use the same frames as its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import chunk
from .search import Index, build_index

FACT_CONFIDENCE, DERIVED_CONFIDENCE = 0.9, 0.85


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``target`` after ``changes``: of the rows of a key the last change by ``seq`` counts, else the target's row.

    Both need the same columns but ``seq``, which only the changes have. Ties of seq go to the greater row. Rows with a
    null key are kept apart from one another only by their other values.
    """
    cols = target.columns
    rest = [c for c in cols if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return target.join(last.select(*keys), keys, "left_anti").select(*cols).unionByName(last.select(*cols))


def upsert_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities by natural key (workspace_id, entity_type, name): the greatest confidence, the last non-empty metadata by
    seq, the least entity_id; a changed entity is live again."""
    null = F.lit(None)
    old = entities.select("workspace_id", "entity_type", "name", "entity_id", "confidence", "metadata_json", "deprecated_at", F.lit(-1).cast("long").alias("seq"))
    new = changes.select("workspace_id", "entity_type", "name", "entity_id", "confidence", "metadata_json", null.cast("long").alias("deprecated_at"), F.col("seq").cast("long"))
    filled = F.when(~F.coalesce("metadata_json", F.lit("")).isin("", "{}"), F.struct("seq", "metadata_json"))
    return old.unionByName(new).groupBy("workspace_id", "entity_type", "name").agg(
        F.min("entity_id").alias("entity_id"),
        F.max("confidence").alias("confidence"),
        F.coalesce(F.max(filled)["metadata_json"], F.lit("{}")).alias("metadata_json"),
        F.max_by("deprecated_at", "seq").alias("deprecated_at"),
    )


def upsert_relations(relations: DataFrame, changes: DataFrame) -> DataFrame:
    """Live relations by natural key (relation_type, source_id, target_id, run_id): the greatest confidence, the first
    validity that isn't null, the least relation_id. Deprecated relations stay as they are."""
    key = ["relation_type", "source_id", "target_id", "run_id"]
    cols = [*key, "relation_id", "confidence", "valid_from", "valid_to"]
    live = relations.where(F.col("deprecated_at").isNull()).select(*cols, F.lit(-1).cast("long").alias("seq"))
    both = live.unionByName(changes.select(*cols, F.col("seq").cast("long")))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    merged = both.groupBy(*key).agg(F.min("relation_id").alias("relation_id"), F.max("confidence").alias("confidence"), first("valid_from"), first("valid_to"))
    dead = relations.where(F.col("deprecated_at").isNotNull()).select(*cols, "deprecated_at")
    return merged.withColumn("deprecated_at", F.lit(None).cast("long")).select(*cols, "deprecated_at").unionByName(dead)


def learn_from_run(outcome: str) -> float:
    """The confidence of what a run teaches: 1 for success, 0.6 for partial, else 0.2."""
    return {"success": 1.0, "partial": 0.6}.get(outcome, 0.2)


def apply_patch(entities: DataFrame, relations: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations after a patch: rows (action, seq, and the columns of what they change).

    Actions are upsert_entity, upsert_relation and deprecate (of entity_id or relation_id, at the row's ``at``); any other
    makes the whole patch fail.
    """
    known = F.col("action").isin("upsert_entity", "upsert_relation", "deprecate")
    patch = patch.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.lit("unknown patch action"))))
    e = upsert_entities(entities, patch.where("action = 'upsert_entity'"))
    r = upsert_relations(relations, patch.where("action = 'upsert_relation'"))
    gone = patch.where("action = 'deprecate'")

    def deprecate(df: DataFrame, key: str) -> DataFrame:
        at = gone.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("at").alias("_at"))
        out = df.join(at, key, "left")
        return out.withColumn("deprecated_at", F.coalesce("deprecated_at", "_at")).drop("_at").select(*df.columns)

    return deprecate(e, "entity_id"), deprecate(r, "relation_id")


def evidence_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links once per key, with the greatest confidence."""
    return links.groupBy(*keys).agg(F.max("confidence").alias("confidence"))


# --- structured import -------------------------------------------------------------------------------------------


def fact_id() -> Column:
    """'facet_' and the first 16 bytes of SHA-256 of 'workspace:source_ref' in hex."""
    return F.concat(F.lit("facet_"), F.substring(F.sha2(F.concat_ws(":", "workspace_id", "source_ref"), 256), 1, 32))


def import_facts(rows: DataFrame, existing: DataFrame | None = None, mode: str = "append") -> DataFrame:
    """(id, workspace_id, source_ref, schema_id, content, facets_json) of the imported rows, one per source_ref of a workspace.

    Of repeated source_refs the last by seq counts; 'ignore_duplicates' leaves out those that ``existing`` has, 'append'
    replaces them, 'reset' drops all of ``existing`` in the imported workspaces. Rows with a null key, and facets that are no
    JSON object, are left out; read them with invalid_facts().
    """
    if mode not in ("append", "reset", "ignore_duplicates"):
        raise ValueError(f"unknown mode {mode}")
    cols = ["id", "workspace_id", "source_ref", "schema_id", "content", "facets_json"]
    rest = ["schema_id", "content", "facets_json"]
    good = rows.join(invalid_facts(rows).select("workspace_id", "source_ref", "seq"), ["workspace_id", "source_ref", "seq"], "left_anti")
    good = good.where(F.col("workspace_id").isNotNull() & F.col("source_ref").isNotNull())
    last = good.groupBy("workspace_id", "source_ref").agg(F.max(F.struct("seq", *rest)).alias("r"))
    new = last.select(fact_id().alias("id"), "workspace_id", "source_ref", *[F.col(f"r.{c}").alias(c) for c in rest])
    if existing is None:
        return new
    key = ["workspace_id", "source_ref"]
    if mode == "reset":
        kept = existing.join(new.select("workspace_id").distinct(), "workspace_id", "left_anti")
    elif mode == "append":
        kept = existing.join(new.select(*key), key, "left_anti")
    else:
        kept, new = existing, new.join(existing.select(*key), key, "left_anti")
    return kept.select(*cols).unionByName(new.select(*cols))


def write_facts(facts: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """``facts`` after ``changes`` (workspace_id, source_ref, schema_id, content, facets_json, seq): one row per source of a workspace.

    A known source keeps its id and doc_id, its version rises by one; a new one gets fact_id(), version 1 and a doc_id
    above all others. Of several changes of a source the last by seq counts. Rows with a null key are left out.
    """
    key, rest = ["workspace_id", "source_ref"], ["schema_id", "content", "facets_json"]
    last = changes.where(F.col("workspace_id").isNotNull() & F.col("source_ref").isNotNull())
    last = last.groupBy(*key).agg(F.max(F.struct("seq", *rest)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
    known = facts.select(*key, F.col("id").alias("_id"), F.col("doc_id").alias("_doc"), F.col("version").alias("_v"))
    top = facts.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    new = last.join(known, key, "left").select(
        F.coalesce("_id", fact_id()).alias("id"),
        *key,
        *rest,
        F.coalesce("_doc", F.monotonically_increasing_id() + (top + 1)).alias("doc_id"),
        (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version"),
        F.lit(now).cast("long").alias("updated_at_unix"),
    )
    cols = new.columns
    return facts.join(last.select(*key), key, "left_anti").select(*cols).unionByName(new)


def invalid_facts(rows: DataFrame) -> DataFrame:
    """The rows whose key is null or whose facets are no JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("facets_json"))
    return rows.where(F.col("workspace_id").isNull() | F.col("source_ref").isNull() | ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


def entity_type_of(ref: Column) -> Column:
    """The part of a source_ref before its first colon."""
    return F.substring_index(ref, ":", 1)


def derive_edges(facts: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """(workspace_id, external_id, source, label, target, confidence): edges from referenced rows to the rows that refer.

    ``contract`` has (facet key, label): a fact whose facet holds a source_ref gets an edge from it. external_id is
    'source|label|target'; each edge comes once.
    """
    rows = [
        facts.select("workspace_id", F.get_json_object("facets_json", f"$.{k}").alias("source"), F.lit(label).alias("label"), F.col("source_ref").alias("target"))
        for k, label in contract
    ]
    every = reduce(lambda a, b: a.unionByName(b), rows).where("source is not null and source != ''").distinct()
    return every.select("workspace_id", F.concat_ws("|", "source", "label", "target").alias("external_id"), "source", "label", "target", F.lit(DERIVED_CONFIDENCE).alias("confidence"))


def merge_edges(provided: DataFrame, derived: DataFrame) -> DataFrame:
    """Provided edges and those derived that they don't have (by workspace and external_id)."""
    key = ["workspace_id", "external_id"]
    return provided.unionByName(derived.join(provided.select(*key), key, "left_anti").select(*provided.columns))


def audit_orphans(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(workspace_id, facts, orphans, orphan_ratio): facts without an entity whose external_id is their source_ref."""
    known = entities.select("workspace_id", F.col("external_id").alias("source_ref"), F.lit(1).alias("_k")).distinct()
    marked = facts.join(known, ["workspace_id", "source_ref"], "left")
    return marked.groupBy("workspace_id").agg(
        F.count("*").alias("facts"), F.sum(F.col("_k").isNull().cast("long")).alias("orphans"), F.avg(F.col("_k").isNull().cast("double")).alias("orphan_ratio")
    )


def validate_bundle(tables: dict[str, DataFrame], required: dict[str, list[str]], foreign: list[tuple[str, str, str, str]]) -> DataFrame:
    """(table, problem, detail, n): missing columns, nulls in required columns, and keys that their table lacks.

    ``foreign`` has (table, column, referenced table, referenced column).
    """
    spark = next(iter(tables.values())).sparkSession
    missing = [(t, "missing_column", c, 1) for t, cs in required.items() for c in cs if t not in tables or c not in tables[t].columns]
    out = spark.createDataFrame(missing, "table string, problem string, detail string, n long")
    for t, cs in required.items():
        have = [c for c in cs if t in tables and c in tables[t].columns]
        if have:
            counts = tables[t].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have])
            rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("detail"), F.col(c).alias("n")) for c in have])).alias("x")).select("x.*").where("n > 0")
            out = out.unionByName(rows.select(F.lit(t).alias("table"), F.lit("null_in_required").alias("problem"), "detail", "n"))
    for t, c, rt, rc in foreign:
        bad = tables[t].where(F.col(c).isNotNull()).join(tables[rt].select(F.col(rc).alias(c)).distinct(), c, "left_anti")
        n = bad.agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(n.select(F.lit(t).alias("table"), F.lit("unknown_reference").alias("problem"), F.lit(f"{c} -> {rt}.{rc}").alias("detail"), "n"))
    return out


def profile(rows: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_filled, n_distinct): how well each column is filled (neither null nor blank); one pass."""
    cols = rows.columns
    filled = lambda c: F.trim(F.col(c).cast("string")) != ""
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(filled(c)).alias(f"f{i}"), F.approx_count_distinct(F.when(filled(c), F.col(c).cast("string")), 0.02).alias(f"d{i}")]
    one = rows.agg(*aggs)
    each = [F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(f"f{i}").alias("n_filled"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def infer_semantics(rows: DataFrame, references: dict[str, str] | None = None) -> DataFrame:
    """(column_name, column_role, data_type): fk for referencing columns, id for id or record_id, else measure for numbers,
    time for times, attribute for the rest."""
    references = references or {}
    out = []
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        role = "fk" if f.name in references else "id" if f.name in ("id", "record_id") else "measure" if kind in ("int", "bigint", "double", "float") or kind.startswith("decimal") else "time" if kind in ("timestamp", "date") else "attribute"
        out.append((f.name, role, kind))
    return rows.sparkSession.createDataFrame(out, "column_name string, column_role string, data_type string")


def propose_ddl(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, ddl): a CREATE TABLE for each table of a column list (column_name, data_type, ordinal)."""
    item = F.struct("ordinal", F.concat_ws(" ", F.concat(F.lit("`"), "column_name", F.lit("`")), "data_type").alias("c"))
    listed = columns.groupBy("table_schema", "table_name").agg(F.array_sort(F.collect_list(item)).alias("i"))
    body = F.concat_ws(", ", F.transform("i", lambda x: x["c"]))
    return listed.select("table_schema", "table_name", F.format_string("CREATE TABLE `%s`.`%s` (%s)", "table_schema", "table_name", body).alias("ddl"))


def workspace_model(tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """(workspace_id, section, item): each workspace's tables, columns and relations, one JSON object a row, each once.

    workspace_document() puts the items of one workspace together, where they are few enough for one document.
    """
    pick = lambda df, name, *cols: df.select("workspace_id", F.lit(name).alias("section"), F.to_json(F.struct(*cols)).alias("item")).distinct()
    return (
        pick(tables, "tables", "table_id", "table_schema", "table_name")
        .unionByName(pick(columns, "columns", "table_id", "column_semantic_id", "column_name", "data_type"))
        .unionByName(pick(relations, "relations", "relation_semantic_id", "from_table", "to_table", "fk_column"))
    )


def workspace_document(model: DataFrame, workspace: str, limit: int = 100_000) -> str:
    """One workspace of workspace_model() as a JSON document {section: [items]}; over ``limit`` items raise ValueError."""
    rows = model.where(F.col("workspace_id") == workspace).select("section", "item").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} items")
    sections = {n: sorted(r["item"] for r in rows if r["section"] == n) for n in ("tables", "columns", "relations")}
    return "{" + ", ".join(f'"{n}": [{", ".join(items)}]' for n, items in sections.items()) + "}"


# --- rebuild -----------------------------------------------------------------------------------------------------


def latest(raw: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the last by the order columns."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return raw.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def rebuild(raw: DataFrame, strategy: str = "sentence", **options) -> tuple[DataFrame, DataFrame, Index]:
    """Documents, chunks and search index from the raw layer alone: the latest row of each doc_id, chunked and indexed.

    Chunks are keyed by (doc_id, chunk_index). Running it again gives the same.
    """
    docs = latest(raw, "doc_id", "updated_at", "loaded_at")
    return docs, chunk(docs, "doc_id", "content", strategy, **options), build_index(docs, text="content")


def lookup_nanoid(documents: DataFrame, nanoid: str) -> DataFrame:
    """(workspace_id, collection_id, doc_id) of the latest row with a public id; an empty id is nobody's."""
    hit = documents.where((F.col("doc_nanoid") == nanoid) & (F.col("doc_nanoid") != ""))
    return latest(hit, "doc_id", "updated_at", "loaded_at").select("workspace_id", "collection_id", "doc_id")


def with_nanoids(documents: DataFrame, size: int = 21) -> DataFrame:
    """Documents with a doc_nanoid where they have none: ``size`` characters of a hash of workspace, collection and doc_id, so that a
    repeated ingest gives the same ids."""
    digest = F.sha2(F.concat_ws("|", "workspace_id", "collection_id", F.col("doc_id").cast("string")), 512)
    made = F.substring(F.translate(F.base64(F.unhex(digest)), "+/=\r\n", "_-"), 1, size)
    return documents.withColumn("doc_nanoid", F.coalesce(F.when(F.col("doc_nanoid") != "", F.col("doc_nanoid")), made))


def ingest_documents(raw: DataFrame, changes: DataFrame, strategy: str = "recursive_character", dry_run: bool = False, **options) -> dict[str, DataFrame]:
    """One step from delivered documents to the raw layer, chunks and index: {"report", "documents", "chunks", "postings"}.

    ``raw`` and ``changes`` have the columns of the raw layer (workspace_id, collection_id, doc_id, doc_nanoid, content, updated_at, ...). A
    change replaces the row of its doc_id unless that is later by updated_at; public ids are kept or made. report has (doc_id, change): 'new',
    'changed', 'same' or 'stale'. With ``dry_run`` only the report comes. Chunks and postings are those of the new and changed documents, to be
    put in place of the old ones by sync_documents().
    """
    now = latest(raw, "doc_id", "updated_at").select(F.col("doc_id"), F.col("updated_at").alias("_u"), F.md5("content").alias("_h"), F.col("doc_nanoid").alias("_n"))
    new = latest(changes, "doc_id", "updated_at")
    both = new.join(now, "doc_id", "left")
    change = (
        F.when(F.col("_u").isNull() & F.col("_h").isNull(), "new").when(F.col("_u") > F.col("updated_at"), "stale").when(F.col("_h").eqNullSafe(F.md5("content")), "same").otherwise("changed")
    )
    judged = both.withColumn("change", change).withColumn("doc_nanoid", F.coalesce(F.when(F.col("doc_nanoid") != "", F.col("doc_nanoid")), F.col("_n")))
    report = judged.select("doc_id", "change")
    if dry_run:
        return {"report": report}
    taken = with_nanoids(judged.where("change in ('new', 'changed')").select(*raw.columns))
    kept = raw.join(taken.select("doc_id"), "doc_id", "left_anti").select(*raw.columns)
    return {
        "report": report,
        "documents": kept.unionByName(taken.select(*raw.columns)),
        "chunks": chunk(taken, "doc_id", "content", strategy, **options),
        "postings": build_index(taken, text="content").postings,
    }


# --- queue -------------------------------------------------------------------------------------------------------


def read_queue(messages: DataFrame, queue: str, now: int, visibility: int, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """The messages a reader gets, and the table afterwards: the first visible ones by id, hidden until now + visibility.

    Visible are messages that are neither archived nor deleted and whose time of hiding is null or over.
    """
    free = (F.col("queue_name") == queue) & (F.col("archived") == 0) & (F.col("deleted") == 0)
    seen = F.col("vt_until_unix").isNull() | (F.col("vt_until_unix") <= now)
    got = messages.where(free & seen).orderBy("msg_id").limit(limit)
    mine = F.broadcast(got.select("msg_id", F.lit(True).alias("_mine")))  # at most ``limit`` rows
    after = messages.join(mine, "msg_id", "left")
    after = after.withColumn("read_ct", F.col("read_ct") + F.coalesce(F.col("_mine").cast("int"), F.lit(0)))
    after = after.withColumn("vt_until_unix", F.when(F.col("_mine"), F.lit(now + visibility).cast("long")).otherwise(F.col("vt_until_unix")))
    return got, after.drop("_mine").select(*messages.columns)


def settle(messages: DataFrame, ids: list[int], how: str) -> DataFrame:
    """The queue after messages were 'archived' or 'deleted'."""
    if how not in ("archived", "deleted"):
        raise ValueError(how)
    return messages.withColumn(how, F.when(F.col("msg_id").isin(*ids), 1).otherwise(F.col(how))) if ids else messages


def send(messages: DataFrame, queue: str, texts: DataFrame, now: int) -> DataFrame:
    """The queue with a message for each row of ``texts`` (message); ids are unique and above the greatest so far."""
    top = messages.agg(F.coalesce(F.max("msg_id"), F.lit(0))).first()[0]
    n = F.monotonically_increasing_id() + (top + 1)
    new = texts.select(
        n.cast("long").alias("msg_id"), F.lit(queue).alias("queue_name"), F.lit(0).alias("read_ct"), F.lit(now).cast("long").alias("enqueued_at_unix"),
        F.lit(None).cast("long").alias("vt_until_unix"), F.lit(0).alias("archived"), F.lit(0).alias("deleted"), "message",
    )
    return messages.unionByName(new)
