from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import ingest as ing
from tessera.operators import ontology as on
from tessera.operators import textprep as tp

T0 = datetime(2024, 1, 1)
LAW = "Ordinance\n\nArticle 1\nSee Decree 2024-10 and https://example.org/x).\n\nArticle 2\nAs in article 2 of this ordinance and more. Law\n\nart. 3 é"


def chunks(spark, text, strategy, **options):
    df = spark.createDataFrame([(7, text, "clash")], "k long, t string, content string")
    return ch.chunk(df, "k", "t", strategy, **options).orderBy("chunk_index").collect()


def test_chunk_strategies(spark):
    text = "One two. Three four!\n\nFive é six? Seven"
    got = chunks(spark, text, "fixed_token", target_tokens=3, overlap_tokens=1)
    assert [r["content"] for r in got] == ["One two. Three", "Three four!\n\nFive", "Five é six", "six? Seven"]
    assert [r["content"] for r in chunks(spark, text, "paragraph")] == ["One two. Three four!", "Five é six? Seven"]
    assert [r["content"] for r in chunks(spark, text, "sentence", max_chars=20)] == ["One two. Three four!", "Five é six? Seven"]
    assert [r["content"] for r in chunks(spark, text, "recursive_character", max_chars=13)] == ["One two.", "Three four!", "Five é six?", "Seven"]
    late = chunks(spark, text, "late", target_tokens=4, overlap_tokens=0)
    assert [(r["parent_chunk_index"], r["token_count"]) for r in late] == [(None, 8), (0, 4), (0, 4)]
    md = "intro\n# A\nbody\n```\n# no heading\n```\n## B\nend"
    assert [r["content"] for r in chunks(spark, md, "structure_aware")] == ["intro", "# A\nbody", "```\n# no heading\n```", "## B\nend"]
    articles = chunks(spark, LAW, "legal")
    assert [r["content"].split("\n")[0] for r in articles] == ["Article 1", "Article 2", "art. 3 é"]
    for r in [*got, *late, *articles]:
        source = (LAW if r in articles else text).encode()
        assert source[r["offset_start"] : r["offset_end"]].decode() == r["content"]
    for strategy in ch.STRATEGIES:
        assert chunks(spark, None, strategy) == [] and chunks(spark, "", strategy) == []
    with pytest.raises(ValueError):
        chunks(spark, text, "fixed_token", target_tokens=3, overlap_tokens=3)
    with pytest.raises(ValueError):
        chunks(spark, text, "unknown")


def test_fixed_tokens_cover_every_token():
    text = " ".join(f"w{i}" for i in range(23)).encode()
    for target in range(2, 9):
        for overlap in range(target):
            spans = ch.fixed_token(text, target, overlap)
            assert spans[-1][1] == len(text)
            assert [ch.count_tokens(text[s:e]) for s, e in spans[:-1]] == [target] * (len(spans) - 1)


def test_semantic_chunks():
    embed = lambda s: [[1.0, 0.0] if "a" in x else [0.0, 1.0] for x in s]
    assert ch.semantic(b"a. aa. b. bb.", embed, 0.5, 100, 5) == [(0, 6), (7, 13)]
    with pytest.raises(ValueError):
        ch.semantic(b"a. b.", lambda s: [], 0.5, 100, 5)


def test_policy_and_source_facets(spark, rows):
    assert ch.decide("legal_article", max_chars=9000) == {"strategy": "legal", "target_tokens": 512, "overlap_tokens": 32, "max_chars": 9000}
    df = spark.createDataFrame([(1, "a/b/C.TXT"), (2, None)], "k long, path string").withColumns({"chunk_index": F.lit(0), "strategy": F.lit("late")})
    got = rows(ch.source_facets(df, "k", "path"))
    assert (1, 0, "extension", "txt") in got and (1, 0, "directory", "b") in got and (2, 0, "chunk_count", "1") in got


def test_references_and_html(spark, rows):
    df = spark.createDataFrame([(1, LAW, "clash"), (2, None, None)], "k long, t string, kind string")
    got = rows(tp.extract_references(df, "k", "t"))
    assert {(1, "url", "https://example.org/x"), (1, "internal", "article 2 of this ordinance"), (1, "external", "Decree 2024-10")} <= got
    assert all(r[2].lower() != "law" for r in got)
    html = spark.range(1).select(tp.strip_html(F.lit("<html><p class='x'>One  <b>two</b></p><p>Three<br/>four</p>")).alias("t")).first()["t"]
    assert [x.strip() for x in html.strip().split("\n")] == ["One two", "Three", "four"]


def test_french_dutch(spark):
    text = "le service est dans la commune pour les lots\nhet bestuur van de gemeente is een dienst voor het gebouw\n"
    df = spark.createDataFrame([(1, text), (2, "hello"), (3, None)], "k long, t string")
    got = {(r["k"], r["language"]) for r in tp.split_french_dutch(df, "k", "t").collect()}
    assert got == {(1, "fr"), (1, "nl"), (2, "und")}


def test_budgets(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 30), ("g", 3, 41), ("h", 1, 5), ("g", 4, None)], "g string, k long, n long")
    got = {(r["g"], r["k"]): (r["char_limit"], r["truncated"]) for r in tp.prompt_limits(df, "g", "k", "n", 100).collect()}
    assert sum(v[0] for (g, _), v in got.items() if g == "g") == 100 and got["h", 1] == (5, False) and got["g", 4] == (0, False)
    batches = {(r["g"], r["k"]): r["batch"] for r in tp.budget_batches(df, "g", "k", "n", 80).collect()}
    assert batches == {("g", 1): 0, ("g", 2): 0, ("g", 3): 1, ("g", 4): 1, ("h", 1): 0}


def test_upserts(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, seq int")
    assert rows(ing.upsert(base, changes, ["k"], "seq")) == {(1, "a"), (2, "y"), (3, "z")}
    s = "workspace_id string, entity_type string, name string, entity_id long, confidence double, metadata_json string"
    old = spark.createDataFrame([("w", "t", "n", 1, 0.5, '{"a":1}', 9)], s + ", deprecated_at long")
    new = spark.createDataFrame([("w", "t", "n", 7, 0.4, "", 1), ("w", "t", "m", 8, 0.4, None, 1)], s + ", seq long")
    assert rows(ing.upsert_entities(old, new).select("name", "entity_id", "confidence", "metadata_json", "deprecated_at")) == {("n", 1, 0.5, '{"a":1}', None), ("m", 8, 0.4, "{}", None)}


def test_import(spark, rows):
    s = "workspace_id string, source_ref string, schema_id string, content string, facets_json string, seq int"
    facts = spark.createDataFrame([("w", "lot:1", "s", "a", '{"owner":"p:1"}', 1), ("w", "lot:1", "s", "b", '{"owner":"p:2"}', 2), ("w", "lot:2", "s", "c", "[1]", 1), (None, "x", "s", "c", "{}", 1)], s)
    out = ing.import_facts(facts)
    assert rows(out.select("source_ref", "content")) == {("lot:1", "b")}
    assert out.first()["id"].startswith("facet_") and len(out.first()["id"]) == 38
    assert ing.invalid_facts(facts).count() == 2
    edges = ing.derive_edges(out, [("owner", "owns")])
    assert rows(edges.select("external_id", "confidence")) == {("p:2|owns|lot:1", 0.85)}
    assert ing.merge_edges(edges, edges).count() == 1
    ents = spark.createDataFrame([("w", "lot:9")], "workspace_id string, external_id string")
    assert rows(ing.audit_orphans(out, ents)) == {("w", 1, 1, 1.0)}
    more = spark.createDataFrame([("w", "lot:1", "s", "new", "{}", 5), ("w", "lot:3", "s", "d", "{}", 5)], s)
    assert rows(ing.import_facts(more, out, "ignore_duplicates").select("source_ref", "content")) == {("lot:1", "b"), ("lot:3", "d")}
    assert rows(ing.import_facts(more, out, "append").select("content")) == {("new",), ("d",)}
    bad = ing.validate_bundle({"a": facts}, {"a": ["workspace_id", "nope"]}, [("a", "source_ref", "a", "content")])
    assert rows(bad.select("problem", "n")) == {("missing_column", 1), ("null_in_required", 1), ("unknown_reference", 4)}


def test_patch(spark, rows):
    e = spark.createDataFrame([("w", "t", "n", 1, 0.5, "{}", None)], "workspace_id string, entity_type string, name string, entity_id long, confidence double, metadata_json string, deprecated_at long")
    r = spark.createDataFrame([("k", 1, 2, None, 5, 0.5, None, None, None)], "relation_type string, source_id long, target_id long, run_id long, relation_id long, confidence double, valid_from long, valid_to long, deprecated_at long")
    p = "action string, seq long, at long, workspace_id string, entity_type string, name string, entity_id long, confidence double, metadata_json string, relation_type string, source_id long, target_id long, run_id long, relation_id long, valid_from long, valid_to long"
    patch = spark.createDataFrame(
        [("upsert_entity", 1, 9, "w", "t", "m", 2, 0.9, "{}", None, None, None, None, None, None, None), ("deprecate", 2, 9, None, None, None, 1, None, None, None, None, None, None, 5, None, None)], p
    )
    ents, rels = ing.apply_patch(e, r, patch)
    assert rows(ents.select("name", "deprecated_at")) == {("n", 9), ("m", None)}
    assert rows(rels.select("relation_id", "deprecated_at")) == {(5, 9)}
    with pytest.raises(Exception, match="unknown patch action"):
        ing.apply_patch(e, r, patch.withColumn("action", F.lit("drop")))[0].collect()
    assert [ing.learn_from_run(x) for x in ("success", "partial", "failed")] == [1.0, 0.6, 0.2]


def test_queue(spark):
    s = "msg_id long, queue_name string, read_ct int, enqueued_at_unix long, vt_until_unix long, archived int, deleted int, message string"
    q = spark.createDataFrame([], s)
    q = ing.send(q, "a", spark.createDataFrame([("x",), ("y",)], "message string"), 100)
    got, q = ing.read_queue(q, "a", 100, 30, 1)
    first = got.first()["msg_id"]
    got, q = ing.read_queue(q, "a", 110, 30, 5)
    assert first not in [r["msg_id"] for r in got.collect()]
    q = ing.settle(q, [first], "archived")
    got, _ = ing.read_queue(q, "a", 200, 30, 5)
    assert len(got.collect()) == 1 and q.where("read_ct = 1").count() == 2


def test_profile_and_ontology(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id long, v string")
    assert rows(ing.profile(df).select("column_name", "n_rows", "n_filled")) == {("id", 3, 3), ("v", 3, 1)}
    assert rows(ing.infer_semantics(df).select("column_name", "column_role")) == {("id", "id"), ("v", "attribute")}
    t = [
        ("iri", "http://x/A", on.RDF_TYPE, "iri", on.CLASSES[0]), ("iri", "http://x/a", on.RDF_TYPE, "iri", "http://x/A"), ("iri", "http://x/a", "http://x#knows", "blank", "_:b"),
        ("iri", "http://x/a", "http://x#age", "literal", "3"), ("iri", "http://x/", on.RDF_TYPE, "iri", on.ONTOLOGY), ("iri", "http://x/a", "http://x#knows", "blank", "_:b"),
    ]
    nodes, rel = on.project_triples(spark.createDataFrame(t, "subject_kind string, subject string, predicate string, object_kind string, object_value string"))
    assert rows(nodes.select("iri", "node_type")) == {("http://x/A", "owl_class"), ("http://x/a", "A"), ("_:b", "blank_node")}
    assert [r["edge_type"] for r in rel.collect()] == ["knows"]
    kinds = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "z")], "workspace_id string, type_name string")
    assert rows(on.compare_workspaces(kinds, "a", "b")) == {("x", "shared"), ("y", "only_a"), ("z", "only_b")}
    ents = spark.createDataFrame([("a", "t", 1, "Building one"), ("b", "t", 2, "building 0ne"), ("b", "u", 3, "building one")], "workspace_id string, entity_type string, entity_id long, name string")
    assert rows(on.entity_bridges(ents, "a", "b").select("id_a", "id_b")) == {(1, 2)}


def test_bridges_lose_no_pair(spark, rows):
    import random

    r = random.Random(7)
    words = ["customer_name", "xcustomer_name", "address_line", "adress_line", "ustomer_name", "customer_nam", "a", "ab", "A", "", None, "é" * 9 + "x", "é" * 10, "aaaaa", "aaaab", "baaaa"]
    for w in [w for w in words if w and len(w) > 4] * 12:
        for _ in range(r.randrange(1, 4)):
            i = r.randrange(len(w) + 1)
            w = w[:i] + r.choice(["", "a", "xy", "_"]) + w[i + r.randrange(2) :]
        words.append(w)
    data = [(side, "t", i, w) for side in "ab" for i, w in enumerate(words)]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    ents = spark.createDataFrame(data, "workspace_id string, entity_type string, entity_id long, name string")
    score = {(i, j): 1 - distance(x.lower(), y.lower()) / max(len(x), len(y)) for i, x in enumerate(words) for j, y in enumerate(words) if x and y}
    assert score[0, 1] >= 0.8 and score[2, 3] >= 0.8
    for threshold in (0.8, 0.7, 0.4):
        got = on.entity_bridges(ents, "a", "b", threshold).select("id_a", "id_b").collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == {k for k, v in score.items() if v >= threshold}


def test_semantic_and_late_chunks(spark, rows):
    import math

    text = "One two. Three four. Five six. Seven. Eight nine ten."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Alone here.")], "id long, text string")
    sentences = ch.sentence_table(docs, "id", "text")
    assert sentences.where("id = 1").count() == 5 and rows(sentences.select("id")) == {(1,), (4,)}
    axis = {0: [1.0, 0.0], 1: [2.0, 0.1], 2: [0.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 3.0]}
    vectors = spark.createDataFrame([(1, i, v) for i, v in axis.items()], "id long, sentence_index int, values array<double>")
    got = [(r["content"], r["token_count"]) for r in ch.semantic_chunks(docs, "id", "text", vectors).where("id = 1").orderBy("chunk_index").collect()]
    assert got == [("One two. Three four.", 4), ("Five six.", 2), ("Seven.", 1), ("Eight nine ten.", 3)]
    assert ch.semantic_chunks(docs, "id", "text", vectors, max_sentences=1).where("id = 1").count() == 5
    assert [r["content"] for r in ch.semantic_chunks(docs, "id", "text", vectors).where("id = 4").collect()] == ["Alone here."]
    tokens = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(11)], "id long, token_index int, values array<double>")
    windows = {r["chunk_index"]: r["values"] for r in ch.late_vectors(tokens, "id", 4, 1).collect()}
    spans = [(m["chunk_index"], m["token_count"]) for m in ch.chunk(spark.createDataFrame([(1, " ".join("x" * 11))], "id long, text string"), "id", "text", "late", 4, 1).collect()]
    assert sorted(windows) == sorted(k for k, _ in spans) and windows[0] == [5.0, 1.0]
    for k, n in spans[1:]:
        first = (k - 1) * 3
        assert math.isclose(windows[k][0], sum(range(first, first + n)) / n)


def test_one_step_ingest(spark, rows):
    schema = "workspace_id string, collection_id string, doc_id long, doc_nanoid string, content string, updated_at timestamp, loaded_at timestamp"
    at = lambda n: T0 + timedelta(days=n)
    raw = spark.createDataFrame([("w", "c", 1, "pub", "old", at(1), at(1)), ("w", "c", 2, None, "same", at(1), at(1)), ("w", "c", 3, "", "late", at(9), at(9))], schema)
    new = spark.createDataFrame([("w", "c", 1, None, "new words", at(2), at(2)), ("w", "c", 2, None, "same", at(2), at(2)), ("w", "c", 3, None, "stale", at(2), at(2)), ("w", "c", 4, None, None, at(2), at(2)), ("w", "c", None, None, "x", at(2), at(2))], schema)
    step = ing.ingest_documents(raw, new, "sentence")
    assert rows(step["report"]) == {(1, "changed"), (2, "same"), (3, "stale"), (4, "new")}
    assert rows(step["documents"].select("doc_id", "content")) == {(1, "new words"), (2, "same"), (3, "late"), (4, None)}
    assert rows(step["chunks"].select("doc_id", "content")) == {(1, "new words")} and step["postings"].count() == 2
    assert set(ing.ingest_documents(raw, new, dry_run=True)) == {"report"}
    ids = {r["doc_id"]: r["doc_nanoid"] for r in step["documents"].collect()}
    assert ids[1] == "pub" and len(ids[4]) == 21
    assert rows(ing.lookup_nanoid(step["documents"], "pub")) == {("w", "c", 1)} and ing.lookup_nanoid(raw, "").collect() == []


def test_workspace_documents(spark):
    import json

    tables = spark.createDataFrame([("w", 1, "s", "t"), ("w", 1, "s", "t")], "workspace_id string, table_id long, table_schema string, table_name string")
    columns = spark.createDataFrame([("w", 1, 5, "c", "text")], "workspace_id string, table_id long, column_semantic_id long, column_name string, data_type string")
    relations = spark.createDataFrame([("v", 9, "t", "u", "k")], "workspace_id string, relation_semantic_id long, from_table string, to_table string, fk_column string")
    model = ing.workspace_model(tables, columns, relations)
    assert model.count() == 3
    assert json.loads(ing.workspace_document(model, "w")) == {"tables": [{"table_id": 1, "table_schema": "s", "table_name": "t"}], "columns": [{"table_id": 1, "column_semantic_id": 5, "column_name": "c", "data_type": "text"}], "relations": []}
    with pytest.raises(ValueError):
        ing.workspace_document(model, "w", 1)
