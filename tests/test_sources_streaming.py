import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import linkml, rdf, tabular, toon
from tessera.streaming import jobs


def test_csv_and_bundle(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,text\n1,"x, ""y""\nz"\n2,\n')
    df = tabular.read_table_file(spark, str(tmp_path / "a.csv"))
    assert rows(df) == {("1", 'x, "y"\nz'), ("2", None)}
    (tmp_path / "b.tsv").write_text('k\tv\n1\t"q\n2\t\\N\n')
    assert rows(tabular.read_table_file(spark, str(tmp_path / "b.tsv"))) == {("1", '"q'), ("2", None)}
    (tmp_path / "c.json").write_text('{"a": 1, "b": true}\n')
    assert rows(tabular.read_table_file(spark, str(tmp_path / "c.json"))) == {("1", "true")}
    with pytest.raises(ValueError):
        tabular.read_table_file(spark, "x.pdf")
    tables = {"a": df, "n": spark.createDataFrame([(1, None)], "x int, y timestamp")}
    tabular.export_bundle(tables, str(tmp_path / "bundle"))
    back = tabular.import_bundle(spark, str(tmp_path / "bundle"))
    assert rows(back["a"]) == rows(df) and back["n"].schema == tables["n"].schema
    assert rows(tabular.bundle_summary(back)) == {("a", 2, 2), ("n", 1, 2)}
    assert tabular.run_sql(spark, "select count(*) n from a where id = :id", {"a": df}, id="1").first()["n"] == 1


def test_toon(spark, tmp_path, rows):
    text = 'people[2]{id,name,active}:\n  1,Ari,true\n  2,"B, \\"q\\"",false\n'
    (tmp_path / "p.toon").write_text(text)
    df = toon.read_toon(spark, str(tmp_path / "p.toon"))
    assert rows(df) == {("1", "Ari", "true"), ("2", 'B, "q"', "false")}
    out = toon.to_toon(spark.createDataFrame([(1, "a,b", None, "7")], "i int, s string, n string, d string"), "t")
    assert out == 't[1]{i,s,n,d}:\n  1,"a,b",null,"7"'
    assert toon.parse(out)["t"][1] == [["1", "a,b", "null", "7"]]
    with pytest.raises(ValueError):
        toon.parse("t[2]{a}:\n  1\n")
    with pytest.raises(ValueError):
        toon.to_toon(spark.range(5), "t", 4)
    toon.write_toon(df, "people", str(tmp_path / "out"))
    head = spark.read.text(str(tmp_path / "out/head")).first()[0]
    body = [r[0] for r in spark.read.text(str(tmp_path / "out/rows")).collect()]
    assert {tuple(x) for x in toon.parse("\n".join([head, *body]))["people"][1]} == rows(df)


def test_ntriples(spark, tmp_path, rows):
    lines = ['<http://x/a> <http://x/p> "v \\"q\\" \\\\ é"@fr .', "_:b <http://x/p> <http://x/c> . # note", '<http://x/a> <http://x/n> "3"^^<http://t> .', "# comment", "", "broken line"]
    (tmp_path / "t.nt").write_text("\n".join(lines))
    df = rdf.read_ntriples(spark, str(tmp_path / "t.nt"))
    assert df.count() == 3
    assert ("iri", "http://x/a", "http://x/p", "literal", 'v "q" \\ é', "fr", None) in rows(df)
    assert [r[0] for r in rdf.bad_lines(spark, str(tmp_path / "t.nt")).collect()] == ["broken line"]
    rdf.write_ntriples(df, str(tmp_path / "out"))
    assert rows(rdf.read_ntriples(spark, str(tmp_path / "out"))) == rows(df)
    (tmp_path / "y.ttl").write_text('@prefix x: <u> .\nx:a rdfs:label "Name"@en .\n# c\n')
    assert rows(rdf.read_turtle_facts(spark, str(tmp_path / "y.ttl"))) == {("x:a", "rdfs:label", '"Name"@en')}


def test_linkml(spark, rows):
    files = {
        "base": "classes:\n  Thing:\n    abstract: true\n    slots: [name]\nslots:\n  name:\n    required: true\n",
        "main": "imports:\n- linkml:types\n- base\nclasses:\n  Unit:\n    is_a: Thing\n    slots:\n      - owner\n      - state\n  Person:\nslots:\n  owner:\n    range: Person\n    multivalued: true\n  state:\n    range: State\nenums:\n  State:\n    permissible_values:\n      new:\n      old: {}\n",
    }
    schema = linkml.load("main", files.__getitem__)
    tables = linkml.compile_schema(spark, schema, "o")
    assert rows(tables["edge_types"].select("class_name", "slot", "range", "multivalued")) == {("Unit", "owner", "Person", True)}
    assert rows(tables["properties"].select("class_name", "slot", "range", "required")) == {("Thing", "name", "string", True), ("Unit", "name", "string", True), ("Unit", "state", "State", False)}
    again = linkml.compile_schema(spark, linkml.parse_yaml(linkml.export_schema(tables, "o")), "o")
    assert all(rows(again[k]) == rows(tables[k]) for k in tables)
    with pytest.raises(ValueError):
        linkml.load("a", {"a": "imports: [b]\n", "b": "imports: [a]\n"}.__getitem__)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_windows_stream(spark, tmp_path, rows):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"ts": "2024-01-01T00:01:00Z", "k": "a"}\n{"ts": "2024-01-01T00:02:00Z", "k": "a"}\n')
    time.sleep(0.05)
    (src / "2.json").write_text('{"ts": "2024-01-01T02:00:00Z", "k": "a"}\n')
    counted = jobs.windowed_counts(_stream(spark, src, "ts timestamp, k string"), "ts", ["k"], "5 minutes")
    q = counted.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.table("win").collect()] == [2]


def test_delta_stream(spark, tmp_path, rows):
    src = tmp_path / "in"
    src.mkdir()
    change = '{{"doc_id": {}, "facet_name": "f", "facet_value": "v", "delta": {}, "seq": {}}}\n'
    (src / "1.json").write_text(change.format(1, 1, 1) + change.format(2, 1, 2))
    time.sleep(0.05)
    (src / "2.json").write_text(change.format(1, -1, 3))
    start = spark.createDataFrame([(9, "f", "v")], "doc_id long, facet_name string, facet_value string")
    schema = "doc_id long, facet_name string, facet_value string, delta int, seq int"
    job = jobs.merge_facet_deltas(_stream(spark, src, schema), start, str(tmp_path / "state"), str(tmp_path / "cp"))
    job.trigger(availableNow=True).start().awaitTermination(120)
    state = jobs.Versions(spark, str(tmp_path / "state"))
    assert rows(state.read()) == {(9, "f", "v"), (2, "f", "v")} and rows(state.read(1)) == {(9, "f", "v"), (1, "f", "v"), (2, "f", "v")}


def test_rule_stream_and_queue(spark, tmp_path, rows):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "ok": false}\n')
    time.sleep(0.05)
    (src / "2.json").write_text('{"id": 1, "ok": true}\n{"id": 2, "ok": true}\n')
    judge = lambda b: b.select(F.lit("r").alias("rule_id"), F.col("id").alias("entity_id"), F.when(F.col("ok"), "valid").otherwise("invalid").alias("state"))
    job = jobs.track_rules(_stream(spark, src, "id long, ok boolean"), judge, str(tmp_path / "rules"), str(tmp_path / "cp"))
    job.trigger(availableNow=True).start().awaitTermination(120)
    events = jobs.Versions(spark, str(tmp_path / "rules/events")).read()
    assert rows(events.select("entity_id", "from_state", "to_state", "remediation")) == {(1, "invalid", "valid", True), (2, "unknown", "valid", False)}
    seen = []
    job = jobs.consume_queue(_stream(spark, src, "id long, ok boolean"), lambda b: seen.extend(r["id"] for r in b.collect()), str(tmp_path / "cp2"))
    job.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [1, 1, 2]


def test_state_in_buckets(spark, tmp_path, rows):
    """Batches rewrite what they touch, may run again, and old versions go."""
    state = jobs.Versions(spark, str(tmp_path / "s"), ["k"], 4, 2)
    assert state.read() is None
    add = lambda old, new: new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)
    frame = lambda *data: spark.createDataFrame(list(data), "k long, v int")
    want = {}
    for n in range(12):
        data = [(n % 5, n), (n + 100, n)]
        state.change(frame(*data), n, add)
        state.change(frame(*data), n, add)  # the same batch again
        want.update(data)
        assert rows(state.read()) == set(want.items())
    state.change(frame(), 12, add)
    assert len(state._touched()) < 12 and rows(jobs.Versions(spark, str(tmp_path / "s")).read()) == set(want.items())


def test_folder_for_a_cluster(spark, monkeypatch):
    from tessera import runtime

    class Far:
        master = "spark://host:7077"

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Far

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster)
