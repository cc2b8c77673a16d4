"""Entities, graph, storage, retrieval, configuration, sources and streaming."""

import pytest
from pyspark.sql import functions as F

from scrollsift import config
from scrollsift.functions import patterns as P
from scrollsift.functions import text as T
from scrollsift.operators import entities as E
from scrollsift.operators import embedding as M
from scrollsift.operators import graph as G
from scrollsift.operators import index as I
from scrollsift.operators import report as R
from scrollsift.operators import retrieval as V
from scrollsift.operators import sessions as N
from scrollsift.operators import storage as S
from scrollsift.sources import captures as C
from scrollsift.streaming import ingest

REGISTRY = P.Registry()
TEXT = "Host 10.0.0.5 has 22/tcp open OpenSSH/8.2, CVE-2021-44228\npassword: hunter2\n10.0.0.5 /etc/passwd ö@x.org"


@pytest.fixture(scope="module")
def found(spark):
    return E.extract(spark.createDataFrame([(1, 10, TEXT), (2, 20, "")], "capture_id long, ts long, output string"), REGISTRY)


def test_entities_and_places(found):
    rows = found.collect()
    assert {r.type for r in rows} >= {"ip_address", "port", "service_version", "cve", "credential_password", "file_path_unix"}
    assert all(TEXT[r.start : r.end] == r.value for r in rows)
    one = next(r for r in rows if r.type == "credential_password")
    assert one.redact and one.value == "password: hunter2"
    assert one.context == TEXT[max(0, one.start - 80) : one.end + 80]


def test_entity_views(found):
    assert E.of_type(found, "ip_address").count() == 2
    assert E.at_least(found, 1.0).select("type").distinct().collect()[0].type == "cve"
    assert all(r.value == "[REDACTED]" for r in E.redacted_samples(found).filter("type like 'credential%'").collect())
    meta = E.capture_metadata(found).first()
    assert meta.hosts[:2] == ["10.0.0.5", "10.0.0.5"] and meta.vulnerabilities == ["CVE-2021-44228"] and meta.has_sensitive
    assert "entity_count" in E.metadata_json(E.capture_metadata(found)).first().metadata


def test_graph_of_one_capture(found):
    node = G.host_nodes(found).filter("host = '10.0.0.5'").first()
    assert (node.ports, node.services, node.vulnerabilities, node.credentials) == ([22], {22: "OpenSSH"}, ["CVE-2021-44228"], 2)
    assert node.paths == ["/8.2", "/etc/passwd", "/tcp"]
    assert "total_hosts" in G.stats_json(found).first().stats
    assert R.findings(found).count() == 1 and R.credentials(found).first().n == 1


def test_tools_and_sections(spark):
    df = spark.createDataFrame([("nmap -sV h", "22/tcp  open"), ("x -h", ""), (None, "")], "command string, line string")
    rows = E.classified_lines(E.with_tool(df, REGISTRY), REGISTRY).collect()
    assert [(r.tool, r.sections) for r in rows] == [("nmap", ["open_port"])]
    assert {r.tool for r in E.with_tool(df, REGISTRY).collect()} == {"nmap", "nikto", None}


def test_templates_round_trip(tmp_path):
    assert len(P.install_templates(str(tmp_path))) == 3
    assert P.install_templates(str(tmp_path)) == []
    assert P.load(*(str(tmp_path / f"{n}.toml") for n in ("entities", "tools", "filters"))) == REGISTRY


def test_bad_pattern_fails():
    with pytest.raises(ValueError):
        P.Registry(entities=(P.EntityPattern("x", "(", 1.0, 1),))


def test_storage(spark):
    captures = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b" * 2000), (4, "")], "ts long, output string")
    blobs = S.blobs(captures)
    assert sorted((r["size"], r.ref_count, r.compressed) for r in blobs.collect()) == [(0, 1, False), (1, 2, False), (2000, 1, True)]
    assert sum(r.ref_count for r in S.merged_blobs(blobs, blobs).collect()) == 8
    refs = blobs.filter("size = 1").select("hash")
    assert tuple(S.gc_stats(blobs, refs).first()) == (3, 2, 2000)
    assert S.unreferenced(blobs, refs).count() == 2


def test_blob_contents(spark):
    captures = spark.createDataFrame([("a",), ("a",), ("b",)], "output string")
    contents = S.blob_contents(captures)
    digest = contents.filter("content = 'b'").first()["hash"]
    assert [r.content for r in S.content_of(contents, digest).collect()] == ["b"] and S.content_of(contents, "x").count() == 0
    asked = spark.createDataFrame([(digest,), ("x",)], "hash string")
    assert {r["hash"]: r.present for r in S.has_blob(contents, asked).collect()} == {digest: True, "x": False}
    assert [r.content for r in S.without_blobs(contents, asked).collect()] == ["a"]


def test_session_files(spark, tmp_path):
    C.save_session(str(tmp_path), {"id": "s1", "name": "n", "status": "active", "capture_count": 2})
    C.save_session(str(tmp_path), {"id": "s2", "name": "m"})
    assert sorted((r.id, r.name, r.capture_count) for r in C.session_files(spark, str(tmp_path)).collect()) == [("s1", "n", 2), ("s2", "m", None)]
    C.delete_session(str(tmp_path), "s2")
    assert [r.id for r in C.session_files(spark, str(tmp_path)).collect()] == ["s1"]
    with pytest.raises(LookupError):
        C.delete_session(str(tmp_path), "s2")


def test_hook_lands_commands_that_can_be_decoded(spark, tmp_path):
    import subprocess

    script = C.hook("bash", str(tmp_path), "s1").splitlines()
    body = "\n".join(line for line in script if "PROMPT_COMMAND" not in line).replace("$(HISTTIMEFORMAT= history 1 | sed 's/^ *[0-9]* *//')", "$LINE")
    for line in ('grep "a\\b" f', "", "scrollsift status", "ls"):
        subprocess.run(["bash", "-c", f"{body}\n_land_command"], env={"LINE": line, "PATH": "/usr/bin:/bin"}, check=True)
    rows = C.accepted(C.decoded(spark.read.text(str(tmp_path)))).collect()
    assert sorted(r.command for r in rows) == ['grep "a\\b" f', "ls"] and {r.session_id for r in rows} == {"s1"}
    assert "precmd" in C.hook("zsh", "f", "s")
    with pytest.raises(ValueError):
        C.hook("fish", "f", "s")


def test_report_folders(spark, tmp_path):
    at = R.layout(spark, str(tmp_path), "s")
    assert sorted(at) == ["evidence", "export"] and (tmp_path / "reports" / "s" / "export").is_dir()


def test_patterns_compile_in_spark(spark):
    REGISTRY.check(spark)
    with pytest.raises(ValueError, match="for Spark"):
        P.Registry(entities=(P.EntityPattern("x", "(?P<name>a)", 1.0, 1),)).check(spark)


def test_metadata_decoding_has_defaults(spark, found):
    encoded = E.metadata_json(E.capture_metadata(found))
    assert E.metadata_decoded(encoded).first() == E.capture_metadata(found).first()
    broken = E.metadata_decoded(encoded.withColumn("metadata", F.lit("nonsense"))).first()
    assert (broken.entity_types, broken.entity_count, broken.has_sensitive) == ([], 0, False)


def test_graph_grows_by_batches(spark, found, tmp_path):
    E.enrich(found, str(tmp_path / "g")).collect()
    nodes = G.nodes(spark.read.parquet(str(tmp_path / "g")))
    assert sorted(map(tuple, nodes.select("host", "ports").collect())) == sorted(map(tuple, G.host_nodes(found).select("host", "ports").collect()))
    assert G.host(nodes, "10.0.0.5").count() == 1 and G.service(G.service_nodes(found), "OpenSSH").count() == 1
    assert '"host":"10.0.0.5"' in G.hosts_json(G.host(nodes, "10.0.0.5")).first().node


def test_migrate(spark):
    spark.sql("DROP DATABASE IF EXISTS migrating CASCADE")
    assert [S.migrate(spark, "migrating"), S.migrate(spark, "migrating")] == [0, 1]
    spark.sql("DROP DATABASE migrating CASCADE")


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "A fox, test document"), (3, "python programming CVE-2021-44228"), (4, None)], "id long, text string")
    index = I.KeywordIndex.create(docs, str(tmp_path / "k"))
    assert {r.id for r in index.bm25("FOX").collect()} == {1, 2}
    assert [r.id for r in index.phrase("test document").collect()] == [2] and index.phrase("document test").count() == 0
    assert [r.id for r in index.bm25("CVE-2021-44228").collect()] == [3]
    with pytest.raises(ValueError):
        index.bm25("  ")
    index.add(spark.createDataFrame([(2, "a fox again"), (5, "fox fox fox test")], docs.schema))
    assert tuple(index.size().first()) == (6, 5) and sorted(r.id for r in index.bm25("fox").collect()) == [1, 2, 2, 5]
    index.delete(docs.filter("id = 1").select("id"))
    for left in (index, I.KeywordIndex.load(spark, index.folder), index.merge()):
        assert tuple(left.size().first()) == (5, 4) and sorted(r.id for r in left.bm25("fox").collect()) == [2, 2, 5]
    index.clear()
    with pytest.raises(ValueError):
        I.KeywordIndex.load(spark, index.folder)


def test_repeated_terms_of_a_phrase(spark, tmp_path):
    docs = spark.createDataFrame([(1, "go go go now"), (2, "go now go"), (3, "now go go")], "id long, text string")
    index = I.KeywordIndex.create(docs, str(tmp_path / "k"))
    assert sorted(r.id for r in index.phrase("go go").collect()) == [1, 3]
    assert sorted(r.id for r in index.phrase("go go now").collect()) == [1]


def test_query_reads_its_own_buckets(spark, tmp_path):
    index = I.KeywordIndex.create(spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, text string"), str(tmp_path / "k"))
    plan = index.read(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_knn(spark, tmp_path):
    unit = [[1.0, 0, 0], [0, 1.0, 0], [0.9, 0.1, 0], [1.0, 0]]
    df = spark.createDataFrame([(i + 1, [float(x) for x in v]) for i, v in enumerate(unit)], "id long, vector array<float>")
    assert [(r.id, r.score) for r in I.knn(df, [1.0, 0, 0], 2).collect()] == [(1, 1.0), (3, 0.993884)]
    assert [r.id for r in I.dimension_errors(df, 3).collect()] == [4]
    index = I.VectorIndex.create(df, str(tmp_path / "v"), 3)
    assert [(r.id, r.score) for r in index.search([2.0, 0, 0], 2, None).collect()] == [(1, 1.0), (3, 0.993884)]
    assert (index.size(), I.VectorIndex.load(spark, index.folder).dimension()) == (3, 3)
    with pytest.raises(ValueError):
        index.search([1.0], 2)
    index.clear()
    assert index.size() == 0 and index.search([1.0, 0, 0], 2).count() == 0
    index.add(df)
    assert index.size() == 3


def test_pruned_vector_search_finds_most_of_the_nearest(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = I.VectorIndex.create(rows, str(tmp_path / "v"), len(rows.first().vector))
    exact = {(r.query, r.id) for r in I.knn_blocks(rows, rows.filter("id % 50 = 0"), 10, 100).collect()}
    found = {(q.id, r.id) for q in rows.filter("id % 50 = 0").collect() for r in index.search(list(q.vector), 10, 16).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_embedder_is_unit_and_keeps_empty_rows(spark):
    provider = M.HashingProvider()
    rows = M.embedded(spark.createDataFrame([(1, "some text"), (2, ""), (3, None)], "id long, text string"), provider).orderBy("id").collect()
    assert len(rows[0].vector) == 384 and rows[1].vector is None and rows[2].vector is None
    assert sum(x * x for x in rows[0].vector) == pytest.approx(1.0, abs=1e-5)
    assert rows[0].vector == pytest.approx([float(x) for x in provider.embed("some text")])
    with pytest.raises(ValueError):
        M.HashingProvider("none")
    with pytest.raises(ValueError):
        provider.embed(" ")


def test_embedding_job_counts_failures_and_fills_both_indexes(spark, tmp_path):
    provider = M.HashingProvider()
    vectors = I.VectorIndex.create(spark.createDataFrame([], "id long, vector array<float>"), str(tmp_path / "v"), provider.dimension)
    keywords = I.KeywordIndex.create(spark.createDataFrame([], "id long, text string"), str(tmp_path / "k"))
    chunks = spark.createDataFrame([(1, "open port"), (2, " "), (3, "closed port")], "id long, text string")
    assert tuple(M.process(chunks, provider, keywords, vectors).first()) == (2, 1)
    assert sorted(r.id for r in keywords.bm25("port").collect()) == [1, 3]
    assert [r.id for r in V.nearest(vectors, "open port", 1, provider).collect()] == [1]
    M.process_background(spark.createDataFrame([(4, "open door")], chunks.schema), provider, keywords, vectors).join()
    captures = spark.createDataFrame([(i, "s", "nmap x", "nmap", i) for i in (1, 3, 4)], "capture_id long, session_id string, command string, tool string, ts long")
    hydrated = spark.createDataFrame([(1, "open port", 1, "h"), (3, "closed port", 3, "h"), (4, "open door", 4, "h")], "id long, text string, capture_id long, blob_hash string")
    found = V.search(V.Query("open port", 2), provider, hydrated, captures, vectors, keywords).collect()
    assert found[0].id == 1 and len(found) == 2
    assert V.search(V.Query("open port", 2, min_similarity=1.0), provider, hydrated, captures, vectors, keywords).count() == 0
    assert [r.id for r in V.search(V.Query("open", 2, since=4, prefilter=True), provider, hydrated, captures, vectors, keywords).collect()] == [4]


def test_fusion(spark):
    ranks = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, rank int")
    fused = {r.id: r.score for r in V.fuse(ranks([1, 2, 3, 4]), ranks([2, 1, 5, 4])).collect()}
    assert fused == {1: 0.016314, 2: 0.016208, 4: 0.015625, 3: 0.011111, 5: 0.004762}
    with pytest.raises(ValueError):
        V.Fusion(60.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        V.Query(" ")


def test_first_per_id(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.8), (1, 0.7)], "id long, score double")
    assert sorted((r.id, r.score) for r in V.first_per_id(df).collect()) == [(1, 0.9), (2, 0.8)]


def test_scalars(spark):
    one = lambda expr, value, kind="string": spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x
    assert [one(T.parse_port, v) for v in ("22/tcp", "99999/tcp", "x", "")] == [22, None, None, None]
    assert tuple(one(T.parse_service, "Apache/2.4.41")) == ("Apache", "2.4.41") and one(T.parse_service, "a/b/c") is None
    assert [one(T.format_size, v, "double") for v in (0.0, 1023.0, 1024.0)] == ["0.00 B", "1023.00 B", "1.00 KB"]
    assert one(lambda c: T.preview(c, 3), "äöüß") == "äöü..."
    assert [config.flush_seconds(v) for v in ("5s", "500ms", "7", "x")] == [5, 0.5, 7, 5]


def test_sessions(spark):
    events = spark.createDataFrame([("a", "n", 1, "start"), ("a", "n", 2, "pause"), ("b", None, 3, "start"), ("b", None, 5, "stop")], "session_id string, name string, t long, event string")
    rows = {r.session_id: r for r in N.folded(events.withColumn("ts", F.timestamp_seconds("t"))).collect()}
    assert (rows["a"].status, rows["b"].status_label, rows["b"].name) == ("paused", "Stopped", "session_19700101_000003")


def test_config(tmp_path):
    path = str(tmp_path / "c.toml")
    config.Config(profiles={"p": {"embedding_mode": "online"}}).save(path)
    assert config.Config.load(path, env={}) == config.Config(profiles={"p": {"embedding_mode": "online"}})
    assert config.Config.load(path, "p", {"SCROLLSIFT_LLM__MODEL": "m"}).embedding.mode == "online"
    assert config.Config.load(path, "none", {"SCROLLSIFT_LLM__MODEL": "m"}).llm.model == "m"
    with pytest.raises(ValueError, match="embedding.mode"):
        config.Config.load(path, env={"SCROLLSIFT_EMBEDDING__MODE": "x"})


def test_messages(spark):
    rows = [('{"type":"capture","session_id":"s","timestamp":5,"command":"c","output":"o","exit_code":0,"cwd":"/"}',), ("nope",), ('{"type":"status"}',)]
    decoded = C.decoded(spark.createDataFrame(rows, "value string"), 200)
    assert C.accepted(decoded).first().output == "o" and C.accepted(decoded).count() == 1
    assert [r.reject for r in C.rejected(decoded).collect()] == ["malformed"]
    assert [r.reject for r in C.rejected(C.decoded(spark.createDataFrame(rows[:1], "value string"), 10)).collect()] == ["oversize"]


def test_output_files(spark, tmp_path):
    (tmp_path / "a").write_bytes("é".encode())
    (tmp_path / "b").write_bytes(b"\xff\xfe")
    assert sorted(r.output for r in C.output_files(spark, str(tmp_path)).collect()) == ["", "é"]


def test_export(spark, tmp_path):
    out = R.export({"t": spark.range(5)}, str(tmp_path)).first()
    assert (out.name, out.rows) == ("t", 5)


def test_streaming_first_tier(spark, tmp_path):
    schema = "capture_id long, session_id string, ts long, output string"
    landing, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = 0
    for k, text in enumerate(("R\nR\nR\nN", "R\nN\nN\nN")):
        spark.createDataFrame([(k, "s", k, text)], schema).coalesce(1).write.mode("append").parquet(landing)
        lines = ingest.tier1(spark.readStream.schema(schema).parquet(landing), REGISTRY)
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).count()
        assert rows - kept == (4, 2)[k]
        kept = rows
    assert [(r.session_id, r.forms) for r in ingest.state_gauge(spark, state).collect()] == [("s", 2)]
    assert ingest.reset(spark, state) and not ingest.reset(spark, state)


def test_ingest_stream(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    message = {"type": "capture", "session_id": "s", "timestamp": 5, "command": "nmap x", "output": "10.0.0.1\n10.0.0.2\n" * 3, "exit_code": 0, "cwd": "/"}
    C.send(str(landing), [message, {"bad": 1}])
    ingest.ingest(C.landing(spark, str(landing)), out, str(tmp_path / "state"), REGISTRY).awaitTermination()
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    assert read("captures").first().tool == "nmap" and read("quarantine").count() == 1
    assert read("entities").filter("type = 'ip_address'").count() == 6 and read("chunks").count() >= 1
    assert read("blobs").first().content == message["output"]
    chunk, capture = read("chunks").first(), read("captures").first()
    assert chunk.id is not None and chunk.blob_hash == capture.output_hash and chunk.capture_id == capture.capture_id
