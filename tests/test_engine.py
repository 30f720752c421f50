"""The graph engine end to end over a small repository, and its functions."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from graphloom.extractors import extract, matching
from graphloom.extractors.code import relative_base, segments, shell_words
from graphloom.extractors.common import redact, sanitize
from graphloom.extractors.documents import anchor, config, pointer, without_comments
from graphloom.extractors.registry import extract_file
from graphloom.functions import classify, rank, text
from graphloom.operators import canonical, context, lexical, merge, publish, read, similar, summary
from graphloom.session import GraphSession
from graphloom.sources import bulk_files, discover, memory_entries, read_observations, read_warc, source_generation, write_observations
from graphloom.sources.services import api_observations, feed_items, github_observations, memory_summary

REPO = os.path.join(os.path.dirname(__file__), "fixtures", "repo")


@pytest.fixture(scope="module")
def observations(spark):
    return extract(discover(spark, REPO, excludes=("*.pyc",))).cache()


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    return GraphSession.build(spark, REPO, str(tmp_path_factory.mktemp("graph")))


def kinds(observations, path):
    return [(r["kind"], r["name"], r["target"]) for r in observations.where(F.col("path") == path).orderBy("ordinal").collect()]


def test_discovery(spark):
    files = {r["path"]: r for r in discover(spark, REPO, profile={"roles": {"docs/table.csv": "config"}}).drop("content").collect()}
    assert (files["src/app/core.py"]["language"], files["src/app/core.py"]["role"]) == ("python", "source")
    assert (files["bin/setup"]["language"], files["bin/setup"]["role"], files["bin/setup"]["executable"]) == ("shell", "entrypoint", True)
    assert files["go/go.mod"]["language"] == "go-module" and files["infra/main.tf"]["role"] == "config" and files["docs/adr/0001.md"]["role"] == "documentation"
    assert (files["docs/table.csv"]["role"], files["docs/table.csv"]["confidence"]) == ("config", "manual")
    assert source_generation(discover(spark, REPO)) == source_generation(discover(spark, REPO).repartition(3))


def test_ordinals(observations):
    rows = observations.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    assert all(a["path"].rsplit("/", 1)[0:-1] <= b["path"].rsplit("/", 1)[0:-1] for a, b in zip(rows, rows[1:], strict=False))


def test_python(observations):
    got = kinds(observations, "src/app/core.py")
    assert ("python.import", "h", "app.util.helper") in got and ("python.import", "util", "app.util") in got and ("python.import", "os", "os") in got
    assert ("python.method", "app.core.Widget.turn", None) in got and ("python.function", "app.core.fetch", None) in got and ("python.fastapi_route", "GET /items", None) in got
    assert ("secret.marker", "API_TOKEN", None) in got
    assert [k for k, *_ in kinds(observations, "src/app/bad.py")] == ["file", "python.parse_error"]
    assert relative_base("a.b.c", "d", 2, False) == "a.d" and relative_base("a.b", None, 1, True) == "a.b"


def test_documents(observations):
    md = kinds(observations, "docs/adr/0001.md")
    assert [n for k, n, _ in md if k == "markdown.heading"] == ["first-choice", "part", "part-1"] and ("markdown.link", "core", "../../src/app/core.py") in md and ("markdown.adr_metadata", "One", None) in md
    assert ("html.asset", "link", "site.css") in kinds(observations, "web/index.html")
    assert ("css.import", None, "base.css") in kinds(observations, "web/site.css")
    api = kinds(observations, "infra/api.jsonc")
    assert ("openapi.operation", "GET /x", None) in api and ("openapi.schema", "schemas/X", None) in api and ("config.path", "/l/1", None) in api
    assert ("feed.category", "1", "c") in kinds(observations, "feeds/a.xml") and ("email.address", "<1@example.org>", "ann@example.org") in kinds(observations, "mail/a.eml")
    assert ("config.path", "/a/0/c", None) in kinds(observations, "infra/conf.yaml") and ("config.path", "/d/1", None) in kinds(observations, "infra/conf.yaml")
    assert ("python.requirement", "flask", None) in kinds(observations, "requirements.txt")
    secret = observations.where("name = '/password'").first()
    assert json.loads(secret["metadata"])["redaction_reason"] == "secret_name"


def test_shell(observations):
    got = kinds(observations, "bin/setup")
    assert ("shell.host_mutation", "apt-get", "host:package") in got and ("shell.source", "source", "./lib.sh") in got and ("shell.redirect", ">", "/dev/null") in got
    assert ("shell.network", "curl", "[redacted]") in got
    assert shell_words("a 'b c' | d >> e # f") == ["a", "'b c'", "|", "d", ">>", "e"] and segments(["a", "&&", "b", ";"]) == [["a"], ["b"]]
    mutators = summary.host_mutators(observations).collect()
    assert [(r["category"], r["tool"], r["privileged"]) for r in mutators] == [("package", "apt-get", True)]


def test_matches(spark, observations):
    got = {(r["selector"], r["pointer"], r["match"]) for r in matching.css_matches(observations).collect()}
    assert {s for s, *_ in got} == {".a.b", "#top", "p.a"} and all(m == "exact" for *_, m in got)
    go = matching.go_imports(observations).collect()
    assert [(r["target"], r["status"], r["package_dir"]) for r in go] == [("example.org/m/pkg", "resolved", "go/pkg")]
    refs = spark.createDataFrame([("nix.input_ref", "f.nix", 1, t, "{}") for t in ("one", "two", "none", "${x}")], "kind string, path string, start_line int, target string, metadata string")
    bindings = spark.createDataFrame([("one", "b1"), ("two", "b2"), ("two", "b3")], "alias string, binding_id string")
    assert {r["target"]: r["status"] for r in matching.nix_relations(refs, bindings).collect()} == {"one": "exact", "two": "ambiguous", "none": "unsupported", "${x}": "evaluation_dependent"}


def test_graph(session):
    nodes = {r["canonical_key"]: r for r in session.canonical_nodes().collect()}
    assert nodes["python.function:src/app/core.py:app.core.fetch"]["kind"] == "python.function" and "file:bin/setup" in nodes and "doc.section:docs/adr/0001.md:part-1" in nodes
    hood = session.neighborhood("file:src/app/core.py")
    assert any(e["edge_kind"] == "imports" for e in hood["edges"]["records"]) and all(n["canonical_key"] != "file:src/app/core.py" for n in hood["nodes"]["records"])
    ev = session.explain_canonical_edge("file:src/app/core.py", "imports", "external:app.util").collect()
    assert ev[0]["raw_kind"] == "python.import" and ev[0]["start_line"] == 3
    assert session.status().first()["nodes"] == len(nodes)
    assert session.python_summary().first()["functions"] == 3 and session.refresh_status().first()["accepted_run_id"] == 1
    assert session.openapi_summary().first()["operation"] == 1 and session.terraform_summary().first()["resource"] == 1
    for name in ("nix_summary", "js_framework_summary", "email_summary", "ruby_summary", "js_summary"):
        assert getattr(session, name)().count() == 1
    assert session.source_feed_items().first()["categories"] == ["c"] and session.search_files("setup").count() == 1 and session.entrypoints().count() == 1
    before = session.project_summary().withColumn("value", F.when(F.col("key") == "imports", 0).otherwise(F.col("value")))
    assert [r["key"] for r in session.drift(before).collect()] == ["imports"]


def test_ranking_and_context(session):
    top = session.navigation_search("fetch", "definition").first()
    assert top["canonical_key"].endswith("app.core.fetch") and top["rank"] == 1 and top["evidence_tier"] == 0
    packet = session.context_packet("app", budget=4096)
    assert packet["actual_bytes"] == len(json.dumps(packet, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()) <= 4096 and packet["items"]


def test_failed_run_is_not_accepted(spark, observations, tmp_path):
    g = canonical.canonicalize(observations)
    publish.publish(str(tmp_path), 1, g, observations)
    bad = canonical.Graph(g.nodes.where("kind <> 'external'"), g.edges, g.evidence, g.node_links, g.edge_links, g.diagnostics)
    with pytest.raises(publish.IntegrityError):
        publish.publish(str(tmp_path), 2, bad, observations)
    assert publish.accepted(spark, str(tmp_path)) == 1


def obs_rows(*rows):
    return [(1, k, 1, *r) for k, r in enumerate(rows)]


OBS_SHORT = "run_id bigint, ordinal bigint, schema_version int, kind string, source_id string, path string, confidence string, extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string"


def test_canonicalization_rules(spark):
    rows = obs_rows(
        ("file", "f", "a.py", "extracted", "x", "1", None, None, None, None, '{"content_hash":"1"}'), ("file", "f", "a.py", "extracted", "x", "1", None, None, None, None, '{"content_hash":"2"}'),
        ("python.import", "f", "a.py", "heuristic", "x", "1", 1, 1, "b", "b", '{"n":1}'), ("python.import", "f", "a.py", "extracted", "x", "1", 2, 2, "b", "b", '{"n":2}'), ("nobody.knows", "f", "a.py", "extracted", "x", "1", None, None, None, None, "{}"),
        ("file", "f", "b.py", "maybe", "x", "1", None, None, None, None, "{}"), ("file", "f", " ", "extracted", "x", "1", None, None, None, None, "{}"), ("file", "f", "c.py", "extracted", "x", "1", 3, 2, None, None, "{}"), ("python.parse_error", "f", "d.py", "extracted", "x", "1", 1, 1, None, None, '{"value":"s"}'),
    )
    g = canonical.canonicalize(spark.createDataFrame(rows, OBS_SHORT))
    edge = g.edges.collect()
    assert len(edge) == 1 and json.loads(edge[0]["metadata"]) == {"n": [1, 2]} and edge[0]["confidence"] == "extracted" and g.edge_links.count() == 2
    assert g.nodes.where("canonical_key = 'file:a.py'").first()["conflict"] and not g.ok()
    assert sorted(r["code"] for r in g.diagnostics.collect()) == ["blank_field", "confidence", "conflicting_evidence", "line_range", "unsupported_observation"]
    assert g.evidence.where("raw_kind = 'python.parse_error'").first()["metadata"] == "{}"


def test_fold():
    assert merge.fold_values([{"a": 1, "l": [1], "privileged_observed": False}, {"a": 2, "l": [1, 2], "privileged_observed": True}, {"a": 1}])[0] == {"a": [[1, 2], 1], "l": [1, 2], "privileged_observed": True}


def test_digests_ignore_order(spark, session):
    n = session.t["nodes"]
    a, b = (merge.structural_digest({"nodes": (df, ["canonical_key"], ["metadata"])}) for df in (n, n.repartition(7).orderBy(F.desc("canonical_key"))))
    assert a == b != merge.structural_digest({"nodes": (n.limit(3), ["canonical_key"], ["metadata"])})


def test_chunks(spark):
    t = "".join(f"line {i}\n" for i in range(184))
    got = text.chunk_text(t)
    assert [(a, b) for a, b, *_ in got] == [(1, 80), (81, 160), (161, 184)] and "".join(x[2] for x in got) == t
    assert text.chunk_text("") == [(0, 0, "", False)]
    long = text.chunk_text("é" * 1300, bytes_cap=512)
    assert len(long) >= 5 and [x[3] for x in long] == [False] + [True] * (len(long) - 1) and "".join(x[2] for x in long) == "é" * 1300
    df = spark.createDataFrame([("a", t), ("b", ""), ("c", None)], "path string, text string")
    assert text.chunks(df, ["path"]).groupBy("path").count().collect().__len__() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\rc",), ("x\x00",), ("é" * 10,), ("",), ("a\n",)], "t string")
    assert [r[0] for r in df.select(text.normalized(F.col("t"), 7)).collect()] == ["a\nb\nc", None, "ééé", "", "a\n"]
    assert [r[0] for r in df.select(text.line_count(F.col("t"))).collect()][3:] == [0, 1]
    hits = text.occurrences(spark.createDataFrame([(1, "aaaab\naa")], "k int, text string"), "aa").orderBy("pos").collect()
    assert [(r["pos"], r["start_line"]) for r in hits] == [(1, 1), (2, 1), (3, 1), (7, 2)]
    tokens = spark.range(1).select(text.alias_tokens(F.lit("src/HTTPServer2.py"), F.lit("parse_jsonV2"))).first()[0]
    assert tokens == ["src", "httpserver2", "http", "server2", "server", "py", "srchttpserver2py", "parse", "jsonv2", "json", "v2", "parsejsonv2"] or tokens[0] == "src"
    assert anchor("Hello *World* (x)!") == "hello-world-x" and anchor("!!") == "section"


def test_lexical(spark):
    df = spark.createDataFrame([("a", 0, "the quick brown fox"), ("b", 0, "quick and slow, brown bears"), ("c", 0, "nothing")], "path string, n int, chunk_text string")
    status, rows = lexical.ranked(df, "quick brown", ["path", "n"])
    got = rows.collect()
    assert status == "ok" and [r["path"] for r in got] == ["a", "b"] and got[0]["score"] > got[1]["score"] > 0
    assert lexical.ranked(df, "quick", ["path", "n"], max_chunks=1)[0] == "candidate_overflow"
    assert [r["path"] for r in lexical.phrase(df, "Quick brown", ["path"]).collect()] == ["a"]
    q = lexical.parse_web_query('quick -fox or "nothing"')
    assert [r["path"] for r in df.where(lexical.satisfies(F.col("chunk_text"), q)).orderBy("path").collect()] == ["b", "c"]
    assert lexical.literal(df.withColumnRenamed("chunk_text", "text"), "quick", ["path"], max_docs=1)[0] == "overflow"
    status, hits = lexical.literal(df.withColumnRenamed("chunk_text", "text"), "o", ["path"], per_file=1)
    assert hits.where("path = 'b'").collect()[0]["capped"]


def test_similarity(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("d", [0.8, 0.6]), ("e", [1.0, 0.0])], "canonical_key string, embedding array<double>")
    status, rows = similar.similar_nodes(df, "c", 3)
    assert status == "ok" and [r["canonical_key"] for r in rows.collect()] == ["b", "d", "a"]
    assert similar.similar_nodes(df, "zz", 3)[0] == "seed_missing" and similar.similar_nodes(df.union(df), "a", 3)[0] == "seed_ambiguous"


def test_ranking_functions(spark):
    df = spark.createDataFrame([("k:Foo", "Foo"), ("k:foo", "foo"), ("m:a.foo", "x"), ("k:1", "FooBar"), ("k:2", "a foo"), ("myfoo", None), ("k", "z")], "k string, d string")
    assert [r[0] for r in df.select(rank.match_class("Foo", F.col("k"), F.col("d"))).collect()] == [0, 1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        rank.affinity_tier("nonsense", F.col("k"), F.col("d"))


def test_paging(spark):
    df = spark.range(5).orderBy("id")
    assert read.read_page(df, 2, 2) == {"records": [{"id": 2}, {"id": 3}], "has_more": True, "limit": 2, "offset": 2, "total": 4}
    with pytest.raises(ValueError):
        read.page(df, None, 1)
    with pytest.raises(ValueError):
        read.neighborhood(df, df, "x", depth=2)


def test_flags(spark):
    df = spark.createDataFrame([("true",), ("Y",), ("1",), ("off",), (None,)], "v string")
    assert [r[0] for r in df.select(summary.flag(F.col("v"))).collect()] == [True, True, True, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "v string").select(summary.flag(F.col("v"))).collect()


def test_sources(spark, observations, tmp_path):
    write_observations(observations, f"{tmp_path}/o")
    back, bad = read_observations(spark, f"{tmp_path}/o")
    assert back.count() == observations.count() and bad.count() == 0
    (tmp_path / "m.jsonl").write_text('{"type":"entity","name":"A","entityType":"t","observations":["see https://x.y token=abc123"]}\n\n{"type":"relation","from":"A","to":"B","relationType":"knows"}\nnot json\n')
    s = memory_summary(memory_entries(spark, f"{tmp_path}/m.jsonl")).first()
    assert (s["entries"], s["entitys"], s["relations"], s["malformed"], s["redacted"], s["urls"]) == (3, 1, 1, 1, 1, 1)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>x</p>"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://u:p@h/x?a=1\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
    w = read_warc(spark, f"{tmp_path}/a.warc").first()
    assert (w["uri"], w["route"], w["http_status"], bytes(w["payload"])) == ("http://h/x?a=", "html", 200, b"<p>x</p>")
    files = spark.createDataFrame([("a.md", 5), (".h/b.md", 5), ("c.exe", 1), ("d.zip", 1), ("e.py", 99), ("f.py", 5)], "path string, length bigint")
    got = {r["path"]: r["reason"] for r in bulk_files(files, max_files=1, max_file_bytes=50).collect()}
    assert got == {"a.md": None, ".h/b.md": "hidden", "c.exe": "unsupported_extension", "d.zip": "packed_archive", "e.py": "max_file_bytes", "f.py": "max_files"}
    api = spark.createDataFrame([("/ok", '[{"id":1,"token":"s"}]'), ("/no", "{}")], "path string, text string")
    assert [r["kind"] for r in api_observations(api, ("/ok",)).collect()] == ["api.response", "api.record", "api.refused_endpoint"]
    gh = spark.createDataFrame([("issue/1", '{"number": 7, "state": "open", "labels": [{"name": "x"}]}')], "path string, text string")
    assert github_observations(gh).first()["name"] == "7"
    assert feed_items(observations).first()["links"] == ["https://example.org/1"]


def test_redaction():
    assert redact({"a": {"password": "x", "u": "https://a:b@c/"}}) == {"a": {"password": "[redacted]", "u": "https://[redacted]@c/"}}
    assert sanitize({"p": "/home/me/x", "l": "a" * 9}, ("/home/me",), cap=5) == {"p": "[priv[truncated]", "l": "aaaaa[truncated]"}
    assert pointer(["a/b", "c~d", 0]) == "/a~1b/c~0d/0" and json.loads(without_comments('{"a": "//x", /* c */ "b": [1,], // d\n}')) == {"a": "//x", "b": [1]}
    assert [o["kind"] for o in config("json")("x.json", "{}")] == ["config.document"]


def test_prefixes(spark):
    with pytest.raises(ValueError):
        classify.checked_prefix("../x")
    assert classify.checked_prefix("./a//b/") == "a/b"
    names = spark.createDataFrame([("x_linux_amd64.go",), ("y_windows_test.go",), ("z.go",)], "p string")
    assert [r[0] for r in names.select(classify.go_constraints(F.col("p"))).collect()] == [["linux", "amd64"], ["windows"], []]


def test_packet_limits():
    p = context.pack([{"k": "x" * 3000}, {"k": "y" * 3000}, {"k": "z"}], 4096)
    assert [i["k"][0] for i in p["items"]] == ["x", "z"] and p["omissions"]["over_budget"] == 1 and p["truncated"]
    with pytest.raises(ValueError):
        context.pack([], 10)
    assert context.vector_status([{"binding": "b", "revision": 1, "snapshot": "s"}], "b", 1, "s") == "verified_vector"


def test_without_fixture_leftovers():
    assert not os.path.exists(os.path.join(REPO, "spark-warehouse")) and shutil.which("java")


def test_config_is_read_whole():
    """No depth, number of values or length of a target is cut; secrets are withheld."""
    lines = "\n".join(json.dumps({"id": k, "$ref": f"./r{k}"}) for k in range(6000))
    got = [o for o in config("jsonl")("x.jsonl", lines) if o["kind"] != "config.document"]
    assert [o["name"] for o in got if o["kind"] == "config.path"] == [x for k in range(6000) for x in (f"/{k}", f"/{k}/id", f"/{k}/$ref")]
    assert [o["target"] for o in got if o["kind"] == "config.reference"] == [f"./r{k}" for k in range(6000)]
    deep = '{"a":' * 300 + '"./end"' + "}" * 300
    assert config("json")("d.json", deep)[-1]["name"] == "/a" * 300 and config("json")("d.json", deep)[-1]["target"] == "./end"
    url = "https://example.org/" + "p" * 500
    targets = [o["target"] for o in config("json")("u.json", json.dumps({"u": url, "token": url, "$ref": "https://a:b@c/"})) if o["kind"] == "config.reference"]
    assert targets == [url, "[redacted]"]
    shell = extract_file("x.sh", "bash", f"curl {url}\n".encode())
    assert [o["target"] for o in shell if o["kind"] == "shell.network"] == [url]
