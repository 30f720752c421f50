"""Identities, policies, stores, command line."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import main
from graphloom.extractors import matching
from graphloom.functions import identity, policy, text
from graphloom.operators import canonical, publish, similar
from graphloom.streaming import policies

REPO = os.path.join(os.path.dirname(__file__), "fixtures", "repo")


def test_identities(spark):
    assert identity.binding_id("g", "a") != identity.binding_id("g", "b") and identity.binding_id("g", "a").startswith("bind1:")
    assert identity.configuration_id("g", [{"a": 1}, {"b": 2}]) == identity.configuration_id("g", [{"b": 2}, {"a": 1}])
    assert identity.selection_policy_id(["b", "a", "a"], []) == identity.selection_policy_id(["a", "b"], [])
    g = {"source": "s", **identity.generations({}, {"python": "1"}, "1")}
    assert identity.is_current(g, dict(g)) and not identity.is_current(g, {**g, "source": "t"}) and not identity.is_current({}, {})
    m = spark.createDataFrame([("a", 1, "h"), ("b", 2, "i")], "path string, size bigint, content_hash string")
    assert identity.snapshot_id(m) == identity.snapshot_id(m.orderBy(F.desc("path"))) != identity.snapshot_id(m.limit(1))
    f = m.select("path", F.col("size").alias("length"))
    assert identity.deterministic_run_id({"x": 1}, f) != identity.deterministic_run_id({"x": 2}, f)


def test_policies(spark):
    rows = [("eml", 1, False, None), ("python", 1, False, "binding_private"), ("python", 1, True, None), ("odf", 1, False, None), ("python", 10**9, False, None), ("python", 1, False, None)]
    df = spark.createDataFrame(rows, "language string, size bigint, private boolean, reason string")
    got = [r[0] for r in df.select(policy.body_admission(F.col("language"), F.col("size"), F.col("private"), F.col("reason"))).collect()]
    assert got == ["email_excluded", "binding_private", "artifact_private", "unsupported_format", "too_large", "admitted"]
    b = spark.createDataFrame([(False, False, True, "code"), (True, True, True, "code"), (False, False, False, "email")], "g boolean, b boolean, r boolean, role string")
    assert [r[0] for r in b.select(policy.binding_exclusion(F.col("g"), F.col("b"), F.col("r"), F.col("role"))).collect()] == [None, "graph_private", "retention_denied"]
    f = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "path string, size bigint").withColumn("k", F.lit(1))
    assert [r["ok"] for r in f.withColumn("ok", policy.within_budget(F.col("size"), ["path"], 10, ["k"])).orderBy("path").collect()] == [True, True, False]


def test_publication_policies():
    assert policies.retry_delay("transient", "staged", 1, rng=random.Random(1)) <= 1 and policies.retry_delay("transient", "published", 1) is None and policies.retry_delay("bad_input", "none", 1) is None
    assert [policies.reconcile(*x) for x in (("staged", True, True), ("none", None, False), ("staged", None, False), ("staged", False, True))] == ["complete", "retry", "inspect", "cancel"]
    assert policies.worth_saving(None, (0, 0)) and not policies.worth_saving((0, 0), (1, 5)) and policies.worth_saving((0, 0), (1, 500)) and policies.worth_saving((0, 0), (9, 1))


def test_claims_and_provenance(spark):
    claims = ['{"parent_witness":{}}', "{}", '{"extractor_receipt_x":1}', '{"language":" Rust "}', '{"language":"python"}']
    o = spark.createDataFrame([(k, "file", p, m) for k, (p, m) in enumerate(zip("abcde", claims, strict=True))], "ordinal bigint, kind string, path string, metadata string")
    good, bad = canonical.refused_claims(o)
    assert [r["path"] for r in good.orderBy("path").collect()] == ["b", "e"]
    assert [r["detail"] for r in bad.orderBy("ordinal").collect()] == ["capability_claim_metadata:a", "receipt_reference_metadata:c", "rust_language_claim:d"]
    assert [r["path"] for r in canonical.unknown_provenance(o, o.where("path <> 'b'")).collect()] == ["b"]


def test_occurrences_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "xaax"), (1, "xaax")], "k int, text string")
    assert [r["pos"] for r in text.occurrences(docs, "aa").collect()] == [2, 2]


def test_published_runs_stay(spark, tmp_path):
    """A run that is complete is neither staged nor published again, and a build extracts once."""
    from graphloom.operators import publish
    from graphloom.session import GraphSession

    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("import os\n\n\ndef f():\n    return os.name\n")
    session = GraphSession.build(spark, str(root), str(tmp_path / "graphs"))
    assert session.canonical_nodes(kind="python.function").count() == 1
    plan = canonical.canonicalize(spark.read.parquet(f"{tmp_path}/graphs/staged/run=1/observations")).nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # observations are read, not extracted
    with pytest.raises(publish.IntegrityError):
        GraphSession.build(spark, str(root), str(tmp_path / "graphs"))


def test_text_helpers():
    assert text.alias_query_text("src/HTTPServer parse_json") == "src httpserver http server parse json"
    assert text.jsonb_text({"bb": 1, "a": [True, None, "é"], "c": {}}) == '{"a": [true, null, "é"], "c": {}, "bb": 1}'


def test_embedding_import(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0]), ("d", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "canonical_key string, embedding array<double>")
    got = similar.import_embeddings(df, 2, df.where("canonical_key <> 'c'"))
    assert sorted((r["canonical_key"], r["status"]) for r in got.collect()) == [("a", "imported"), ("b", "bad_vector"), ("c", "private"), ("d", "duplicate"), ("d", "duplicate")]
    with pytest.raises(ValueError):
        similar.import_embeddings(spark.range(501).select(F.col("id").cast("string").alias("canonical_key"), F.array(F.lit(1.0)).alias("embedding")), 1, df)


def test_go_assembly(spark):
    files = spark.createDataFrame([("p/a.s",), ("q/b.s",), ("c.s",), ("p/x.go",)], "path string")
    o = spark.createDataFrame([("go.package", "p/x.go", "p"), ("go.package", "q/y.go", "q"), ("go.package", "q/z.go", "r")], "kind string, path string, name string")
    assert {r["path"]: (r["status"], r["package"]) for r in matching.go_assembly(files, o).collect()} == {"p/a.s": ("companion", "p"), "q/b.s": ("conflict", None), "c.s": ("no_package", None)}


def test_lexical_store(spark, tmp_path):
    store = publish.LexicalStore(spark, str(tmp_path))
    assert store.build("g1", spark.createDataFrame([("a", "t")], "path string, chunk_text string")) == 1 and store.revoke("g1", "x", dry_run=True) == 1
    assert store.revoke("g1", "policy") == 1 and store.state("g1") == "revoked"
    with pytest.raises(publish.IntegrityError):
        store.chunks("g1")


def test_command_line(spark, tmp_path):
    folder = str(tmp_path / "g")
    assert "bin/setup" in main(["entrypoints", REPO], spark) and '"nodes"' in main(["build", REPO, folder], spark)
    assert "python.function" in main(["nodes", folder, "--kind", "python.function"], spark) and "apt-get" in main(["host-mutators", folder], spark)
    assert "app.core.fetch" in main(["search", folder, "fetch"], spark) and '"center"' in main(["neighborhood", folder, "file:bin/setup"], spark) and "functions" in main(["summary", folder], spark)
    assert main(["build", REPO, folder, "--run", "2"], spark) and publish.purge(spark, folder) == [1]
    publish.purge(spark, folder, dry_run=False)
    assert not os.path.exists(f"{folder}/run=1") and publish.latest_receipt(spark.read.parquet(f"{folder}/runs"), ["digest"]).first()["run_id"] == 2
    t = publish.load(spark, folder, 2)
    assert publish.export_bundle(f"{folder}/bundle", {"nodes": t["nodes"]}, {"nodes": ["canonical_key"]})["nodes"] == t["nodes"].count()


def test_metadata_read_once(spark):
    """Canonicalization reads metadata in one step that filters stay above; refusals, warnings and metadata are those of the plain expressions."""
    import json

    from graphloom.functions.keys import canonical_json

    texts = [None, "", "{}", "[1]", "{", '{"b":1, "a":{"d":1.50,"c":"é"}}', '{"language":" RUST/x"}', '{"language":"rusty"}', '{"\\u0065xtractor_receipt_x":1}', '{"extractor_receipt":1}', '{"effect_vector":1}', '{"x":"effect_vector"}', '{"l\\u0061nguage":"r\\u0075st"}', '{"dialect":"rust"', '{"x":{"effect_vector":1}}']
    kinds = ["python.function", "rust.item", "html.document", "x.y", "", "file", None]
    rows = [(1, i, 1 if i % 5 else 2, k, "s", f"p{i % 4}", "extracted", "e", "1", 1, 1, "n", "t", t) for i, (k, t) in enumerate((k, t) for k in kinds for t in texts)]
    o = spark.createDataFrame(rows, "run_id long, ordinal long, schema_version int, kind string, source_id string, path string, confidence string, extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string")
    g = canonical.canonicalize(o)
    good, bad = canonical.validated(o)
    good, refused = canonical.refused_claims(good)
    unknown = good.where(~F.col("kind").isin(*canonical.RULES)).select(F.lit("warning"), F.lit("unsupported_observation"), "ordinal", "kind", "path")
    plain = lambda df: sorted(map(repr, map(tuple, df.where("code <> 'conflicting_evidence'").collect())))
    assert plain(g.diagnostics) == plain(bad.union(refused).union(unknown)) and {r["code"] for r in g.diagnostics.collect()} >= {"schema_version", "blank_field", "extractor_capability_claim_refused", "unsupported_observation"}

    def form(t):
        try:
            return canonical_json(json.loads(t)) if t else "{}"
        except ValueError:
            return "{}"

    want = {r["ordinal"]: form(r["metadata"]) for r in good.where(F.col("kind").isin(*canonical.RULES)).collect()}
    assert {r["raw_observation_ordinal"]: r["metadata"] for r in g.evidence.collect()} == want
    for df in (g.diagnostics, g.nodes, g.edges):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "json_object_keys" in line and "suspect" not in line]
    assert g.diagnostics._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3  # observations, rules, files for conflicts


def test_explained_edge_small_links(spark, monkeypatch):
    """Few links are broadcast, so evidence and observations are not shuffled; many are joined; rows are the same, also where raw observations are gone."""
    from graphloom.operators import read

    rows = [(1, i, 1, "python.import", "s", "a.py", "extracted", "e", "1", 1, 1, "n", f"t{i % 3}", '{"k":1}') for i in range(30)]
    o = spark.createDataFrame(rows, "run_id long, ordinal long, schema_version int, kind string, source_id string, path string, confidence string, extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string")
    g = canonical.canonicalize(o)
    ask = lambda raw: read.explain_edge(g.edges, g.edge_links, g.evidence, raw, "file:a.py", "imports", "external:t1")
    out = ask(o.where("ordinal <> 4"))
    got = sorted((r["evidence_key"].split(":")[1], r["raw_kind"], r["raw_metadata"]) for r in out.collect())
    assert got == sorted((str(i), "python.import", None if i == 4 else '{"k":1}') for i in range(30) if i % 3 == 1)
    plan = ask(o)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan  # a sort of the few rows is all that is dealt out
    monkeypatch.setattr(read, "MAX_LINKS", 2)
    assert sorted(map(repr, ask(o.where("ordinal <> 4")).collect())) == sorted(map(repr, out.collect()))
    monkeypatch.setattr(read, "MAX_KEYS", 0)
    assert sorted(map(repr, ask(o.where("ordinal <> 4")).collect())) == sorted(map(repr, out.collect()))
    assert ask(o).count() == 10 and read.explain_edge(g.edges, g.edge_links, g.evidence, o, "file:a.py", "imports", "external:none").count() == 0


def test_covering_chunk_shuffles(spark):
    """Overlapping chunks, chunks over several bins, files without chunks and lines without; occurrences are dealt out by file and bin and by file only."""
    from graphloom.operators import lexical

    chunks = [("a", 0, 1, 10, "a0"), ("a", 1, 5, 200, "a1"), ("a", 2, 60, 70, "a2"), ("b", 3, 5, 6, "b3"), ("b", 1, 500, 900, "b1")]
    occurrences = [(f, n, f"{f}{n}") for f in "abc" for n in (1, 5, 10, 63, 64, 65, 130, 200, 201, 700, 901)]
    c = spark.createDataFrame(chunks, "path string, chunk_ordinal int, start_line int, end_line int, chunk_id string")
    o = spark.createDataFrame(occurrences, "path string, start_line int, oid string")
    out = lexical.covering_chunk(o, c, ["path"], ["oid"])
    want = []
    for f, n, oid in occurrences:
        own = sorted((k, i) for p, k, _, _, i in chunks if p == f)
        held = sorted((k, i) for p, k, a, z, i in chunks if p == f and a <= n <= z)
        want.append((f, n, oid, (held or own or [(0, None)])[0][1], bool(held)))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert "oid" not in " ".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(oid" in x or "keys=[oid" in x or "[oid#" in x and "Join" in x)
