"""More registered queries: each runs an operator of the engine over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extractors import matching
from ..functions import classify, keys, policy, rank, text
from ..operators import canonical, lexical, merge, publish, read as ops, summary
from ..sources import repository, services
from . import tables
from .queries import EDGES, EVIDENCE, NODES, OBS, PATHS, query
from .tables import read

# Ranking tables over all combinations of a few values.

_KINDS = (
    "python.function", "go.function", "js.import", "js.component", "ruby.method", "ruby.gem_dependency", "bash.function", "nix.package", "nix.flake", "nix.check", "config.path", "css.selector", "html.element", "xml.element",
    "rust.item", "terraform.resource", "openapi.path", "doc.section", "email.message", "bats.test_case", "zunit.hook", "file",
)
_FAMILIES = ("python_test_subject", "code_definition", "other")
_SQL_LIST = lambda xs: ", ".join(f"('{x}')" for x in xs)
_CODE = "(kind IN ('python.function', 'js.component', 'ruby.method', 'nix.package') OR regexp_matches(kind, '^(go|bash|zsh|awk|powershell|config|css|html|xml)[.]'))"


def _values(spark, name, xs):
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))


@query(f"""WITH k(kind) AS (VALUES {_SQL_LIST(_KINDS)}), f(family) AS (VALUES {_SQL_LIST(_FAMILIES)}), i(intent) AS (VALUES {_SQL_LIST(rank.INTENTS)})
SELECT kind, family, intent, CASE WHEN intent IN ('definition', 'implementation') AND family <> 'python_test_subject' AND {_CODE} THEN 0 WHEN intent = 'tests' AND (family = 'python_test_subject' OR kind IN ('nix.check', 'bats.test_case', 'zunit.hook')) THEN 0
 WHEN intent = 'docs' AND kind = 'doc.section' THEN 0 WHEN intent = 'messages' AND kind = 'email.message' THEN 0 ELSE 1 END AS tier FROM k, f, i""")
def affinity_tiers(spark, d):
    """All intents over a small table of kinds and families."""
    rows = _values(spark, "kind", _KINDS).crossJoin(_values(spark, "family", _FAMILIES))
    out = None
    for intent in rank.INTENTS:
        one = rows.select("kind", "family", F.lit(intent).alias("intent"), rank.affinity_tier(intent, F.col("kind"), F.col("family")).alias("tier"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH k(kind) AS (VALUES {_SQL_LIST((*_KINDS, "python.class"))}), n(name) AS (VALUES ('test_x'), ('TestX'), ('x')), p(path) AS (VALUES ('src/a.py'), ('tests/a.py'), ('src/test_a.py'))
SELECT kind, name, path, CASE WHEN kind IN ('python.function', 'python.class') THEN CASE WHEN path <> 'src/a.py' OR (kind = 'python.function' AND name = 'test_x') OR (kind = 'python.class' AND name = 'TestX') THEN 'python_test_subject' ELSE 'code_definition' END
 WHEN kind = 'doc.section' THEN 'doc_artifact' WHEN kind = 'email.message' THEN 'message_artifact' WHEN kind IN ('nix.check', 'bats.test_case', 'zunit.hook') THEN 'test_subject' WHEN {_CODE} THEN 'code_definition' ELSE 'other' END AS family FROM k, n, p""")
def subject_families(spark, d):
    rows = _values(spark, "kind", (*_KINDS, "python.class")).crossJoin(_values(spark, "name", ("test_x", "TestX", "x"))).crossJoin(_values(spark, "path", ("src/a.py", "tests/a.py", "src/test_a.py")))
    return rows.withColumn("family", rank.subject_family(F.col("kind"), F.concat(F.col("kind"), F.lit(":k")), F.col("name"), F.col("path")))


# Graphs, guards and merges.


@query(f"""WITH o AS ({OBS}) SELECT max(run_id) AS latest_run_id, count(*) AS raw_observations, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM ({NODES})) AS nodes, (SELECT count(*) FROM ({EDGES})) AS edges, (SELECT count(*) FROM lineitem) AS evidence,
(SELECT count(*) FROM lineitem) AS node_evidence, (SELECT count(*) FROM lineitem) AS edge_evidence, (SELECT count(DISTINCT run_id) FROM o) AS runs FROM o""")
def storage_summary(spark, d):
    o, ev = tables.observations(spark, d), tables.evidence_table(spark, d)
    return summary.storage_summary(o, tables.document_files(spark, d), tables.node_table(spark, d), tables.edge_table(spark, d), ev, ev, ev, o.select("run_id").distinct())


@query(f"""WITH o AS ({OBS}) SELECT ordinal, kind AS raw_kind, path, CAST(start_line AS INTEGER) AS start_line, 'supports' AS link_kind FROM o WHERE path = 'u7/f7.py' AND kind = 'python.import' AND target = 'lib3'""")
def explained_edge(spark, d):
    o = tables.observations(spark, d)
    g = canonical.canonicalize(o)
    out = ops.explain_edge(g.edges, g.edge_links, g.evidence, o, "file:u7/f7.py", "imports", "external:lib3")
    return out.select(F.split_part("evidence_key", F.lit(":"), F.lit(2)).cast("long").alias("ordinal"), "raw_kind", "path", "start_line", "link_kind")


@query("""SELECT o_custkey AS edge_key, '{' || string_agg(DISTINCT '"' || o_orderstatus || '":true', ',' ORDER BY '"' || o_orderstatus || '":true') || '}' AS metadata, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 ELSE 1 END) = 3 AS manual FROM orders GROUP BY o_custkey""")
def folded_edges(spark, d):
    """Metadata of parallel edges folded, the strongest confidence kept."""
    o = read(spark, d, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("edge_key"), F.lit("s").alias("source_canonical_key"), F.lit("references").alias("edge_kind"), F.lit("t").alias("target_canonical_key"), F.lit("{}").alias("identity_metadata"),
        F.concat(F.lit('{"'), "o_orderstatus", F.lit('":true}')).alias("metadata"), F.when(F.col("o_orderpriority") == "1-URGENT", "manual").otherwise("heuristic").alias("confidence"), F.col("o_orderkey").alias("ordinal"),
    )
    return merge.upsert_edges(rows).select(F.col("edge_key").cast("long").alias("edge_key"), "metadata", (F.col("confidence") == "manual").alias("manual"))


@query("SELECT 'file:orders/' || l_orderkey AS canonical_key FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag)")
def conflicting_files(spark, d):
    o = read(spark, d, "lineitem").select(F.lit("file").alias("kind"), F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("path"), F.to_json(F.struct(F.col("l_returnflag").alias("language"))).alias("metadata"))
    return canonical.file_conflicts(o)


@query("SELECT l_orderkey AS path, count(DISTINCT l_linestatus) AS n_language, count(DISTINCT l_returnflag) AS n_role, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_orderkey")
def file_fact_conflicts(spark, d):
    li = read(spark, d, "lineitem")
    ordinal = (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal")
    facts = [li.select(F.col("l_orderkey").alias("path"), F.lit(n).alias("name"), F.col(c).alias("value"), ordinal) for n, c in (("language", "l_linestatus"), ("role", "l_returnflag"))]
    out = merge.file_nodes(facts[0].union(facts[1]))
    return out.select("path", F.size(F.col("facts")["language"]).cast("long").alias("n_language"), F.size(F.col("facts")["role"]).cast("long").alias("n_role"), "conflict")


@query(f"""WITH e AS ({EDGES}), n AS (SELECT * FROM ({NODES}) WHERE kind <> 'supplier') SELECT 'edge_source' AS guard, s AS key FROM e WHERE s NOT IN (SELECT canonical_key FROM n)
UNION ALL SELECT 'node_link_node', 'supplier:' || l_suppkey FROM lineitem""")
def broken_references(spark, d):
    """Guards over a graph without its suppliers."""
    n, e = tables.node_table(spark, d).where("kind <> 'supplier'"), tables.with_edge_keys(tables.edge_table(spark, d))
    ev = tables.evidence_table(spark, d).select("evidence_key")
    links = read(spark, d, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("canonical_key"), F.concat_ws(":", F.lit("evidence"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_key"))
    edge_links = e.select("edge_key").crossJoin(ev.limit(1))  # a row for each edge
    return merge.integrity_violations(n, e, ev, links, edge_links)


@query(f"""WITH o AS ({OBS}), b AS (SELECT ordinal, CASE WHEN ordinal % 11 = 0 THEN '' ELSE kind END AS kind, CASE WHEN ordinal % 7 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN ordinal % 5 = 0 THEN 'maybe' ELSE 'extracted' END AS c, start_line AS a, CASE WHEN ordinal % 3 = 0 THEN start_line - 1 ELSE start_line END AS z FROM o)
SELECT ordinal, CASE WHEN kind = '' THEN 'blank_field' WHEN v <> 1 THEN 'schema_version' WHEN c = 'maybe' THEN 'confidence' ELSE 'line_range' END AS code FROM b WHERE kind = '' OR v <> 1 OR c = 'maybe' OR a < 1 OR z < a""")
def invalid_observations(spark, d):
    n = F.col("ordinal")
    o = tables.observations(spark, d).withColumn("kind", F.when(n % 11 == 0, "").otherwise(F.col("kind"))).withColumn("schema_version", F.when(n % 7 == 0, 2).otherwise(1))
    o = o.withColumn("confidence", F.when(n % 5 == 0, "maybe").otherwise("extracted")).withColumn("end_line", F.when(n % 3 == 0, F.col("start_line") - 1).otherwise(F.col("start_line")))
    return canonical.validated(o)[1].select("ordinal", "code")


_CLAIMS = ("{}", '{"parent_witness":1}', '{"extractor_receipt_ref_v1":"x"}', '{"language":"Rust/2021"}', '{"dialect":"rusty"}', '{"language":"rust"}')


@query(f"""WITH o AS (SELECT event_id AS ordinal, event_id % 6 AS m, CASE WHEN event_id % 13 = 0 THEN 'rust.item' WHEN event_id % 17 = 0 THEN 'html.document' ELSE 'file' END AS kind FROM events)
SELECT ordinal, CASE WHEN m = 2 THEN 'receipt_reference_metadata' WHEN m = 1 THEN 'capability_claim_metadata' WHEN kind = 'rust.item' THEN 'rust_raw_kind' ELSE 'rust_language_claim' END AS reason FROM o WHERE m IN (1, 2) OR kind = 'rust.item' OR (m IN (3, 5) AND kind <> 'html.document')""")
def refused_claims(spark, d):
    kind = F.when(F.col("ordinal") % 13 == 0, "rust.item").when(F.col("ordinal") % 17 == 0, "html.document").otherwise("file")
    o = tables.observations(spark, d).withColumn("metadata", F.get(F.array(*[F.lit(x) for x in _CLAIMS]), (F.col("ordinal") % 6).cast("int"))).withColumn("kind", kind)
    return canonical.refused_claims(o)[1].select("ordinal", F.split_part("detail", F.lit(":"), F.lit(1)).alias("reason"))


@query(f"""WITH o AS ({OBS}), k AS (SELECT *, source_id || ':' || kind || ':' || path || ':' || name || ':' || start_line AS stable_key FROM o) SELECT stable_key, target, arg_max(kind, ordinal) AS edge_kind, max(ordinal) AS ordinal FROM k GROUP BY stable_key, target""")
def normalized_edges(spark, d):
    return canonical.normalized_graph(tables.observations(spark, d))[1]


@query(f"WITH o AS ({OBS}) SELECT ordinal, 'core/' || path AS path, 'core/' || source_id AS source_id FROM o WHERE path NOT IN (SELECT path FROM o WHERE run_id = 1)")
def uncaptured_observations(spark, d):
    """Observations of one source among several whose files no manifest holds."""
    o = canonical.namespaced(tables.observations(spark, d), "core")
    return canonical.unknown_provenance(o, o.where("run_id = 1")).select("ordinal", "path", "source_id")


@query(f"""WITH o AS ({OBS}) SELECT ordinal, '{{"category":"' || category || '","k":' || regexp_extract(metadata, '"k":([0-9]+)', 1) || '}}' AS metadata FROM o""")
def withheld_metadata(spark, d):
    """Metadata without some names."""
    return tables.observations(spark, d).select("ordinal", canonical.without_keys(F.col("metadata"), ("tool", "privileged")).alias("metadata"))


@query("""SELECT user_id AS graph_id, arg_max(event_id, event_id) AS run_id FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY user_id HAVING user_id = 7""")
def latest_receipt(spark, d):
    """The newest complete run with all its receipts."""
    runs = read(spark, d, "events").where("user_id = 7").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "complete").otherwise("running").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("receipt"))
    return publish.latest_receipt(runs, ["receipt"]).select("graph_id", "run_id")


@query("""SELECT 'manifests' AS metric, '' AS key, count(*) AS value FROM orders UNION ALL SELECT 'o_custkey', '', CAST(sum(o_custkey) AS BIGINT) FROM orders UNION ALL SELECT 'by', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'by', 'all', count(*) FROM orders""")
def manifest_summary(spark, d):
    o = read(spark, d, "orders").withColumn("by", F.create_map(F.col("o_orderstatus"), F.lit(1), F.lit("all"), F.lit(1)))
    return summary.manifest_summary(o, ["o_custkey"], ["by"])


@query("SELECT p_partkey, 'evidence:' || p_partkey || ':' || p_name || ':' || p_size || '-:x:' || p_brand AS evidence_key, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN 3 ELSE 4 END AS strength FROM part")
def evidence_keys(spark, d):
    confidence = F.get(F.array(*[F.lit(x) for x in ("unknown", "heuristic", "extracted", "manual")]), F.col("p_size") % 4)
    key = keys.evidence_key(F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.lit(None), F.lit("x"), F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", key.alias("evidence_key"), keys.confidence_rank(confidence).cast("int").alias("strength"))


# Summaries by family, over parts as observations of every kind.

_FAMILY = {
    "python": ("module", "class", "function", "method", "import", "package_file", "requirement", "flask_route", "fastapi_route", "django_urlpattern", "django_model", "django_view", "test_function", "test_class", "redaction", "parse_error"),
    "openapi": ("document", "path", "operation", "component", "schema", "security_scheme", "parameter", "response", "parse_error"),
    "terraform": ("file", "block", "resource", "data", "module", "variable", "output", "provider", "local", "reference", "parse_error"),
    "nix": ("flake", "flake_input", "input_ref", "module_export", "module", "app", "check", "package", "dev_shell", "parse_error"),
    "email": ("message", "mailbox", "part", "attachment_stub", "thread_hint", "address", "parse_error"),
    "ruby": ("file", "module", "class", "method", "singleton_method", "constant", "route", "test_case", "test_method", "reference", "gem_dependency", "rake_task", "dynamic", "parse_error"),
    "js": ("file", "module", "function", "class", "method", "variable", "component", "route", "test_suite", "test_case", "reference", "import", "export", "hook", "test_expectation", "dynamic", "parse_error"),
    "bash": ("function", "command"),
}
_ALL = tuple(f"{f}.{k}" for f, ks in _FAMILY.items() for k in ks)
_PROFILES = ("node", "express", "nest", "next", "jest", "jquery", "other")
_FILES = ("pyproject", "requirements", "requirements-dev", "Requirements")
_FAMILY_SQL = f"""SELECT p_partkey AS ordinal, [{', '.join(f"'{k}'" for k in _ALL)}][CAST(p_partkey % {len(_ALL)} + 1 AS INTEGER)] AS kind, [{', '.join(f"'{x}'" for x in _FILES)}][CAST(p_size % 4 + 1 AS INTEGER)] AS file_family,
  CASE WHEN p_size % 3 = 0 THEN '==1' END AS version_constraint, CASE WHEN p_size % 2 = 0 THEN 'python-requirements' ELSE 'pyproject' END AS source_format, [{', '.join(f"'{x}'" for x in _PROFILES)}][CAST(p_size % 7 + 1 AS INTEGER)] AS profile, p_brand AS target FROM part"""


def family_observations(spark, d) -> DataFrame:
    p = read(spark, d, "part")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), n.cast("int"))
    metadata = F.to_json(F.struct(
        pick(_FILES, F.col("p_size") % 4).alias("file_family"), F.when(F.col("p_size") % 3 == 0, "==1").alias("version_constraint"), F.when(F.col("p_size") % 2 == 0, "python-requirements").otherwise("pyproject").alias("source_format"),
        pick(_PROFILES, F.col("p_size") % 7).alias("framework_profile"),
    ))
    return p.select(F.lit(1).cast("bigint").alias("run_id"), F.col("p_partkey").alias("ordinal"), pick(_ALL, F.col("p_partkey") % len(_ALL)).alias("kind"), F.col("p_brand").alias("target"), F.col("p_brand").alias("source_id"), F.col("p_name").alias("path"), metadata.alias("metadata"))


_N = lambda condition, name: f"count(*) FILTER ({condition}) AS {name}"
_OWN = lambda family: ", ".join(_N(f"kind = '{family}.{k}'", k) for k in _FAMILY[family])
_COUNTS = {
    "python": ", ".join([
        _N("starts_with(kind, 'python.')", "python_observations"), *[_N(f"kind = 'python.{k}'", n) for k, n in (("module", "modules"), ("class", "classes"), ("function", "functions"), ("method", "methods"), ("import", "imports"), ("package_file", "package_files"))],
        _N("kind = 'python.package_file' AND file_family = 'pyproject'", "pyproject"), _N("kind = 'python.package_file' AND starts_with(file_family, 'requirements')", "requirements"), _N("kind = 'python.requirement' AND source_format = 'python-requirements'", "requirement_entries"),
        _N("kind = 'python.requirement' AND version_constraint IS NOT NULL", "requirements_pinned"), *[_N(f"kind = 'python.{k}'", n) for k, n in (("flask_route", "flask_routes"), ("fastapi_route", "fastapi_routes"), ("django_urlpattern", "django_urls"), ("django_model", "django_models"), ("django_view", "django_views"))],
        _N("kind IN ('python.test_function', 'python.test_class')", "test_cases"), _N("kind = 'python.redaction'", "redactions"), _N("kind = 'python.parse_error'", "parse_errors"),
    ]),
    **{f: _N(f"starts_with(kind, '{f}.')", f"{f}_observations") + ", " + _OWN(f) for f in ("openapi", "terraform", "nix", "ruby", "js")},
    "email": ", ".join([*[_N(f"kind = 'email.{k}'", n) for k, n in (("message", "messages"), ("mailbox", "mailboxes"), ("part", "parts"), ("attachment_stub", "attachments"), ("thread_hint", "thread_hints"), ("parse_error", "parse_errors"))], "count(DISTINCT target) FILTER (kind = 'email.address') AS addresses"]),
    "js_framework": ", ".join([_N("starts_with(kind, 'js.')", "framework_observations"), *[_N(f"starts_with(kind, 'js.') AND profile = '{p}'", p) for p in _PROFILES[:-1]]]),
}


def _summary_query(family: str):
    def run(spark, d):
        return summary.SUMMARIES[family](family_observations(spark, d))

    run.__name__ = f"{family}_family_summary"
    query(f"SELECT {_COUNTS[family]} FROM ({_FAMILY_SQL})")(run)


for _family in _COUNTS:
    _summary_query(_family)


@query(f"WITH o AS ({_FAMILY_SQL}) SELECT kind, count(*) AS n FROM o WHERE starts_with(kind, 'bash.') GROUP BY kind")
def shell_kinds(spark, d):
    o = family_observations(spark, d)
    return summary.shell_evidence_summary(o, o.select(F.lit("").alias("evidence_key"), F.lit("").alias("canonical_key")), o.select(F.lit("").alias("evidence_key"), F.col("kind").alias("raw_kind")), "bash")[0]


@query("SELECT count(DISTINCT l_suppkey) AS nodes FROM lineitem WHERE l_returnflag = 'R'")
def shell_evidence_nodes(spark, d):
    """Nodes that are reached through a family's evidence."""
    ev = tables.evidence_table(spark, d).withColumn("raw_kind", F.when(F.col("raw_kind") == "r", "bash.command").otherwise("other"))
    links = tables.evidence_table(spark, d).select("evidence_key", F.split_part("evidence_key", F.lit(":"), F.lit(5)).alias("canonical_key"))
    o = family_observations(spark, d)
    return summary.shell_evidence_summary(o, links, ev, "bash")[1]


@query(f"SELECT kind AS key, count(*) AS n FROM ({OBS}) WHERE source_id = 'user-7' GROUP BY kind")
def source_kind_counts(spark, d):
    return summary.count_map(tables.observations(spark, d).where("source_id = 'user-7'"), "kind")


@query(f"SELECT path FROM ({OBS}) WHERE kind = 'shell.host_mutation' AND category = 'c1' AND tool = 'apt'")
def host_mutators_of_category(spark, d):
    return summary.host_mutators(tables.observations(spark, d), category="c1", tool="apt").select("path")


# Files, paths and text.


def _classified(spark, d) -> DataFrame:
    f, p = tables.document_files(spark, d), F.col("path")
    return f.select("doc_id", "path", classify.language(p).alias("language"), classify.role(p, F.lit(False), classify.generated(p)).alias("role"), classify.generated(p).alias("generated"))


@query(f"WITH p AS ({PATHS}) SELECT doc_id, path FROM p WHERE (contains(lower(path), 'src1') OR FALSE) AND (path = 'src1/en' OR starts_with(path, 'src1/en/'))")
def searched_files(spark, d):
    return ops.search_files(_classified(spark, d), "SRC1", path="src1/en").select("doc_id", "path")


@query(f"WITH p AS ({PATHS}) SELECT doc_id FROM p WHERE contains(path, '/generated/')")
def generated_files(spark, d):
    return repository.filtered(_classified(spark, d), role="generated", generated="only").select("doc_id")


@query(f"""WITH p AS ({PATHS}) SELECT doc_id, CASE WHEN path = 'src0/en/d0.py' THEN 'script' WHEN starts_with(path, 'src1/de/') THEN 'generated' WHEN starts_with(path, 'src1/') THEN 'entrypoint' WHEN starts_with(path, 'src2/') THEN 'script' ELSE 'unknown' END AS role FROM p""")
def profiled_roles(spark, d):
    role = classify.profiled_role(F.col("path"), F.lit("unknown"), {"src0/en/d0.py": "script"}, generated_dirs=("src1/de",), command_dirs=("src1",), script_dirs=("src2",))
    return tables.document_files(spark, d).select("doc_id", role.alias("role"))


@query(f"WITH p AS ({PATHS}), r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'entrypoint' ELSE 'source' END AS role FROM p) SELECT doc_id FROM r WHERE role = 'entrypoint'")
def entrypoints(spark, d):
    return repository.entrypoints(tables.document_files(spark, d).withColumn("role", F.when(F.col("doc_id") % 3 == 0, "entrypoint").otherwise("source"))).select("doc_id")


@query(f"SELECT doc_id, regexp_matches(path, '(^|/)tests?/') OR ends_with(path, '.test.py') AS test FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' ELSE 'contest/' END || path || CASE WHEN doc_id % 5 = 0 THEN '.test.py' ELSE '' END AS path FROM ({PATHS}))")
def test_paths(spark, d):
    n = F.col("doc_id")
    path = F.concat(F.when(n % 4 == 0, "tests/").when(n % 4 == 1, "src/").otherwise("contest/"), "path", F.when(n % 5 == 0, ".test.py").otherwise(""))
    return tables.document_files(spark, d).select("doc_id", classify.test_path(path).alias("test"))


@query("""WITH h AS (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS pos FROM documents WHERE contains(text, 'anan')), k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM h WHERE substr(text, pos, 4) = 'anan')
SELECT doc_id, CAST(pos AS BIGINT) AS pos, c > 3 AS capped FROM k WHERE n <= 3""")
def literal_page(spark, d):
    """At most three occurrences of a file, with a flag where there are more: the feature's limit."""
    status, out = lexical.literal(read(spark, d, "documents").where("doc_id is not null").select("doc_id", "text"), "anan", ["doc_id"], max_docs=10**9, max_bytes=10**15, per_file=3)
    assert status == "ok"
    return out.select("doc_id", "pos", "capped")


@query("SELECT * FROM (SELECT doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 20000 AS fits FROM documents WHERE text IS NOT NULL)")
def admitted_within_budget(spark, d):
    """Files of a binding in order, while they fit a budget of bytes."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", "source", F.octet_length("text").alias("size"))
    return docs.select("doc_id", policy.within_budget(F.col("size"), ["doc_id"], 20000, ["source"]).alias("fits"))


@query(f"""WITH p AS ({PATHS}) SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['linux', 'amd64'] WHEN doc_id % 3 = 1 THEN ['windows'] ELSE [] END, ',') AS constraints FROM p""")
def go_constraints(spark, d):
    name = F.concat(F.lit("a/x"), F.when(F.col("doc_id") % 3 == 0, "_linux_amd64").when(F.col("doc_id") % 3 == 1, "_windows").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "_test").otherwise(""), F.lit(".go"))
    return read(spark, d, "documents").select("doc_id", F.array_join(classify.go_constraints(name), ",").alias("constraints"))


# Relations across files.


def _obs(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


@query("""WITH pages AS (SELECT 'w/p' || r_regionkey || '.html' AS page, 'w/s' || r_regionkey % 2 || '.css' AS sheet, r_regionkey FROM region),
els AS (SELECT 'w/p' || n_regionkey || '.html' AS page, n_name AS pointer, CASE WHEN n_nationkey % 2 = 0 THEN 'td' ELSE 'th' END AS tag, 'c' || n_nationkey % 3 AS cls FROM nation),
sel AS (SELECT 'w/s' || s_suppkey % 2 || '.css' AS sheet, s_name AS selector, CASE WHEN s_suppkey % 3 > 0 THEN 'td' END AS tag, 'c' || s_suppkey % 3 AS cls, s_suppkey % 5 > 3 AS deep FROM supplier)
SELECT page, sheet, selector, pointer, CASE WHEN deep THEN 'partial' ELSE 'exact' END AS match FROM pages JOIN sel USING (sheet) JOIN els USING (page) WHERE sel.cls = els.cls AND (sel.tag IS NULL OR sel.tag = els.tag)""")
def css_matches(spark, d):
    n, s, r = (read(spark, d, t) for t in ("nation", "supplier", "region"))
    text_of = lambda c: F.col(c).cast("string")
    cls = lambda c: F.array(F.concat(F.lit("c"), (F.col(c) % 3).cast("string"))).alias("classes")
    assets = r.select(F.lit("html.asset").alias("kind"), F.concat(F.lit("w/p"), text_of("r_regionkey"), F.lit(".html")).alias("path"), F.concat(F.lit("./s"), (F.col("r_regionkey") % 2).cast("string"), F.lit(".css?v=1")).alias("target"))
    elements = n.select(F.lit("html.element").alias("kind"), F.concat(F.lit("w/p"), text_of("n_regionkey"), F.lit(".html")).alias("path"), F.col("n_name").alias("name"), F.to_json(F.struct(F.when(F.col("n_nationkey") % 2 == 0, "td").otherwise("th").alias("tag"), cls("n_nationkey"))).alias("metadata"))
    selectors = s.select(F.lit("css.selector").alias("kind"), F.concat(F.lit("w/s"), (F.col("s_suppkey") % 2).cast("string"), F.lit(".css")).alias("path"), F.col("s_name").alias("name"), F.to_json(F.struct(F.when(F.col("s_suppkey") % 3 > 0, "td").alias("tag"), cls("s_suppkey"), F.when(F.col("s_suppkey") % 5 > 3, 2).otherwise(1).alias("depth"))).alias("metadata"), F.lit(1).alias("start_line"))
    return matching.css_matches(_obs([selectors, assets, elements])).select("page", "sheet", "selector", "pointer", "match")


@query("""WITH b AS (SELECT n_name AS alias, count(*) AS n, min('b' || n_nationkey) AS binding_id FROM nation WHERE n_nationkey > 3 GROUP BY 1), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '${x}' ELSE n_name END AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'f' || s_suppkey AS path, target, CASE WHEN contains(target, '${') THEN 'evaluation_dependent' WHEN n IS NULL THEN 'unsupported' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS status FROM r LEFT JOIN b ON target = alias""")
def nix_relations(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    refs = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.lit("nix.input_ref").alias("kind"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(1).alias("start_line"), F.when(F.col("s_suppkey") % 7 == 0, "${x}").otherwise(F.col("n_name")).alias("target"))
    bindings = n.where("n_nationkey > 3").select(F.col("n_name").alias("alias"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("binding_id"))
    return matching.nix_relations(refs, bindings).select("path", "target", "status")


@query("""WITH k AS (SELECT 'ex.org/m' || r_regionkey || '/d' || n_nationkey AS import_path, 'r' || r_regionkey || '/d' || n_nationkey AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
i AS (SELECT s_suppkey, 'ex.org/m' || s_nationkey % 5 || '/d' || s_nationkey AS target FROM supplier) SELECT 's' || s_suppkey || '.go' AS path, target, CASE WHEN dir IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(dir, '-') AS package_dir FROM i LEFT JOIN k ON target = import_path""")
def go_imports(spark, d):
    n, r, s = (read(spark, d, t) for t in ("nation", "region", "supplier"))
    c = lambda x: F.col(x).cast("string")
    modules = r.select(F.lit("go.module").alias("kind"), F.concat(F.lit("r"), c("r_regionkey"), F.lit("/go.mod")).alias("path"), F.concat(F.lit("ex.org/m"), c("r_regionkey")).alias("name"))
    packages = n.select(F.lit("go.package").alias("kind"), F.concat(F.lit("r"), c("n_regionkey"), F.lit("/d"), c("n_nationkey"), F.lit("/x.go")).alias("path"), F.concat(F.lit("d"), c("n_nationkey")).alias("name"))
    imports = s.select(F.lit("go.import").alias("kind"), F.concat(F.lit("s"), c("s_suppkey"), F.lit(".go")).alias("path"), F.lit(1).alias("start_line"), F.concat(F.lit("ex.org/m"), (F.col("s_nationkey") % 5).cast("string"), F.lit("/d"), c("s_nationkey")).alias("target"))
    return matching.go_imports(_obs([imports, modules, packages])).select("path", "target", "status", F.coalesce("package_dir", F.lit("-")).alias("package_dir"))


@query("""WITH p AS (SELECT 'r' || n_regionkey AS dir, count(DISTINCT n_nationkey % 2) AS n FROM nation WHERE n_regionkey > 0 GROUP BY 1) SELECT 'r' || r_regionkey || '/a.s' AS path, CASE WHEN n IS NULL THEN 'no_package' WHEN n = 1 THEN 'companion' ELSE 'conflict' END AS status FROM region LEFT JOIN p ON 'r' || r_regionkey = dir""")
def go_assembly(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    packages = n.where("n_regionkey > 0").select(F.lit("go.package").alias("kind"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/x.go")).alias("path"), F.concat(F.lit("p"), (F.col("n_nationkey") % 2).cast("string")).alias("name"))
    return matching.go_assembly(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("/a.s")).alias("path")), packages).select("path", "status")


@query("""WITH r AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'a' || l_suppkey)), ',') AS authors, array_to_string(list_sort(list(DISTINCT 'l' || l_partkey)), ',') AS links FROM lineitem GROUP BY 1)
SELECT 'feed-' || o_custkey AS source_id, CAST(o_orderkey AS VARCHAR) AS item, o_orderpriority AS title, coalesce(authors, '') AS authors, coalesce(links, '') AS links FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def feed_items(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    source, item = F.concat(F.lit("feed-"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderkey").cast("string").alias("name")
    items = o.select(source, F.lit("feed.item").alias("kind"), item, F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published_at"))).alias("metadata"))
    with_order = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = [with_order.select(source, F.lit(k).alias("kind"), item, F.concat(F.lit(p), F.col(c).cast("string")).alias("target")) for k, p, c in (("feed.author", "a", "l_suppkey"), ("feed.link", "l", "l_partkey"))]
    out = services.feed_items(_obs([items, *refs]))
    return out.select("source_id", "item", "title", F.coalesce(F.array_join("authors", ","), F.lit("")).alias("authors"), F.coalesce(F.array_join("links", ","), F.lit("")).alias("links"))


@query(f"SELECT canonical_key FROM ({NODES}) WHERE kind = 'customer' ORDER BY canonical_key LIMIT 10")
def nodes_page(spark, d):
    """A page with whether more follow: the limit is the feature."""
    page = ops.read_page(ops.nodes(tables.node_table(spark, d), kind="customer"), 10)
    assert page["has_more"] and page["total"] == 10
    return spark.createDataFrame([(r["canonical_key"],) for r in page["records"]], "canonical_key string")


@query("SELECT doc_id, lower(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')[1]) AS first_token, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}_]')")
def token_counts(spark, d):
    """Tokens of whole texts, as the full-text operators see them."""
    t = lexical.tokens(F.col("text"))
    docs = read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", t.alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", F.get("t", F.lit(0)).alias("first_token"), F.size("t").cast("long").alias("n"))


@query("SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) = coalesce(text, '') AND NOT (contains(coalesce(text, ''), chr(0)) AND text <> '') AS same FROM documents")
def normalized_texts(spark, d):
    body = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", (F.coalesce(text.normalized(body, 2**30), F.lit("")) == body).alias("same"))
