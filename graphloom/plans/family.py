"""Registered queries for whole family summaries, ingested feeds, fences and destinations: orders stand for observations of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feeds, lexical, ranking, read as ops, reports
from . import tables
from .queries import EDGES, EVIDENCE, NODES, OBS, query
from .tables import read

_text = lambda c: F.col(c).cast("string")

# Observations of a family: kinds by the order's key, each field by another divisor; None leaves a field out.

_TF = ("true", None, "false", "yes")


class Family:
    """Kinds and fields of made-up observations, as a DataFrame over orders and as SQL."""

    def __init__(self, kinds: tuple[str, ...], **fields: tuple[str | None, ...]):
        self.kinds, self.fields = kinds, fields
        self.divisors = {n: 3 + 2 * i for i, n in enumerate(fields)}
        lists = ", ".join(f"[{', '.join('NULL' if v is None else repr(v) for v in vs)}][CAST((o_orderkey // {self.divisors[n]}) % {len(vs)} + 1 AS INTEGER)] AS {n}" for n, vs in fields.items())
        self.sql = f"SELECT o_orderkey AS ordinal, [{', '.join(map(repr, kinds))}][CAST(o_orderkey % {len(kinds)} + 1 AS INTEGER)] AS kind, {lists} FROM orders"

    def rows(self, spark, d) -> DataFrame:
        pick = lambda vs, n: F.get(F.array(*[F.lit(v) for v in vs]), (n % len(vs)).cast("int"))
        key = F.col("o_orderkey")
        own = {n: pick(vs, F.floor(key / self.divisors[n])) for n, vs in self.fields.items()}
        kind = pick(self.kinds, key)
        plain = {n: own.get(n, F.lit(None).cast("string")) for n in ("target", "path", "name")}
        return read(spark, d, "orders").select(
            F.lit(1).cast("long").alias("run_id"), key.alias("ordinal"), kind.alias("kind"), *[c.alias(n) for n, c in plain.items()], F.concat(kind, F.lit(":"), key.cast("string")).alias("canonical_key"),
            F.to_json(F.struct(*[c.alias(n) for n, c in own.items() if n not in plain])).alias("metadata"),
        )

    def counted(self, *counters: tuple[str, str, str]) -> str:
        """SQL for (section, counter, condition) over the observations."""
        return " UNION ALL ".join(f"SELECT '{s}' AS section, '{c}' AS counter, count(*) FILTER ({w}) AS value FROM o" for s, c, w in counters)


_T = lambda c: f"coalesce({c} IN ('true', 'yes'), FALSE)"
_PYTHON = Family(
    (
        "python.reference", "python.redaction", "python.parse_error", "python.package_file", "python.pyproject", "python.test_file", "python.test_fixture", "python.pytest_fixture", "python.import", "python.module", "python.class", "python.function",
        "python.method", "python.requirement", "python.flask_route", "python.django_model", "config.reference", "config.document", "config.path",
    ),
    source_format=("python-requirements", "pyproject.toml", None), file_family=("requirements-dev", "pyproject", None), reference_kind=("direct_url", "index_url", "include_file", "module", None), resolution=("local", None), not_fetched=_TF, direct_url=_TF, framework=("flask", None, "other"),
    redaction_reason=("credentialed-url", "private-index", "secret-like", "flask-setting", None), error_kind=("line-limit", "dynamic-import", None), dynamic=_TF, project_name=("acme-core", "other", None), target=("file:a", "external:b", None), name=("acme", "x"),
)
_REF, _RED, _ERR = "kind = 'python.reference'", "kind = 'python.redaction'", "kind = 'python.parse_error'"
_KIND = lambda s, c, k: (s, c, f"kind = '{k}'")
_CONFIG = (_KIND("generic_config", "config_documents", "config.document"), _KIND("generic_config", "config_paths", "config.path"))
_PY_KINDS = {s: ((c, f"python.{k}") for c, k in names.items()) for s, names in reports.PYTHON_SECTIONS.items()}


@query(f"""WITH o AS ({_PYTHON.sql}) {_PYTHON.counted(
    ("", "python_observations", "starts_with(kind, 'python.')"), *[_KIND(s, c, k) for s, names in _PY_KINDS.items() for c, k in names],
    ("tests", "fixtures", "kind IN ('python.test_fixture', 'python.pytest_fixture')"), ("package_files", "requirements", "kind = 'python.package_file' AND (starts_with(file_family, 'requirements') OR source_format = 'python-requirements')"), _KIND("package_files", "pyproject", "python.pyproject"),
    ("references", "total", _REF), ("references", "package_refs", f"{_REF} AND (source_format IN ('python-requirements', 'pyproject.toml') OR reference_kind IN ('include_file', 'direct_url', 'index_url'))"), ("references", "local_file_refs", f"{_REF} AND (starts_with(target, 'file:') OR resolution = 'local')"),
    ("references", "direct_urls_not_fetched", f"{_REF} AND {_T('not_fetched')} AND (reference_kind = 'direct_url' OR {_T('direct_url')})"), ("references", "index_urls_not_fetched", f"{_REF} AND {_T('not_fetched')} AND reference_kind = 'index_url'"), ("references", "framework_refs", f"{_REF} AND framework = 'flask'"),
    ("redactions", "credentialed_urls", f"{_RED} AND redaction_reason = 'credentialed-url'"), ("redactions", "private_indexes", f"{_RED} AND redaction_reason = 'private-index'"), ("redactions", "secret_like_config", f"{_RED} AND redaction_reason = 'secret-like'"),
    ("redactions", "framework_settings", f"{_RED} AND (framework = 'flask' OR redaction_reason = 'flask-setting')"), ("diagnostics", "parse_errors", _ERR), ("diagnostics", "limit_overflows", f"{_ERR} AND error_kind = 'line-limit'"), ("diagnostics", "dynamic_constructs", f"{_ERR} AND ({_T('dynamic')} OR error_kind = 'dynamic-import')"),
    _KIND("generic_python", "imports", "python.import"), _KIND("generic_config", "config_references", "config.reference"), *[_KIND("generic_python", c, f"python.{k}") for c, k in (("modules", "module"), ("classes", "class"), ("functions", "function"), ("methods", "method"))], *_CONFIG,
)} UNION ALL SELECT 'own_project', 'profile_observed', CAST(count(*) > 0 AS BIGINT) FROM o WHERE kind IN ('python.pyproject', 'python.package_file', 'python.test_file') AND (project_name = 'acme-core' OR name = 'acme')""")
def python_report(spark, d):
    o = _PYTHON.rows(spark, d)
    return reports.python_report(o, o, ("acme",))


_OPENAPI = Family(
    ("openapi.document", "openapi.operation", "openapi.reference", "openapi.redaction", "openapi.parse_error", "openapi.path", "openapi.schema", "openapi.tag", "config.parse_error", "config.reference", "config.document", "config.path"),
    spec_family=("openapi3", "swagger2", None), method=("get", "POST", "Trace", None), redaction_reason=("credentialed-url", "openapi-ref-summary-only", "secret-prone-openapi-field", None), reference_scope=("internal", "local_file", "remote", "external_docs"), not_fetched=_TF,
    error_kind=("unsupported-openapi-version", "openapi-path-limit", "openapi-local-ref-outside-root", "malformed-openapi-json", None),
)
_OREF, _OERR = "kind = 'openapi.reference'", "kind = 'openapi.parse_error'"


@query(f"""WITH o AS ({_OPENAPI.sql}) {_OPENAPI.counted(
    ("", "openapi_observations", "starts_with(kind, 'openapi.')"), _KIND("", "openapi_documents", "openapi.document"), *[("spec_families", f, f"kind = 'openapi.document' AND spec_family = '{f}'") for f in ("openapi3", "swagger2")], *[_KIND("openapi", c, f"openapi.{k}") for c, k in reports.OPENAPI_KINDS.items()],
    *[("methods", m, f"kind = 'openapi.operation' AND upper(method) = '{m}'") for m in reports.OPENAPI_METHODS], *[("redactions", c, f"kind = 'openapi.redaction' AND redaction_reason = '{r}'") for c, r in reports.OPENAPI_REDACTIONS.items()],
    ("references", "internal_refs", f"{_OREF} AND reference_scope = 'internal'"), ("references", "local_file_refs", f"{_OREF} AND reference_scope = 'local_file'"), ("references", "remote_refs_not_fetched", f"{_OREF} AND reference_scope = 'remote' AND {_T('not_fetched')}"),
    ("references", "external_docs_not_fetched", f"{_OREF} AND reference_scope = 'external_docs' AND {_T('not_fetched')}"), ("references", "refs_not_fetched", f"{_OREF} AND {_T('not_fetched')}"), ("redactions", "credentialed_urls", "starts_with(kind, 'openapi.') AND redaction_reason = 'credentialed-url'"),
    ("diagnostics", "parse_errors", _OERR), ("diagnostics", "unsupported_specs", f"{_OERR} AND error_kind = 'unsupported-openapi-version'"), ("diagnostics", "limit_overflows", f"{_OERR} AND error_kind = 'openapi-path-limit'"), ("diagnostics", "local_ref_errors", f"{_OERR} AND error_kind = 'openapi-local-ref-outside-root'"),
    ("diagnostics", "malformed_specs", "kind IN ('config.parse_error', 'openapi.parse_error') AND error_kind = 'malformed-openapi-json'"), _KIND("generic_config", "config_references", "config.reference"), _KIND("generic_config", "config_parse_errors", "config.parse_error"), *_CONFIG,
)}""")
def openapi_report(spark, d):
    o = _OPENAPI.rows(spark, d)
    return reports.openapi_report(o, o)


_JS = Family((*[f"{f}.{k}" for f, names in reports.JS_FRAMEWORKS.items() for k in names.values()], "js.framework_reference", "js.middleware", "js.parse_error", "js.route", "js.component", "js.variable"), reference_kind=("environment", "x"), dynamic=_TF, error_kind=("framework-observation-limit", "framework-selector-limit", None))
_JS_GENERIC = "kind IN ('js.framework_reference', 'js.middleware')"


@query(f"""WITH o AS ({_JS.sql}) {_JS.counted(
    ("", "framework_observations", f"regexp_matches(kind, '^({'|'.join(reports.JS_FRAMEWORKS)})[.]') OR {_JS_GENERIC}"), *[("framework_profiles", f, f"starts_with(kind, '{f}.')") for f in reports.JS_FRAMEWORKS], *[_KIND(f, c, f"{f}.{k}") for f, names in reports.JS_FRAMEWORKS.items() for c, k in names.items()],
    ("framework_profiles", "generic_js", _JS_GENERIC), ("node", "env_references", "kind = 'js.framework_reference' AND reference_kind = 'environment'"), ("express", "dynamic_routes", f"kind = 'express.route' AND {_T('dynamic')}"),
    *[("diagnostics", e.replace("-", "_"), f"kind = 'js.parse_error' AND error_kind = '{e}'") for e in ("framework-observation-limit", "framework-selector-limit")], *[_KIND("generic_js", f"canonical_{c}", f"js.{k}") for c, k in (("routes", "route"), ("test_suites", "test_suite"), ("test_cases", "test_case"), ("components", "component"))],
)}""")
def js_framework_report(spark, d):
    o = _JS.rows(spark, d)
    return reports.js_framework_report(o, o)


_EMAIL = Family(
    ("email.mailbox", "email.message", "email.address", "email.part", "email.attachment_stub", "email.thread_hint", "email.parse_error", "email.reference"), format=("eml", "mbox"), content_type=("text/plain", "text/html", "image/png"), inline=_TF, content_id_present=_TF, message_id_present=_TF, message_id_valid=_TF,
    has_attachments=_TF, has_text_html=_TF, has_text_plain=_TF, mailbox_message_count_limited=_TF, reference_kind=("list_unsubscribe", None), error_kind=("header-limit", "malformed-part", "mbox-missing-from-separator", "other", None), address_domain=("a.org", "b.org", "c.org", None),
)
_MSG, _STUB = "kind = 'email.message'", "kind = 'email.attachment_stub'"


@query(f"""WITH o AS ({_EMAIL.sql}) {_EMAIL.counted(
    *[_KIND("", c, f"email.{k}") for c, k in (("mailboxes", "mailbox"), ("messages", "message"), ("addresses", "address"), ("mime_parts", "part"), ("attachment_stubs", "attachment_stub"), ("thread_hints", "thread_hint"), ("address_observations", "address"), ("parse_errors", "parse_error"))],
    *[("", f"{f}_messages", f"{_MSG} AND format = '{f}'") for f in ("eml", "mbox")], *[("", f"text_{t}_parts", f"kind = 'email.part' AND content_type = 'text/{t}'") for t in ("plain", "html")], ("", "inline_attachments", f"{_STUB} AND {_T('inline')}"),
    ("", "content_id_parts", f"kind IN ('email.part', 'email.attachment_stub') AND {_T('content_id_present')}"), ("", "message_id_present", f"{_MSG} AND {_T('message_id_present')}"), ("", "message_id_missing_or_invalid", f"{_MSG} AND NOT ({_T('message_id_present')} AND {_T('message_id_valid')})"),
    ("", "messages_with_attachments", f"{_MSG} AND {_T('has_attachments')}"), ("", "messages_with_html", f"{_MSG} AND {_T('has_text_html')}"), ("", "messages_with_plain", f"{_MSG} AND {_T('has_text_plain')}"), ("", "mailbox_limits", f"kind = 'email.mailbox' AND {_T('mailbox_message_count_limited')}"),
    ("", "list_unsubscribe_references", "kind = 'email.reference' AND reference_kind = 'list_unsubscribe'"), ("", "malformed_or_oversized_diagnostics", "kind = 'email.parse_error' AND error_kind <> 'other'"),
    ("", "message_references", "ordinal % 4 IN (0, 1) AND ordinal % 2 = 0 AND starts_with(kind, 'email.')"), ("", "external_url_references", "ordinal % 4 = 2"),
)} UNION ALL SELECT '', 'address_domains', count(DISTINCT address_domain) FROM o WHERE kind = 'email.address'""")
def email_report(spark, d):
    o = _EMAIL.rows(spark, d)
    n = F.col("ordinal")
    target = F.when(n % 4 == 0, "email.message:m").when(n % 4 == 1, "unknown:email-message:m").when(n % 4 == 2, "external.url:u").otherwise("file:f")
    edges = o.select(F.col("canonical_key").alias("source_canonical_key"), target.alias("target_canonical_key"), F.when(n % 2 == 0, "references").otherwise("contains").alias("edge_kind"))
    return reports.email_report(o, o, edges)


_NIX = Family(
    ("nix.app", "nix.package", "nix.devShell", "nix.check", "nix.import", "nix.path_ref", "nix.flake_input", "nix.output_section", "nix.dynamic_output_shape", "nix.unsupported_flake_shape", "nix.output", "file", "config.reference", "config.parse_error", "config.redaction", "config.path", "config.document"),
    language=("nix", None), program=("p", None, None), program_resolution=("local", "unknown", None), resolution=("local", "dynamic", "unknown", "repo-escaping", None), resolution_reason=("repo-escaping-x", None), has_url=("true", None), has_follows=("false", "true"), source_redacted=("true", None), source_type=("github", "path", "follows"),
    section=("packages", "apps", "templates"), section_family=("output", "module"), shape=("inherit", "dynamic"), pattern=("genAttrs", "flake-utils", "imported_outputs"), redacted=_TF, flake_ref=("f", None), system=("s", "s", None), name=("n", "n", "n", None), dynamic=_TF, dynamic_reason=("r", None, None),
    target=("unknown:file:a", "unknown:b", "file:c"), path=("flake.nix", "a/flake.nix", "b/flake.nix", "xflake.nix", "c.nix"),
)
_OUT = "kind IN ('nix.app', 'nix.package', 'nix.devShell', 'nix.check')"
_NREF, _IMP, _INP = (f"kind = 'nix.{k}'" for k in ("path_ref", "import", "flake_input"))
_VALUES = lambda kind, section, key, values: [(section, v, f"kind = '{kind}' AND {key} = '{v}'") for v in values]


@query(f"""WITH o AS ({_NIX.sql}), flakes AS (SELECT DISTINCT path FROM o WHERE kind = 'file' AND regexp_matches(path, '(^|/)flake[.]nix$') AND coalesce(language, 'nix') = 'nix'), t AS (SELECT DISTINCT ordinal // 4 AS edge, CASE ordinal // 4 % 3 WHEN 0 THEN 'sources' WHEN 1 THEN 'defines' ELSE 'exposes_script' END AS edge_kind, kind FROM o) {_NIX.counted(
    ("", "nix_observations", "starts_with(kind, 'nix.')"), ("", "nix_files", "kind = 'file' AND language = 'nix'"), *[_KIND("raw", c, k) for c, k in {"imports": "nix.import", "path_refs": "nix.path_ref", **reports.NIX_OUTPUTS}.items()], *[_KIND("canonical", c, k) for c, k in reports.NIX_OUTPUTS.items()], *_CONFIG,
    ("programs", "app_programs_total", "kind = 'nix.app' AND (program IS NOT NULL OR program_resolution IS NOT NULL)"), *_VALUES("nix.app", "programs", "program_resolution", reports.NIX_RESOLUTIONS), ("paths", "path_refs_total", _NREF), *_VALUES("nix.path_ref", "paths", "resolution", ("local", "dynamic", "unknown")),
    ("paths", "repo_escaping_or_rejected", f"{_NREF} AND (target = 'unknown:file:a' OR resolution = 'repo-escaping' OR resolution_reason IS NOT NULL)"), ("flake_inputs", "total", _INP), *[("flake_inputs", c, f"{_INP} AND {k} = 'true'") for c, k in (("with_url", "has_url"), ("with_follows", "has_follows"), ("redacted_sources", "source_redacted"))],
    *_VALUES("nix.flake_input", "flake_inputs.source_types", "source_type", reports.NIX_SOURCE_TYPES), _KIND("output_sections", "total", "nix.output_section"), *_VALUES("nix.output_section", "output_sections.by_section", "section", reports.NIX_SECTIONS), *_VALUES("nix.output_section", "output_sections.by_family", "section_family", reports.NIX_FAMILIES),
    *_VALUES("nix.output_section", "output_sections.by_shape", "shape", reports.NIX_SHAPES), _KIND("dynamic_output_shapes", "total", "nix.dynamic_output_shape"), *_VALUES("nix.dynamic_output_shape", "dynamic_output_shapes.by_pattern", "pattern", reports.NIX_DYNAMIC), _KIND("unsupported_flake_shapes", "total", "nix.unsupported_flake_shape"),
    *_VALUES("nix.unsupported_flake_shape", "unsupported_flake_shapes.by_pattern", "pattern", reports.NIX_UNSUPPORTED), _KIND("generic_config", "config_references", "config.reference"), _KIND("generic_config", "config_parse_errors", "config.parse_error"), ("generic_config", "config_redactions", f"kind = 'config.redaction' OR kind = 'config.path' AND {_T('redacted')}"),
    ("diagnostics", "missing_output_identity", f"{_OUT} AND (flake_ref IS NULL OR system IS NULL OR name IS NULL)"), ("diagnostics", "dynamic_imports", f"{_IMP} AND ({_T('dynamic')} OR resolution = 'dynamic' OR dynamic_reason IS NOT NULL)"), ("diagnostics", "unknown_imports", f"{_IMP} AND (starts_with(target, 'unknown:') OR resolution = 'unknown')"),
    ("diagnostics", "unknown_app_programs", "kind = 'nix.app' AND program_resolution = 'unknown'"), ("diagnostics", "raw_only_path_refs", _NREF),
)} UNION ALL SELECT '', 'flake_files', count(*) FROM flakes UNION ALL SELECT 'diagnostics', 'flake_files_without_output_observations', count(*) FROM flakes WHERE path NOT IN (SELECT path FROM o WHERE {_OUT})
UNION ALL SELECT 'canonical', 'output_sections', count(*) FROM o WHERE kind = 'nix.output' AND ordinal + 3 IN (SELECT ordinal FROM o WHERE kind = 'nix.output_section')
UNION ALL SELECT 'edges', c, (SELECT count(*) FROM t WHERE edge_kind = e AND list_contains(ks, kind)) FROM (VALUES ('import_sources', 'sources', ['nix.import']), ('output_defines', 'defines', ['nix.app', 'nix.package', 'nix.devShell', 'nix.check']), ('output_section_defines', 'defines', ['nix.output_section']), ('app_program_edges', 'exposes_script', ['nix.app'])) v(c, e, ks)""")
def nix_report(spark, d):
    """An edge for four observations each; the node of an output links to the evidence three orders on."""
    o = _NIX.rows(spark, d)
    o = o.withColumn("metadata", F.when(F.col("name").isNull(), F.col("metadata")).otherwise(F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(',"name":"n"}'))))
    n = F.col("ordinal")
    evidence = o.select(F.concat(F.lit("e"), n.cast("string")).alias("evidence_key"), F.col("kind").alias("raw_kind"))
    number = F.floor(n / 4)
    edge = F.concat(F.lit("x"), number.cast("string")).alias("edge_key")
    edges = o.select(edge, F.when(number % 3 == 0, "sources").when(number % 3 == 1, "defines").otherwise("exposes_script").alias("edge_kind")).distinct()
    edge_links = o.select(edge, F.concat(F.lit("e"), n.cast("string")).alias("evidence_key"))
    node_links = o.select("canonical_key", F.concat(F.lit("e"), (n + 3).cast("string")).alias("evidence_key"))
    return reports.nix_report(o, o, edges, edge_links, node_links, evidence)


# Graphs, runs and fences.


@query(f"""WITH o AS ({OBS}), l AS (SELECT * FROM o WHERE run_id = (SELECT max(run_id) FROM o)), n AS ({NODES}), e AS ({EDGES})
SELECT 'files_by_language' AS section, coalesce(lang, 'unknown') AS counter, count(*) AS value FROM documents GROUP BY 2 UNION ALL SELECT 'observations_by_kind', kind, count(*) FROM o GROUP BY kind UNION ALL SELECT 'latest_observations_by_kind', kind, count(*) FROM l GROUP BY kind
UNION ALL SELECT 'nodes_by_kind', kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'edges_by_kind', k, count(*) FROM e GROUP BY k UNION ALL SELECT '', 'files', count(*) FROM documents UNION ALL SELECT '', 'observations', count(*) FROM o
UNION ALL SELECT '', 'latest_observations', count(*) FROM l UNION ALL SELECT '', 'nodes', count(*) FROM n UNION ALL SELECT '', 'edges', count(*) FROM e""")
def graph_report(spark, d):
    files = tables.document_files(spark, d).select(F.col("lang").alias("language"))
    return reports.graph_report(tables.observations(spark, d), files, tables.node_table(spark, d), tables.edge_table(spark, d))


@query("""WITH r AS (SELECT o_custkey AS graph_id, o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN 'b' || o_orderkey END AS bundle FROM orders),
a AS (SELECT graph_id, max(run_id) AS latest_run_id, arg_max(status, run_id) AS latest_status, max(run_id) FILTER (status = 'complete' AND bundle IS NOT NULL) AS accepted_run_id, count(*) AS runs FROM r GROUP BY graph_id),
f AS (SELECT l_orderkey AS run_id, string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) AS families, count(*) AS records FROM lineitem GROUP BY 1)
SELECT graph_id, coalesce(accepted_run_id, -1) AS accepted_run_id, latest_run_id, latest_status, 'b' || accepted_run_id AS publication_bundle_id, runs, families, CAST(coalesce(records, 0) AS BIGINT) AS records FROM a LEFT JOIN f ON accepted_run_id = f.run_id""")
def refresh_report(spark, d):
    """Customers as graphs, orders as their runs, line items as the records of families."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("b"), _text("o_orderkey"))).alias("publication_bundle_id"))
    families = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.lower("l_returnflag").alias("family")).agg(F.count(F.lit(1)).alias("records")).join(o.select("run_id", "graph_id"), "run_id")
    out = reports.refresh_report(o, families)
    records = F.when(F.col("family_counts").isNotNull(), F.aggregate(F.map_values("family_counts"), F.lit(0).cast("long"), lambda a, b: a + b))
    return out.select(
        "graph_id", F.coalesce("accepted_run_id", F.lit(-1).cast("long")).alias("accepted_run_id"), "latest_run_id", "latest_status", "publication_bundle_id", "runs", F.array_join(F.map_keys("family_counts"), ",").alias("families"),
        F.coalesce(records, F.lit(0).cast("long")).alias("records"),
    )


@query(f"""SELECT TRUE AS repository_exists, (SELECT count(*) FROM events) AS raw_observations_total, (SELECT count(*) FROM ({OBS}) WHERE run_id = 3) AS latest_run_raw_observations, (SELECT count(*) FROM ({NODES})) AS canonical_nodes, (SELECT count(*) FROM ({EDGES})) AS canonical_edges, CAST(3 AS BIGINT) AS run_id, 'complete' AS status""")
def publication_status(spark, d):
    """The third week is the accepted run."""
    runs = tables.observations(spark, d).select("run_id", F.lit("complete").alias("status")).distinct()
    return reports.publication_status(runs, runs.where("run_id = 3"), tables.observations(spark, d), tables.node_table(spark, d), tables.edge_table(spark, d))


@query("""WITH a AS (SELECT c_custkey AS k, c_custkey % 7 AS run, c_custkey % 5 AS bundle FROM customer) SELECT CAST(k AS VARCHAR) AS repository_id, CASE WHEN k % 11 = 0 THEN 'state' WHEN k % 13 = 0 THEN 'run_status' WHEN k % 3 = 0 THEN 'publication_bundle_id' WHEN k % 4 = 0 THEN 'policy_digest' WHEN k % 6 = 1 THEN 'run_snapshot_manifest_id' ELSE 'current' END AS fence FROM a""")
def lexical_authorities(spark, d):
    """Customers as repositories whose generations and runs disagree in some field."""
    k = F.col("c_custkey")
    base = read(spark, d, "customer").select(k, _text("c_custkey").alias("repository_id"), (k % 9).alias("lexical_generation_id"), (k % 7).alias("run_id"), _text("c_custkey").alias("publication_bundle_id"), (k % 5).cast("string").alias("snapshot_manifest_id"), F.lit("p").alias("policy_digest"))
    generations = base.withColumn("state", F.when(k % 11 == 0, "building").otherwise("published")).withColumn("publication_bundle_id", F.when(k % 3 == 0, "x").otherwise(F.col("publication_bundle_id"))).withColumn("policy_digest", F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("policy_digest")))
    runs = base.withColumn("status", F.when(k % 13 == 0, "failed").otherwise("complete")).withColumn("snapshot_manifest_id", F.when(k % 6 == 1, "y").otherwise(F.col("snapshot_manifest_id")))
    return lexical.active_authority(base, generations, runs).select("repository_id", "fence")


@query(f"""WITH e AS (SELECT DISTINCT evidence_key, order_key, ev_start AS line FROM ({EVIDENCE})), c AS (SELECT 'orders:' || o_orderkey AS order_key, x AS n, x * 20 + 1 AS a, x * 20 + 15 AS z FROM orders, (VALUES (0), (1), (2)) v(x) WHERE o_orderkey % 4 <> 0)
SELECT evidence_key, coalesce((SELECT order_key || '/' || min(n) FROM c WHERE c.order_key = e.order_key AND line BETWEEN a AND z GROUP BY order_key), (SELECT order_key || '/' || min(n) FROM c WHERE c.order_key = e.order_key GROUP BY order_key)) AS chunk_id,
EXISTS (SELECT 1 FROM c WHERE c.order_key = e.order_key AND line BETWEEN a AND z) AS covered FROM e""")
def covering_chunks(spark, d):
    """Each piece of evidence with the chunk of its order that covers its line; some orders have no chunks."""
    x = F.col("chunk_ordinal")
    chunks = read(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit("orders:"), _text("o_orderkey")).alias("order_key"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_ordinal"))
    chunks = chunks.select("*", (x * 20 + 1).alias("start_line"), (x * 20 + 15).alias("end_line"), F.concat_ws("/", "order_key", x.cast("string")).alias("chunk_id"))
    at = tables.evidence_table(spark, d).select("evidence_key", "order_key", F.col("ev_start").alias("start_line")).distinct()
    return lexical.covering_chunk(at, chunks, ["order_key"], ["evidence_key"]).select("evidence_key", "chunk_id", "covered")


@query(f"""WITH e AS ({EVIDENCE}), c AS (SELECT order_key, coalesce(max(CASE WHEN run_id = 5 THEN run_id END), max(run_id)) AS run FROM e GROUP BY order_key)
SELECT canonical_key, kind, display_name FROM ({NODES}) WHERE canonical_key IN (SELECT e.order_key FROM e JOIN c ON e.order_key = c.order_key AND run_id = run WHERE raw_kind <> 'n' AND ev_start > 20)""")
def admitted_nodes(spark, d):
    ev = tables.evidence_table(spark, d)
    links = ev.select(F.col("order_key").alias("canonical_key"), "evidence_key")
    role = F.when(F.col("raw_kind") != "n", "direct").otherwise("reference")
    return ops.admitted_nodes(tables.node_table(spark, d), links, ev.drop("order_key"), 5, role, F.col("ev_start") > 20)


@query(f"""SELECT canonical_key, CAST(row_number() OVER (ORDER BY canonical_key) AS INTEGER) AS rank, CAST(split_part(canonical_key, ':', 2) AS BIGINT) % 3 <> 0 AS unverified FROM ({NODES})""")
def key_ordered(spark, d):
    n = F.split_part("canonical_key", F.lit(":"), F.lit(2)).cast("long")
    c = tables.node_table(spark, d).withColumns({"has_verified_direct_location": n % 3 == 0, "is_current_publication": F.lit(True)})
    return ranking.key_order(c).select("canonical_key", "rank", (F.col("evidence_tier") == 2).alias("unverified"))


@query(f"""WITH e AS ({EVIDENCE}) SELECT order_key AS canonical_key, path AS graph_path, min((run_id, ev_start, ev_end))[1] AS run_id, min((run_id, ev_start, ev_end))[2] AS start_line FROM e GROUP BY order_key, path""")
def first_destinations(spark, d):
    """The least place of each order: all in its own file, so by run and lines."""
    none = {c: F.lit(None).cast("string") for c in ("source_binding_id", "snapshot_id", "source_relative_path", "publication_relation", "path_namespace")}
    at = tables.evidence_table(spark, d).select(F.col("order_key").alias("canonical_key"), F.lit(None).cast("long").alias("binding_revision"), "run_id", F.col("path").alias("graph_path"), F.col("ev_start").alias("start_line"), F.col("ev_end").alias("end_line")).withColumns(none)
    out = ranking.first_destination(at, ["canonical_key"])
    return out.select("canonical_key", F.col("destination.p7").alias("graph_path"), F.col("destination.p4").alias("run_id"), F.col("destination.p8").cast("int").alias("start_line"))


# Ingested feeds: orders as observations, two to an item.


def _feed(spark, d) -> dict[str, DataFrame]:
    k, item = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2).cast("long")
    o = read(spark, d, "orders")
    observations = o.select(
        (k % 3).alias("run_id"), k.alias("ordinal"), F.concat(F.lit("feed-"), (item % 7).cast("string")).alias("source_id"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("source_run_id"), F.concat(F.lit("a"), k.cast("string")).alias("artifact_id"),
        F.concat(F.lit("p/"), k.cast("string")).alias("artifact_path"), F.lit("rss").alias("source_type"), F.lit("ok").alias("policy_status"), F.concat(F.lit("2024-01-0"), (item % 7 + 1).cast("string")).alias("acquired_at"),
    )
    evidence = o.select((k % 3).alias("run_id"), k.alias("raw_observation_ordinal"), F.concat(F.lit("e"), k.cast("string")).alias("evidence_key"))
    key = F.concat(F.lit("feed.item:"), item.cast("string"))
    links = o.select(F.concat(F.lit("e"), k.cast("string")).alias("evidence_key"), key.alias("canonical_key"), F.lit("observed").alias("link_kind"))
    items = o.select(item.alias("i")).distinct()
    number = F.col("i")
    node_key = F.concat(F.lit("feed.item:"), number.cast("string"))
    published = F.when(number % 5 > 0, F.concat(F.lit("2024-02-1"), (number % 5).cast("string")))
    own = items.select(node_key.alias("canonical_key"), F.lit("feed.item").alias("kind"), F.concat(F.lit("t"), number.cast("string")).alias("display_name"), F.to_json(F.struct(F.concat(F.lit("t"), number.cast("string")).alias("title"), published.alias("published_at"))).alias("metadata"))
    people = read(spark, d, "supplier").select(F.concat(F.lit("feed.author:"), _text("s_suppkey")), F.lit("feed.author"), F.col("s_name"), F.lit("{}"))
    topics = read(spark, d, "nation").select(F.concat(F.lit("feed.category:"), _text("n_nationkey")), F.lit("feed.category"), F.col("n_name"), F.lit("{}"))
    target = {"author": F.concat(F.lit("feed.author:"), (number % 10 + 1).cast("string")), "category": F.concat(F.lit("feed.category:"), (number % 25).cast("string")), "link": F.concat(F.lit("external.url:"), (number % 17).cast("string"))}
    edges = None
    for scope, t in target.items():
        e = items.select(F.concat(F.lit(f"{scope}:"), number.cast("string")).alias("edge_key"), F.lit("references").alias("edge_kind"), node_key.alias("source_canonical_key"), t.alias("target_canonical_key"), F.to_json(F.struct(F.lit(scope).alias("scope"), F.lit("true").alias("not_fetched"), F.lit("text/html").alias("mime_type"))).alias("metadata"))
        edges = e if edges is None else edges.union(e)
    edge_links = links.select("evidence_key", F.explode(F.array(*[F.concat(F.lit(f"{s}:"), F.split_part("canonical_key", F.lit(":"), F.lit(2))) for s in target])).alias("edge_key"), "link_kind")
    return {"observations": observations, "evidence": evidence, "node_links": links, "nodes": own.union(people).union(topics), "edges": edges, "edge_links": edge_links}


@query("""WITH i AS (SELECT o_orderkey // 2 AS i, max('r' || o_orderkey % 3) AS source_run_id, max('a' || o_orderkey) AS artifact_id FROM orders WHERE o_orderkey // 2 % 7 = 3 GROUP BY 1), p AS (SELECT *, CASE WHEN i % 5 > 0 THEN '2024-02-1' || i % 5 END AS published_at FROM i)
SELECT 'feed.item:' || i AS canonical_key, 't' || i AS title, published_at, source_run_id, artifact_id, 'external.url:' || i % 17 AS links, coalesce((SELECT s_name FROM supplier WHERE s_suppkey = i % 10 + 1), '') AS authors, (SELECT n_name FROM nation WHERE n_nationkey = i % 25) AS categories FROM p ORDER BY published_at DESC NULLS LAST, 1 LIMIT 20""")
def source_feed_items(spark, d):
    """A source's newest items: the limit is the feature."""
    t = _feed(spark, d)
    out = feeds.source_feed_items(t["observations"], t["evidence"], t["node_links"], t["nodes"], t["edges"], "feed-3", 20)
    return out.select("canonical_key", "title", "published_at", "source_run_id", "artifact_id", *[F.array_join(c, ",").alias(n) for n, c in (("links", "link_targets"), ("authors", "authors"), ("categories", "categories"))])


@query("""SELECT 'feed.item:' || o_orderkey // 2 AS source_item_key, 'external.url:' || o_orderkey // 2 % 17 AS target_key, TRUE AS not_fetched, 'text/html' AS media_type, 'r' || o_orderkey % 3 AS source_run_id, 'a' || o_orderkey AS artifact_id, o_orderkey AS ordinal, 'observed' AS link_kind FROM orders WHERE o_orderkey // 2 % 7 = 3""")
def source_references(spark, d):
    t = _feed(spark, d)
    return feeds.source_references(t["observations"], t["evidence"], t["edge_links"], t["edges"], "feed-3", target_kind="external.url").drop("target_display", "artifact_path")


@query("SELECT 'e' || o_orderkey AS evidence_key, o_orderkey AS raw_observation_ordinal, o_orderkey % 3 AS run_id, 'observed' AS link_kind FROM orders WHERE o_orderkey // 2 = 45")
def item_evidence(spark, d):
    t = _feed(spark, d)
    return feeds.explain_item(t["observations"], t["evidence"], t["node_links"], t["nodes"], t["edges"], "feed.item:45")["evidence"]


@query("""SELECT 'feed-' || i % 7 AS source_id, max('a' || k) AS artifact_id, max('r' || k % 3) AS source_run_id, '2024-01-07' AS acquired_at, 'rss' AS source_type FROM (SELECT o_orderkey AS k, o_orderkey // 2 AS i FROM orders) WHERE i % 7 = 6 GROUP BY 1""")
def item_source(spark, d):
    """The source acquired last."""
    return feeds.item_source(_feed(spark, d)["observations"]).select("source_id", "artifact_id", "source_run_id", "acquired_at", "source_type")
