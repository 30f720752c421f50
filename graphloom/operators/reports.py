"""Whole summaries by family: every counter as a row (section, counter, value), each relation counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summary import count_map, flag, meta

Counters = dict[tuple[str, str], Column]

# Counters of each section with the kind that each counts.
PYTHON_SECTIONS = {
    "packaging": {"requirements": "requirement", "dependency_groups": "dependency_group", "build_systems": "build_system", "entry_points": "entry_point", "tool_configs": "tool_config"},
    "tests": {"test_files": "test_file", "unittest_cases": "unittest_case", "pytest_tests": "pytest_test", "test_functions": "test_function", "test_methods": "test_method", "parametrize": "test_parametrize", "assertions": "test_assertion"},
    "frameworks": {
        "flask_apps": "flask_app", "flask_blueprints": "flask_blueprint", "flask_routes": "flask_route", "fastapi_apps": "fastapi_app", "fastapi_routers": "fastapi_router", "fastapi_routes": "fastapi_route", "fastapi_dependencies": "fastapi_dependency",
        "django_projects": "django_project", "django_apps": "django_app", "django_urlpatterns": "django_urlpattern", "django_views": "django_view", "django_models": "django_model", "django_setting_references": "django_setting_reference",
    },
}
PYTHON_FRAMEWORKS = ("flask", "fastapi", "django")
PACKAGE_FORMATS = ("python-requirements", "pyproject.toml")
PACKAGE_REFERENCES = ("include_file", "constraint_file", "direct_url", "vcs_url", "editable_local_path", "local_path", "index_url", "extra_index_url", "find_links")
DIRECT_URLS = ("direct_url", "vcs_url", "dependency_url")
INDEX_URLS = ("index_url", "extra_index_url", "find_links")
NIX_OUTPUTS = {"apps": "nix.app", "packages": "nix.package", "dev_shells": "nix.devShell", "checks": "nix.check"}
NIX_RESOLUTIONS = ("local", "dynamic", "external", "unknown")
NIX_SOURCE_TYPES = ("github", "git", "path", "tarball", "follows", "unknown", "dynamic")
NIX_SECTIONS = ("packages", "apps", "devShells", "checks", "nixosModules", "darwinModules", "homeManagerModules", "overlays", "formatter", "templates", "legacyPackages")
NIX_FAMILIES = ("output", "module", "overlay", "formatter", "template", "legacy_package")
NIX_SHAPES = ("direct_assignment", "nested_attrset", "inherit", "merged_attrset", "dynamic", "helper_framework", "unknown")
NIX_DYNAMIC = ("eachDefaultSystem", "genAttrs", "forAllSystems", "flake-utils", "flake-parts", "string_interpolation")
NIX_UNSUPPORTED = ("imported_outputs", "merged_attrset", "inherit_outputs", "nested_attrset_without_direct_identity", "template_section", "legacy_packages_section", "unknown_dynamic")
OPENAPI_KINDS = {
    "info": "info", "servers": "server", "paths": "path", "operations": "operation", "parameters": "parameter", "request_bodies": "request_body", "responses": "response",
    "schemas": "schema", "components": "component", "security_schemes": "security_scheme", "tags": "tag", "examples": "example",
}
OPENAPI_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "TRACE")
OPENAPI_REDACTIONS = {"openapi_ref_summaries": "openapi-ref-summary-only", "text_summaries": "openapi-text-summary-only", "example_summaries": "openapi-example-summary-only", "secret_prone_fields": "secret-prone-openapi-field"}
OPENAPI_LIMITS = ("openapi-path-limit", "openapi-operation-limit", "openapi-schema-limit", "openapi-parameter-limit", "openapi-response-limit", "openapi-reference-limit")
OPENAPI_MALFORMED = ("malformed-openapi-json", "malformed-openapi-yaml")
OPENAPI_UNSUPPORTED = ("unsupported-openapi-document", "unsupported-openapi-version")
JS_FRAMEWORKS = {
    "node": {"entrypoints": "entrypoint", "requires": "require", "exports": "export"},
    "express": {"apps": "app", "routers": "router", "routes": "route", "middleware": "middleware", "error_handlers": "error_handler"},
    "nest": {"modules": "module", "controllers": "controller", "providers": "provider", "routes": "route", "decorators": "decorator"},
    "next": {"pages": "page", "api_routes": "api_route", "app_routes": "app_route", "components": "component", "route_handlers": "route"},
    "jest": {"suites": "suite", "tests": "test", "expectations": "expectation", "mocks": "mock"},
    "jquery": {"selectors": "selector", "events": "event", "ajax_references": "ajax", "plugin_references": "plugin_reference"},
}
JS_GENERIC = (
    "js.dom_selector", "js.dom_event", "js.ajax_reference", "js.framework_reference", "js.framework_profile", "js.runtime_profile", "js.package_context", "js.route_handler", "js.middleware", "js.controller", "js.provider",
    "js.module_binding", "js.test_config", "js.server_entrypoint", "js.client_entrypoint",
)

def _k() -> Column:
    return F.col("kind")


def rows(df: DataFrame, counters: Counters) -> DataFrame:
    """(section, counter, value): the rows of df that meet each condition, counted in one pass; null is false."""
    names = list(counters)
    one = df.agg(*[F.count_if(F.coalesce(counters[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(c).alias("counter"), F.col(f"c{i}").alias("value")) for i, (s, c) in enumerate(names)])))


def _number(df: DataFrame, section: str, counter: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(section).alias("section"), F.lit(counter).alias("counter"), "value")


def _of(kind: str, section: str, key: str, values: tuple[str, ...]) -> Counters:
    """A counter for each value of a key in the metadata of a kind."""
    return {(section, v): (_k() == kind) & (meta(key) == v) for v in values}


def _true(name: str) -> Column:
    return flag(meta(name))


def _config(nodes: DataFrame) -> DataFrame:
    return rows(nodes, {("generic_config", "config_documents"): _k() == "config.document", ("generic_config", "config_paths"): _k() == "config.path"})


def python_report(observations: DataFrame, nodes: DataFrame, project_names: tuple[str, ...] = ()) -> DataFrame:
    """project_names: prefixes of names that mark a project as the reader's own (profile_observed is 1 if one is found)."""
    own = _k().startswith("python.")
    ref, red, err = (_k() == f"python.{k}" for k in ("reference", "redaction", "parse_error"))
    kind_of, reason, error = meta("reference_kind"), meta("redaction_reason"), meta("error_kind")
    framework = meta("framework").isin(*PYTHON_FRAMEWORKS)
    unfetched = lambda c: ref & _true("not_fetched") & c
    c: Counters = {("", "python_observations"): own}
    c |= {(s, n): _k() == f"python.{k}" for s, names in PYTHON_SECTIONS.items() for n, k in names.items()}
    c |= {
        ("tests", "fixtures"): _k().isin("python.test_fixture", "python.pytest_fixture"),
        ("package_files", "requirements"): (_k() == "python.package_file") & (F.coalesce(meta("file_family").startswith("requirements"), F.lit(False)) | F.coalesce(meta("source_format") == "python-requirements", F.lit(False))),
        ("package_files", "pyproject"): _k() == "python.pyproject",
        ("references", "total"): ref,
        ("references", "package_refs"): ref & (F.coalesce(meta("source_format").isin(*PACKAGE_FORMATS), F.lit(False)) | F.coalesce(kind_of.isin(*PACKAGE_REFERENCES), F.lit(False))),
        ("references", "local_file_refs"): ref & (F.coalesce(F.col("target").startswith("file:"), F.lit(False)) | F.coalesce(meta("resolution") == "local", F.lit(False))),
        ("references", "direct_urls_not_fetched"): unfetched(F.coalesce(kind_of.isin(*DIRECT_URLS), F.lit(False)) | _true("direct_url")),
        ("references", "index_urls_not_fetched"): unfetched(kind_of.isin(*INDEX_URLS)),
        ("references", "framework_refs"): ref & framework,
        ("redactions", "credentialed_urls"): red & reason.contains("credential"),
        ("redactions", "private_indexes"): red & reason.contains("index"),
        ("redactions", "secret_like_config"): red & reason.contains("secret"),
        ("redactions", "framework_settings"): red & (F.coalesce(framework, F.lit(False)) | F.coalesce(reason.rlike("|".join(PYTHON_FRAMEWORKS)), F.lit(False))),
        ("diagnostics", "parse_errors"): err,
        ("diagnostics", "limit_overflows"): err & error.contains("limit"),
        ("diagnostics", "dynamic_constructs"): err & (_true("dynamic") | F.coalesce(error.startswith("dynamic-"), F.lit(False))),
        ("generic_python", "imports"): _k() == "python.import",
        ("generic_config", "config_references"): _k() == "config.reference",
    }
    canonical = rows(nodes, {("generic_python", n): _k() == f"python.{k}" for n, k in (("modules", "module"), ("classes", "class"), ("functions", "function"), ("methods", "method"))})
    mine = F.lit(False)
    for p in project_names:
        mine = mine | F.coalesce(meta("project_name").startswith(p), F.lit(False)) | F.coalesce(F.col("name").startswith(p), F.lit(False))
    observed = observations.where(_k().isin("python.pyproject", "python.package_file", "python.test_file") & mine).limit(1)
    return rows(observations, c).union(canonical).union(_config(nodes)).union(_number(observed, "own_project", "profile_observed"))


def nix_report(observations: DataFrame, nodes: DataFrame, edges: DataFrame, edge_links: DataFrame, node_links: DataFrame, evidence: DataFrame) -> DataFrame:
    output, target, resolution = _k().isin(*NIX_OUTPUTS.values()), F.col("target"), meta("resolution")
    app, ref, imp, inp = (_k() == f"nix.{k}" for k in ("app", "path_ref", "import", "flake_input"))
    no = F.lit(False)
    blank = lambda key: F.coalesce(meta(key), F.lit("")) == ""
    c: Counters = {("", "nix_observations"): _k().startswith("nix."), ("", "nix_files"): (_k() == "file") & (meta("language") == "nix")}
    c |= {("raw", n): _k() == k for n, k in {"imports": "nix.import", "path_refs": "nix.path_ref", **NIX_OUTPUTS}.items()}
    c |= {
        ("programs", "app_programs_total"): app & F.array_contains(F.json_object_keys("metadata"), "program") | app & meta("program_resolution").isNotNull(),
        **_of("nix.app", "programs", "program_resolution", NIX_RESOLUTIONS),
        ("paths", "path_refs_total"): ref,
        **_of("nix.path_ref", "paths", "resolution", ("local", "dynamic", "unknown")),
        ("paths", "repo_escaping_or_rejected"): ref & (F.coalesce(target.startswith("unknown:file:"), no) | F.coalesce(resolution.isin("repo-escaping", "rejected"), no) | F.coalesce(meta("resolution_reason").startswith("repo-escaping"), no)),
        ("flake_inputs", "total"): inp,
        **{("flake_inputs", n): inp & (meta(key) == "true") for n, key in (("with_url", "has_url"), ("with_follows", "has_follows"), ("redacted_sources", "source_redacted"))},
        **_of("nix.flake_input", "flake_inputs.source_types", "source_type", NIX_SOURCE_TYPES),
        ("output_sections", "total"): _k() == "nix.output_section",
        **_of("nix.output_section", "output_sections.by_section", "section", NIX_SECTIONS),
        **_of("nix.output_section", "output_sections.by_family", "section_family", NIX_FAMILIES),
        **_of("nix.output_section", "output_sections.by_shape", "shape", NIX_SHAPES),
        ("dynamic_output_shapes", "total"): _k() == "nix.dynamic_output_shape",
        **_of("nix.dynamic_output_shape", "dynamic_output_shapes.by_pattern", "pattern", NIX_DYNAMIC),
        ("unsupported_flake_shapes", "total"): _k() == "nix.unsupported_flake_shape",
        **_of("nix.unsupported_flake_shape", "unsupported_flake_shapes.by_pattern", "pattern", NIX_UNSUPPORTED),
        ("generic_config", "config_references"): _k() == "config.reference",
        ("generic_config", "config_parse_errors"): _k() == "config.parse_error",
        ("generic_config", "config_redactions"): (_k() == "config.redaction") | (_k() == "config.path") & _true("redacted"),
        ("diagnostics", "missing_output_identity"): output & (blank("flake_ref") | blank("system") | blank("name")),
        ("diagnostics", "dynamic_imports"): imp & (_true("dynamic") | F.coalesce(resolution == "dynamic", no) | meta("dynamic_reason").isNotNull()),
        ("diagnostics", "unknown_imports"): imp & (F.coalesce(target.startswith("unknown:"), no) | F.coalesce(resolution == "unknown", no)),
        ("diagnostics", "unknown_app_programs"): app & (meta("program_resolution") == "unknown"),
        ("diagnostics", "raw_only_path_refs"): ref,
    }
    flakes = observations.where((_k() == "file") & F.col("path").rlike("(^|/)flake\\.nix$") & (F.coalesce(meta("language"), F.lit("nix")) == "nix")).select("path").distinct()
    silent = flakes.join(observations.where(output).select("path"), "path", "left_anti")
    triples = edges.select("edge_key", "edge_kind").join(edge_links.select("edge_key", "evidence_key"), "edge_key").join(evidence.where(F.col("raw_kind").startswith("nix.")).select("evidence_key", "raw_kind"), "evidence_key")
    triples = triples.select("edge_key", "edge_kind", "raw_kind").distinct()
    kind, raw = F.col("edge_kind"), F.col("raw_kind")
    seen = node_links.join(evidence.where(raw == "nix.output_section").select("evidence_key"), "evidence_key", "left_semi").select("canonical_key")
    sections = nodes.where(_k() == "nix.output").select("canonical_key").join(seen, "canonical_key", "left_semi").distinct()
    canonical = rows(nodes, {("canonical", n): _k() == k for n, k in NIX_OUTPUTS.items()}).union(_number(sections, "canonical", "output_sections"))
    linked = rows(triples, {
        ("edges", "import_sources"): (kind == "sources") & (raw == "nix.import"), ("edges", "output_defines"): (kind == "defines") & raw.isin(*NIX_OUTPUTS.values()),
        ("edges", "output_section_defines"): (kind == "defines") & (raw == "nix.output_section"), ("edges", "app_program_edges"): (kind == "exposes_script") & (raw == "nix.app"),
    })
    flat = _number(flakes, "", "flake_files").union(_number(silent, "diagnostics", "flake_files_without_output_observations"))
    return rows(observations, c).union(flat).union(canonical).union(_config(nodes)).union(linked)


def openapi_report(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    own, ref, err = _k().startswith("openapi."), _k() == "openapi.reference", _k() == "openapi.parse_error"
    error, scope, method = meta("error_kind"), meta("reference_scope"), F.upper(meta("method"))
    unfetched = ref & _true("not_fetched")
    c: Counters = {("", "openapi_observations"): own, ("", "openapi_documents"): _k() == "openapi.document"}
    c |= _of("openapi.document", "spec_families", "spec_family", ("openapi3", "swagger2")) | {("openapi", n): _k() == f"openapi.{k}" for n, k in OPENAPI_KINDS.items()}
    c |= {("methods", m): (_k() == "openapi.operation") & (method == m) for m in OPENAPI_METHODS} | {("redactions", n): (_k() == "openapi.redaction") & (meta("redaction_reason") == v) for n, v in OPENAPI_REDACTIONS.items()}
    c |= {
        ("references", "internal_refs"): ref & (scope == "internal"), ("references", "local_file_refs"): ref & (scope == "local_file"), ("references", "remote_refs_not_fetched"): unfetched & (scope == "remote"),
        ("references", "external_docs_not_fetched"): unfetched & (scope == "external_docs"), ("references", "refs_not_fetched"): unfetched, ("redactions", "credentialed_urls"): own & (meta("redaction_reason") == "credentialed-url"),
        ("diagnostics", "parse_errors"): err, ("diagnostics", "unsupported_specs"): err & error.isin(*OPENAPI_UNSUPPORTED), ("diagnostics", "limit_overflows"): err & error.isin(*OPENAPI_LIMITS),
        ("diagnostics", "local_ref_errors"): err & (error == "openapi-local-ref-outside-root"), ("diagnostics", "malformed_specs"): _k().isin("config.parse_error", "openapi.parse_error") & error.isin(*OPENAPI_MALFORMED),
        ("generic_config", "config_references"): _k() == "config.reference", ("generic_config", "config_parse_errors"): _k() == "config.parse_error",
    }
    return rows(observations, c).union(_config(nodes))


def js_framework_report(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    of = {f: [f"{f}.{k}" for k in names.values()] for f, names in JS_FRAMEWORKS.items()}
    c: Counters = {("", "framework_observations"): _k().isin(*[k for ks in of.values() for k in ks], *JS_GENERIC)}
    c |= {("framework_profiles", f): _k().isin(*ks) for f, ks in of.items()} | {(f, n): _k() == f"{f}.{k}" for f, names in JS_FRAMEWORKS.items() for n, k in names.items()}
    c |= {
        ("framework_profiles", "generic_js"): _k().isin(*JS_GENERIC), ("node", "env_references"): (_k() == "js.framework_reference") & (meta("reference_kind") == "environment"), ("express", "dynamic_routes"): (_k() == "express.route") & _true("dynamic"),
        ("diagnostics", "framework_observation_limit"): (_k() == "js.parse_error") & (meta("error_kind") == "framework-observation-limit"), ("diagnostics", "framework_selector_limit"): (_k() == "js.parse_error") & (meta("error_kind") == "framework-selector-limit"),
    }
    return rows(observations, c).union(rows(nodes, {("generic_js", f"canonical_{n}"): _k() == f"js.{k}" for n, k in (("routes", "route"), ("test_suites", "test_suite"), ("test_cases", "test_case"), ("components", "component"))}))


def email_report(observations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    is_ = {k: _k() == f"email.{k}" for k in ("mailbox", "message", "address", "part", "attachment_stub", "thread_hint")}
    n: Counters = {("", c): is_[k] for c, k in (("mailboxes", "mailbox"), ("messages", "message"), ("addresses", "address"), ("mime_parts", "part"), ("attachment_stubs", "attachment_stub"), ("thread_hints", "thread_hint"))}
    n |= {("", f"{f}_messages"): is_["message"] & (meta("format") == f) for f in ("eml", "mbox")}
    n |= {("", f"text_{t}_parts"): is_["part"] & (meta("content_type") == f"text/{t}") for t in ("plain", "html")}
    n |= {
        ("", "inline_attachments"): is_["attachment_stub"] & _true("inline"), ("", "content_id_parts"): (is_["part"] | is_["attachment_stub"]) & _true("content_id_present"), ("", "message_id_present"): is_["message"] & _true("message_id_present"),
        ("", "message_id_missing_or_invalid"): is_["message"] & ~(_true("message_id_present") & _true("message_id_valid")), ("", "messages_with_attachments"): is_["message"] & _true("has_attachments"), ("", "messages_with_html"): is_["message"] & _true("has_text_html"),
        ("", "messages_with_plain"): is_["message"] & _true("has_text_plain"), ("", "mailbox_limits"): is_["mailbox"] & _true("mailbox_message_count_limited"),
    }
    err, error = _k() == "email.parse_error", meta("error_kind")
    raw: Counters = {
        ("", "address_observations"): _k() == "email.address", ("", "list_unsubscribe_references"): (_k() == "email.reference") & (meta("reference_kind") == "list_unsubscribe"), ("", "parse_errors"): err,
        ("", "malformed_or_oversized_diagnostics"): err & (error.contains("limit") | error.contains("malformed") | (error == "mbox-missing-from-separator")),
    }
    domains = nodes.where(is_["address"]).select(meta("address_domain").alias("d")).where("d IS NOT NULL").distinct()
    target = F.col("target_canonical_key")
    refs = edges.where((F.col("edge_kind") == "references") & F.col("source_canonical_key").startswith("email."))
    linked = rows(refs, {("", "message_references"): target.startswith("email.message:") | target.startswith("unknown:email-message:"), ("", "external_url_references"): target.startswith("external.url:")})
    return rows(nodes, n).union(rows(observations, raw)).union(_number(domains, "", "address_domains")).union(linked)


def graph_report(observations: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and count maps of a graph as (section, counter, value): files by language, observations by kind in all and in the latest run, nodes and edges by kind."""
    latest = observations.join(F.broadcast(observations.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")  # one row
    maps = {"files_by_language": (files, "language"), "observations_by_kind": (observations, "kind"), "latest_observations_by_kind": (latest, "kind"), "nodes_by_kind": (nodes, "kind"), "edges_by_kind": (edges, "edge_kind")}
    out = None
    for section, (df, column) in maps.items():
        part = count_map(df, column).select(F.lit(section).alias("section"), F.col("key").alias("counter"), F.col("n").alias("value"))
        out = part if out is None else out.union(part)
    for name, df in (("files", files), ("observations", observations), ("latest_observations", latest), ("nodes", nodes), ("edges", edges)):
        out = out.union(_number(df, "", name))
    return out


def refresh_report(runs: DataFrame, families: DataFrame) -> DataFrame:
    """For each graph its latest run, its latest complete publication and the map of that publication's families to their counts.

    runs: graph_id, run_id, status, publication_bundle_id; families: graph_id, run_id, family, records. A graph without a complete publication has nulls there.
    """
    complete = F.when((F.col("status") == "complete") & F.col("publication_bundle_id").isNotNull(), F.col("run_id"))
    out = runs.groupBy("graph_id").agg(F.max("run_id").alias("latest_run_id"), F.max_by("status", "run_id").alias("latest_status"), F.max(complete).alias("accepted_run_id"), F.max_by("publication_bundle_id", complete).alias("publication_bundle_id"), F.count(F.lit(1)).alias("runs"))
    maps = families.groupBy("graph_id", F.col("run_id").alias("accepted_run_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "records")))).alias("family_counts"))  # seven families
    return out.join(maps, ["graph_id", "accepted_run_id"], "left")


def publication_status(runs: DataFrame, accepted: DataFrame, observations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the accepted run's status and publication fields with the graph's counts; without an accepted run repository_exists is false and all counts are 0.

    accepted has one row at most, with run_id; runs has run_id, status and publication fields.
    """
    run = runs.join(F.broadcast(accepted.select("run_id")), "run_id", "left_semi").limit(1)  # the accepted run alone
    counts = accepted.agg(F.count(F.lit(1)).alias("_accepted"))
    own = observations.join(F.broadcast(accepted.select("run_id")), "run_id", "left_semi")
    for name, df in (("raw_observations_total", observations), ("latest_run_raw_observations", own), ("canonical_nodes", nodes), ("canonical_edges", edges)):
        counts = counts.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # tables of one row
    exists = F.col("_accepted") > 0
    fields = counts.select(exists.alias("repository_exists"), *[F.when(exists, F.col(c)).otherwise(0).alias(c) for c in counts.columns if c != "_accepted"])
    return fields.join(run, F.lit(True), "left")  # with one row
