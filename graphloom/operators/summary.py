"""Summaries: conditional counts in one pass, count maps, drift against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with a count for each condition: one scan, partial counts, no shuffle of rows."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def count_map(df: DataFrame, column: str) -> DataFrame:
    """(key, n) of a column, null as unknown."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def as_map(df: DataFrame) -> DataFrame:
    """One row with the map of (key, n) rows."""
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("counts"))


def metrics(families: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(metric, key, value): each family's rows, in all or by a column."""
    out = None
    for name, (df, column) in families.items():
        rows = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")
        if column is not None:
            rows = rows.union(count_map(df, column).select(F.lit(f"{name}_by_{column}"), "key", "n"))
        out = rows if out is None else out.union(rows)
    return out


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences between two metric tables: (metric, key, before, after); equal values don't show."""
    b = baseline.select("metric", "key", F.col("value").alias("before"))
    c = current.select("metric", "key", F.col("value").alias("after"))
    return b.join(c, ["metric", "key"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def storage_summary(observations: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, node_links: DataFrame, edge_links: DataFrame, runs: DataFrame) -> DataFrame:
    tables = {"raw_observations": observations, "files": files, "nodes": nodes, "edges": edges, "evidence": evidence, "node_evidence": node_links, "edge_evidence": edge_links, "runs": runs}
    out = runs.agg(F.max("run_id").alias("latest_run_id"))
    for name, df in tables.items():
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # two tables of one row
    return out


def accepted_run(runs: DataFrame, graph: str = "graph_id") -> DataFrame:
    """For each graph its latest run and its latest complete one."""
    return runs.groupBy(graph).agg(F.max("run_id").alias("latest_run_id"), F.max_by("status", "run_id").alias("latest_status"), F.max(F.when(F.col("status") == "complete", F.col("run_id"))).alias("accepted_run_id"))


def meta(name: str) -> Column:
    """A value of the observation's metadata as text."""
    return F.get_json_object("metadata", f"$.{name}")


def flag(value: Column) -> Column:
    """A boolean as PostgreSQL reads it: 1, on, 0, of, off and prefixes of true, yes, false, no; null is false, anything else an error."""
    v = F.lower(F.trim(value))
    yes = v.rlike("^(?:1|on|t|tr|tru|true|y|ye|yes)$")
    no = v.rlike("^(?:0|of|off|f|fa|fal|fals|false|n|no)$")
    return F.when(value.isNull(), False).when(yes, True).when(no, False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean"))


def host_mutators(observations: DataFrame, category: str | None = None, tool: str | None = None) -> DataFrame:
    out = observations.where(F.col("kind") == "shell.host_mutation").select("path", F.col("start_line").alias("line"), "name", meta("category").alias("category"), meta("tool").alias("tool"), flag(meta("privileged")).alias("privileged"))
    for column, value in (("category", category), ("tool", tool)):
        out = out if value is None else out.where(F.col(column) == value)
    return out.orderBy("path", "line", "name")


def host_mutator_summary(observations: DataFrame) -> DataFrame:
    return host_mutators(observations).groupBy("category", "tool").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("privileged").cast("long")).alias("privileged_count")).orderBy("category", "tool")


def _kinds(prefix: str, *names: str) -> dict[str, Column]:
    return {n.replace(".", "_"): F.col("kind") == f"{prefix}.{n}" for n in names}


def python_summary(o: DataFrame) -> DataFrame:
    k = F.col("kind")
    package = lambda name: (k == "python.package_file") & (meta("file_family") == name)
    return counts(o, {
        "python_observations": k.startswith("python."), "modules": k == "python.module", "classes": k == "python.class", "functions": k == "python.function", "methods": k == "python.method", "imports": k == "python.import",
        "package_files": k == "python.package_file", "pyproject": package("pyproject"), "requirements": (k == "python.package_file") & F.startswith(meta("file_family"), F.lit("requirements")), "requirement_entries": (k == "python.requirement") & (meta("source_format") == "python-requirements"),
        "requirements_pinned": (k == "python.requirement") & meta("version_constraint").isNotNull(), "flask_routes": k == "python.flask_route", "fastapi_routes": k == "python.fastapi_route", "django_urls": k == "python.django_urlpattern",
        "django_models": k == "python.django_model", "django_views": k == "python.django_view", "test_cases": k.isin("python.test_function", "python.test_class"), "redactions": k == "python.redaction", "parse_errors": k == "python.parse_error",
    })


def openapi_summary(o: DataFrame) -> DataFrame:
    return counts(o, {"openapi_observations": F.col("kind").startswith("openapi."), **_kinds("openapi", "document", "path", "operation", "component", "schema", "security_scheme", "parameter", "response", "parse_error")})


def terraform_summary(o: DataFrame) -> DataFrame:
    return counts(o, {"terraform_observations": F.col("kind").startswith("terraform."), **_kinds("terraform", "file", "block", "resource", "data", "module", "variable", "output", "provider", "local", "reference", "parse_error")})


def nix_summary(o: DataFrame) -> DataFrame:
    return counts(o, {"nix_observations": F.col("kind").startswith("nix."), **_kinds("nix", "flake", "flake_input", "input_ref", "module_export", "module", "app", "check", "package", "dev_shell", "parse_error")})


def email_summary(o: DataFrame) -> DataFrame:
    k = F.col("kind")
    return o.agg(
        F.count_if(k == "email.message").alias("messages"), F.count_if(k == "email.mailbox").alias("mailboxes"), F.count_if(k == "email.part").alias("parts"), F.count_if(k == "email.attachment_stub").alias("attachments"),
        F.count_if(k == "email.thread_hint").alias("thread_hints"), F.count_if(k == "email.parse_error").alias("parse_errors"), F.countDistinct(F.when(k == "email.address", F.col("target"))).alias("addresses"),
    )


def ruby_summary(o: DataFrame) -> DataFrame:
    return counts(o, {"ruby_observations": F.col("kind").startswith("ruby."), **_kinds("ruby", "file", "module", "class", "method", "singleton_method", "constant", "route", "test_case", "test_method", "reference", "gem_dependency", "rake_task", "dynamic", "parse_error")})


def js_summary(o: DataFrame) -> DataFrame:
    return counts(o, {"js_observations": F.col("kind").startswith("js."), **_kinds("js", "file", "module", "function", "class", "method", "variable", "component", "route", "test_suite", "test_case", "reference", "import", "export", "hook", "test_expectation", "dynamic", "parse_error")})


def js_framework_summary(o: DataFrame) -> DataFrame:
    profile = meta("framework_profile")
    framework = F.col("kind").startswith("js.") & profile.isNotNull()
    return counts(o, {"framework_observations": framework, **{p: framework & (profile == p) for p in ("node", "express", "nest", "next", "jest", "jquery")}})


def shell_evidence_summary(o: DataFrame, node_links: DataFrame, evidence: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(kind counts of a shell family, nodes reached through its evidence)."""
    own = o.where(F.col("kind").startswith(family + "."))
    ev = evidence.where(F.col("raw_kind").startswith(family + "."))
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind"), node_links.join(ev.select("evidence_key"), "evidence_key", "left_semi").agg(F.countDistinct("canonical_key").alias("nodes"))


SUMMARIES = {
    "python": python_summary, "openapi": openapi_summary, "terraform": terraform_summary, "nix": nix_summary, "email": email_summary, "ruby": ruby_summary, "js": js_summary,
    "js_framework": js_framework_summary, "host_mutators": host_mutator_summary,
}


def ingested_sources(o: DataFrame) -> DataFrame:
    """Sources with their runs, artifacts and the latest run."""
    return o.groupBy("source_id").agg(F.countDistinct("run_id").alias("runs"), F.count(F.lit(1)).alias("observations"), F.countDistinct("path").alias("artifacts"), F.max("run_id").alias("latest_run_id"), F.max_by("path", F.struct("run_id", "ordinal")).alias("latest_artifact")).orderBy("source_id")


def source_runs(o: DataFrame) -> DataFrame:
    return o.groupBy("source_id", "run_id").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("kind").alias("kinds")).orderBy("source_id", F.desc("run_id"))


def manifest_summary(manifests: DataFrame, count_columns: list[str], map_columns: list[str]) -> DataFrame:
    """Sums of counts and merged count maps over manifests: (metric, key, value)."""
    out = manifests.agg(F.count(F.lit(1)).alias("value")).select(F.lit("manifests").alias("metric"), F.lit("").alias("key"), "value")
    for c in count_columns:
        out = out.union(manifests.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long")).select(F.lit(c), F.lit(""), "*"))
    for c in map_columns:
        out = out.union(manifests.select(F.explode(c).alias("key", "n")).groupBy("key").agg(F.sum("n").cast("long").alias("n")).select(F.lit(c), "key", "n"))
    return out
