"""Canonicalization: observations to nodes, edges, evidence, links and diagnostics.

A rule says what a kind of observation defines or refers to. All rules are rows of one table, joined to observations by kind (a bounded
table), so a corpus is read once whatever the number of kinds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_text, edge_key, escape_segment, evidence_key, file_key, identity_hash, key_display_name, key_kind
from ..schema import GRAPH_KEY_VERSION
from . import merge

# kind -> (shape, node namespace, edge kind). Shapes: define: the file defines the named node; refer: the file refers to the target;
# file: a node alone; raw: evidence alone.
RULES: dict[str, tuple[str, str, str]] = {
    "file": ("file", "file", ""),
    **{k: ("define", k, "defines") for k in (
        "python.module", "python.class", "python.function", "python.method", "python.requirement", "python.flask_route", "python.fastapi_route", "python.django_urlpattern", "python.django_model", "python.django_view",
        "python.package_file", "python.test_function", "python.test_class", "js.module", "js.function", "js.class", "js.component", "js.route", "js.test_suite", "js.test_case", "js.export", "ruby.module", "ruby.class", "ruby.method",
        "ruby.route", "ruby.test_case", "ruby.gem_dependency", "go.package", "go.function", "go.type", "go.method", "go.module", "rust.item", "feed.document", "feed.channel", "feed.item", "email.message", "email.mailbox", "email.part",
        "email.attachment_stub", "email.thread_hint", "config.document", "config.path", "html.document", "html.element", "css.stylesheet", "css.selector", "xml.document", "warc.record", "document.page", "document.section",
        "document.table", "terraform.resource", "terraform.data", "terraform.module", "terraform.variable", "terraform.output", "terraform.provider", "terraform.local", "openapi.document", "openapi.path", "openapi.operation",
        "openapi.schema", "openapi.component", "openapi.security_scheme", "nix.flake", "nix.module_export", "nix.package", "nix.app", "nix.check", "bats.file", "bats.test_case", "zunit.file", "zunit.suite", "zunit.test_case",
        "shell.function", "bash.function", "zsh.function", "awk.function", "powershell.function", "github.repository", "github.issue", "github.pull_request", "github.release", "github.workflow", "memory.entity",
    )},
    "markdown.document": ("define", "doc.page", "defines"), "markdown.heading": ("define", "doc.section", "contains"), "markdown.adr_metadata": ("define", "doc.adr", "defines"), "markdown.skill_metadata": ("define", "doc.skill", "defines"),
    **{k: ("refer", "external", e) for k, e in (
        ("python.import", "imports"), ("js.import", "imports"), ("go.import", "imports"), ("ruby.require", "loads"), ("markdown.link", "links_to"), ("html.link", "links_to"), ("html.asset", "references"), ("feed.link", "references"), ("feed.author", "references"),
        ("feed.category", "references"), ("feed.enclosure", "references"), ("email.address", "references"), ("config.reference", "references"), ("xml.reference", "references"), ("css.import", "imports"), ("css.asset", "references"), ("nix.input_ref", "references"),
        ("nix.flake_input", "depends_on"), ("nix.import", "imports"), ("shell.command", "executes"), ("shell.source", "sources"), ("shell.host_mutation", "mutates_host"), ("shell.redirect", "writes"), ("shell.env_read", "reads_env"), ("shell.env_write", "writes_env"),
        ("zsh.network_intent", "network_intent"), ("zsh.package_intent", "package_intent"), ("zsh.host_mutation_intent", "host_mutation_intent"), ("terraform.reference", "references"), ("openapi.reference", "references"), ("warc.link", "references"),
        ("go.require", "requires_module"), ("go.replace", "replaces_module"), ("memory.relation", "references"), ("css.selector_match", "styles"),
    )},
    **{k: ("raw", "", "") for k in ("python.parse_error", "config.parse_error", "html.parse_error", "css.parse_error", "email.parse_error", "feed.parse_error", "markdown.parse_error", "terraform.parse_error", "nix.parse_error", "js.parse_error", "secret.marker")},
}
OMITTED = ("argument_value", "raw_line", "value", "password", "token", "secret")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    node_links: DataFrame
    edge_links: DataFrame
    diagnostics: DataFrame

    def ok(self) -> bool:
        return self.diagnostics.where("severity = 'error'").limit(1).count() == 0


def rule_table(spark: SparkSession, rules: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in (rules or RULES).items()], "kind string, shape string, namespace string, edge_kind string")


def invalid_code() -> Column:
    """Why an observation is invalid, or null: required texts, version, confidence, line range."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    lines = (F.col("start_line").isNull() != F.col("end_line").isNull()) | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    code = F.when(blank("kind") | blank("source_id") | blank("path") | blank("extractor") | blank("extractor_version"), "blank_field")
    return code.when(F.coalesce("schema_version", F.lit(0)) != 1, "schema_version").when(~F.coalesce(F.col("confidence").isin("unknown", "heuristic", "extracted", "manual"), F.lit(False)), "confidence").when(lines, "line_range")


def validated(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid observations, diagnostics of the others)."""
    coded = observations.withColumn("_code", invalid_code())
    bad = coded.where("_code is not null").select(F.lit("error").alias("severity"), F.col("_code").alias("code"), "ordinal", "kind", F.col("path").alias("detail"))
    return coded.where("_code is null").drop("_code"), bad


def marked(observations: DataFrame) -> DataFrame:
    """Observations with canonical metadata, _code (why one is invalid) and _reason (why its claims are refused).

    Each row's metadata are read once: filters on what is made of them stay above that, and claims are looked for only in texts that can hold one.
    """
    out = observations.withColumn("_read", metadata_reader()(F.col("metadata")))
    reason = F.when(F.col("_read.suspect"), claim_reason(F.col("kind"), F.col("metadata"))).when(F.col("kind").isin(*RUST_KINDS), "rust_raw_kind")
    return out.withColumn("_code", invalid_code()).withColumn("_reason", reason).withColumn("metadata", F.col("_read.canonical")).drop("_read")


def metadata_reader():
    """A function of metadata texts: their canonical form, and whether they can hold a claim. Equal texts of a batch are read once."""
    suspect = re.compile("|".join(["\\\\", RECEIPT_PREFIX, *CLAIM_KEYS, "rust"]), re.IGNORECASE)  # a backslash can hide a name

    @F.pandas_udf("canonical string, suspect boolean")
    def reader(texts):
        code, different = pd.factorize(texts)  # -1: missing
        form = np.array([*[canonical_text(t) for t in different], "{}"], dtype=object)
        return pd.DataFrame({"canonical": form[code], "suspect": np.array([*[suspect.search(t) is not None for t in different], False])[code]})

    return reader.asNondeterministic()  # else filters would be pushed below it, with all that they are made of


def canonicalize(observations: DataFrame, rules: dict[str, tuple[str, str, str]] | None = None) -> Graph:
    """The graph of observations (the columns of schema.OBS, ordinals unique).

    A definition gives a node for the file (inferred) and one for the name (observed), and an edge between; a reference gives both
    nodes inferred, and an edge; a file gives its node. Unknown kinds give a warning and nothing else. Nodes keep the first metadata
    and the strongest confidence; edges fold metadata in order of ordinals. Claims that no witness bears out are refused with a warning.
    """
    routed = marked(observations).join(F.broadcast(rule_table(observations.sparkSession, rules)), "kind", "left")  # as many rows as kinds
    refused = F.col("_code").isNotNull() | F.col("_reason").isNotNull()
    known = routed.where(~refused & F.col("shape").isNotNull()).withColumn("evidence_key", evidence_key(F.col("ordinal"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("extractor"), F.col("source_id")))
    code = F.when(F.col("_code").isNotNull(), F.col("_code")).when(F.col("_reason").isNotNull(), "extractor_capability_claim_refused").otherwise("unsupported_observation")
    detail = F.when(F.col("_code").isNull() & F.col("_reason").isNotNull(), F.concat_ws(":", "_reason", "path")).otherwise(F.col("path"))
    bad = routed.where(refused | F.col("shape").isNull()).select(F.when(F.col("_code").isNotNull(), "error").otherwise("warning").alias("severity"), code.alias("code"), "ordinal", "kind", detail.alias("detail"))
    own = F.coalesce("name", "target", "path")
    target = (
        F.when(F.col("shape") == "file", file_key(F.col("path")))
        .when(F.col("shape") == "refer", F.when(F.col("target").rlike(r"^[a-z][a-z0-9_.]*:[^\s]+$") & ~F.col("target").contains("://"), F.col("target")).otherwise(F.concat_ws(":", F.lit("external"), escape_segment(F.coalesce("target", "name", F.lit("?"))))))
        .when(F.col("shape") == "define", F.concat_ws(":", F.col("namespace"), escape_segment(F.col("path")), escape_segment(own)))
    )
    keyed = known.withColumn("target_key", target).withColumn("source_key", F.when(F.col("shape").isin("define", "refer"), file_key(F.col("path"))))

    evidence = keyed.select(
        "run_id", F.lit(GRAPH_KEY_VERSION).alias("graph_key_version"), "evidence_key", F.col("ordinal").alias("raw_observation_ordinal"), F.col("schema_version").alias("raw_schema_version"), F.col("kind").alias("raw_kind"),
        F.col("source_id").alias("raw_source_id"), "path", "start_line", "end_line", "extractor", "extractor_version", "confidence", without_keys(F.col("metadata"), OMITTED).alias("metadata"),
    )
    empty = F.lit("{}")
    ends = keyed.where("shape <> 'raw'").select("ordinal", "evidence_key", F.explode(F.filter(F.array(
        F.struct(F.col("source_key").alias("key"), F.lit("inferred_from_edge").alias("link"), empty.alias("metadata"), F.col("confidence").alias("confidence")),
        F.struct(F.col("target_key").alias("key"), F.when(F.col("shape") == "refer", "inferred_from_edge").otherwise("observed").alias("link"), F.when(F.col("shape") == "refer", empty).otherwise(F.col("metadata")).alias("metadata"), F.col("confidence").alias("confidence")),
    ), lambda x: x["key"].isNotNull())).alias("e"))
    node_links = ends.select(F.col("e.key").alias("canonical_key"), "evidence_key", F.col("e.link").alias("link_kind")).distinct()
    proposals = ends.select(F.col("e.key").alias("canonical_key"), key_kind(F.col("e.key")).alias("kind"), key_display_name(F.col("e.key")).alias("display_name"), F.col("e.metadata").alias("metadata"), F.col("e.confidence").alias("confidence"), "ordinal")
    conflicts = file_conflicts(marked(observations.where("kind = 'file'")).where("_code is null and _reason is null"))  # files are chosen before metadata are read
    nodes = merge.upsert_nodes(proposals).join(conflicts.select("canonical_key", F.lit(True).alias("_c")), "canonical_key", "left")
    nodes = nodes.select(F.lit(GRAPH_KEY_VERSION).alias("graph_key_version"), "canonical_key", "kind", "display_name", "metadata", "confidence", F.coalesce("_c", F.lit(False)).alias("conflict"))

    between = keyed.where("source_key is not null").withColumn("identity_metadata", empty).withColumn("edge_key", edge_key(F.col("source_key"), F.col("edge_kind"), F.col("target_key"), F.col("identity_metadata")))
    edge_rows = between.select("edge_key", F.col("source_key").alias("source_canonical_key"), "edge_kind", F.col("target_key").alias("target_canonical_key"), "identity_metadata", "metadata", "confidence", "ordinal")
    edges = merge.upsert_edges(edge_rows).select(
        F.lit(GRAPH_KEY_VERSION).alias("graph_key_version"), "edge_key", "source_canonical_key", "edge_kind", "target_canonical_key", "identity_metadata", identity_hash(F.col("identity_metadata")).alias("identity_metadata_hash"), "metadata", "confidence", F.lit(False).alias("conflict"),
    )
    edge_links = between.select("edge_key", "evidence_key", F.lit("supports").alias("link_kind")).distinct()
    warned = conflicts.select(F.lit("warning").alias("severity"), F.lit("conflicting_evidence").alias("code"), F.lit(None).cast("bigint").alias("ordinal"), F.lit("file").alias("kind"), F.col("canonical_key").alias("detail"))
    return Graph(nodes, edges, evidence, node_links, edge_links, bad.union(warned))


def file_conflicts(observations: DataFrame) -> DataFrame:
    """Keys of files whose observations differ in a decisive value."""
    seen = observations.where("kind = 'file'").select("path", *[F.get_json_object("metadata", f"$.{n}").alias(n) for n in ("language", "content_hash", "executable", "generated")])
    differ = seen.groupBy("path").agg(*[(F.min(n) != F.max(n)).alias(n) for n in ("language", "content_hash", "executable", "generated")])
    hit = F.lit(False)
    for n in ("language", "content_hash", "executable", "generated"):
        hit = hit | F.coalesce(F.col(n), F.lit(False))
    return differ.where(hit).select(file_key(F.col("path")).alias("canonical_key"))


def without_keys(text: Column, names: tuple[str, ...]) -> Column:
    """A JSON object's text without some names, values kept as they stand."""

    @F.pandas_udf("string")
    def drop(texts):
        import json

        from ..functions.keys import canonical_json

        def one(t):
            v = json.loads(t)
            return canonical_json({k: x for k, x in v.items() if k not in names}) if isinstance(v, dict) else t

        return texts.map(one)

    held = F.lit(False)
    for n in names:
        held = held | text.contains(f'"{n}"')
    return F.when(held, drop(text)).otherwise(text)


def namespaced(observations: DataFrame, alias: str) -> DataFrame:
    """Observations of one source among several: paths and source ids stand under its alias."""
    return observations.withColumn("path", F.concat(F.lit(alias + "/"), F.col("path"))).withColumn("source_id", F.concat(F.lit(alias + "/"), F.col("source_id")))


def normalized_graph(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plain graph: one node and one piece of evidence per observation, an edge where it has a target; the last of equal keys stays."""
    key = F.concat_ws(":", "source_id", "kind", "path", F.coalesce("name", F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    o = observations.withColumn("stable_key", key)
    nodes = merge.last_wins(o.select("stable_key", "kind", "path", "name", "ordinal"), ["stable_key"], "ordinal")
    edges = merge.last_wins(o.where("target is not null").select("stable_key", "target", F.col("kind").alias("edge_kind"), "ordinal"), ["stable_key", "target"], "ordinal")
    return nodes, edges, o.select("stable_key", "path", "start_line", "end_line", "ordinal")


# Metadata names that only a witnessed capability may set, and kinds and names that claim a language.
CLAIM_KEYS = (
    "capability_vocabulary", "declared_capabilities", "admitted_capabilities", "exercised_capabilities", "achieved_capabilities", "effect_vector", "parent_witness", "capability_witness",
)
RECEIPT_PREFIX = "extractor_receipt"
RUST_KINDS = ("rust.parse", "rust.item", "rust.unsupported")
LANGUAGE_KEYS = ("language", "dialect", "language_dialect")
CONTENT_LANGUAGE_KINDS = ("markdown.code_fence", "html.document")


def claim_reason(kind: Column, metadata: Column) -> Column:
    """Why an observation is refused, or null: a reserved name in its metadata, a raw kind of Rust, or Rust as its language."""
    names = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    rust = F.lit(False)
    for name in LANGUAGE_KEYS:
        rust = rust | F.coalesce(F.lower(F.trim(F.get_json_object(metadata, f"$.{name}"))).rlike("^rust(?:$|[/.-])"), F.lit(False))
    return (
        F.when(F.exists(names, lambda n: n.startswith(RECEIPT_PREFIX)), "receipt_reference_metadata").when(F.arrays_overlap(names, F.array(*[F.lit(n) for n in CLAIM_KEYS])), "capability_claim_metadata")
        .when(kind.isin(*RUST_KINDS), "rust_raw_kind").when(~kind.isin(*CONTENT_LANGUAGE_KINDS) & rust, "rust_language_claim")
    )


def refused_claims(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations without claims that no witness bears out, warnings for the others, with the reason)."""
    marked = observations.withColumn("_reason", claim_reason(F.col("kind"), F.col("metadata")))
    bad = marked.where("_reason is not null").select(F.lit("warning").alias("severity"), F.lit("extractor_capability_claim_refused").alias("code"), "ordinal", "kind", F.concat_ws(":", "_reason", "path").alias("detail"))
    return marked.where("_reason is null").drop("_reason"), bad


def unknown_provenance(observations: DataFrame, captured: DataFrame) -> DataFrame:
    """Observations of files that no captured manifest (path) holds: must be empty."""
    return observations.join(captured.select("path").distinct(), "path", "left_anti")
