"""Reads of ingested sources: observations fan out through evidence and links to feed items and their references.

Source observations have run_id, ordinal, source_id, source_run_id, artifact_id, artifact_path, source_type, policy_status, acquired_at.
Evidence has run_id and raw_observation_ordinal of the observation behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summary import flag, meta

POLICY = "full feed bodies are not exposed"


def selected(observations: DataFrame, source_id: str | None = None, source_run_id: str | None = None) -> DataFrame:
    for column, value in (("source_id", source_id), ("source_run_id", source_run_id)):
        observations = observations if value is None else observations.where(F.col(column) == value)
    return observations


def fan_out(observations: DataFrame, evidence: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Each observation with the evidence made from it and the keys that this supports; one without any stays, with nulls."""
    ev = evidence.select("run_id", F.col("raw_observation_ordinal").alias("ordinal"), "evidence_key")
    return observations.join(ev, ["run_id", "ordinal"], "left").join(links.select("evidence_key", key, "link_kind"), "evidence_key", "left")


def source_feed_items(observations: DataFrame, evidence: DataFrame, node_links: DataFrame, nodes: DataFrame, edges: DataFrame, source_id: str, limit: int, source_run_id: str | None = None) -> DataFrame:
    """The newest items of a source (limit is the feature; undated items last) with their links, authors and categories and the greatest run and artifact."""
    group = selected(observations, source_id, source_run_id)
    seen = fan_out(group, evidence, node_links, "canonical_key").where("canonical_key IS NOT NULL").groupBy("canonical_key").agg(*[F.max(c).alias(c) for c in ("source_run_id", "artifact_id", "artifact_path")])
    fields = [meta(c).alias(c) for c in ("title", "published_at", "updated_at", "identity_source", "identity_strength")]
    items = nodes.where("kind = 'feed.item'").select("canonical_key", *fields, flag(meta("duplicate_identity")).alias("duplicate_identity")).join(seen, "canonical_key")
    order = [F.desc_nulls_last("published_at"), F.col("canonical_key")]
    page = items.orderBy(*order).limit(limit)
    target = nodes.select(F.col("canonical_key").alias("target_canonical_key"), F.col("kind").alias("_kind"), F.col("display_name").alias("_name"))
    refs = edges.where("edge_kind = 'references'").join(page.select(F.col("canonical_key").alias("source_canonical_key")), "source_canonical_key", "left_semi").join(target, "target_canonical_key", "left")
    gathered = {"link_targets": F.when(meta("scope").isin("link", "enclosure"), F.col("target_canonical_key")), "authors": F.when(F.col("_kind") == "feed.author", F.col("_name")), "categories": F.when(F.col("_kind") == "feed.category", F.col("_name"))}
    sets = refs.groupBy(F.col("source_canonical_key").alias("canonical_key")).agg(*[F.sort_array(F.collect_set(c)).alias(n) for n, c in gathered.items()])
    out = page.join(sets, "canonical_key", "left")
    return out.select(*page.columns, *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in gathered]).orderBy(*order)


def source_references(observations: DataFrame, evidence: DataFrame, edge_links: DataFrame, edges: DataFrame, source_id: str, limit: int | None = None, source_run_id: str | None = None, target_kind: str | None = None) -> DataFrame:
    """What a source's feed items refer to, a row for each observation and link behind an edge, by item, target and observation."""
    e = edges.where((F.col("edge_kind") == "references") & F.col("source_canonical_key").startswith("feed.item:"))
    e = e if target_kind is None else e.where(F.col("target_canonical_key").startswith(target_kind + ":"))
    e = e.select("edge_key", "source_canonical_key", "target_canonical_key", meta("raw_target_summary").alias("target_display"), F.coalesce(flag(meta("not_fetched")), F.lit(False)).alias("not_fetched"), meta("mime_type").alias("media_type"))
    out = fan_out(selected(observations, source_id, source_run_id), evidence, edge_links, "edge_key").join(e, "edge_key")
    out = out.orderBy("source_canonical_key", "target_canonical_key", "edge_key", "run_id", "ordinal", "link_kind")
    out = out if limit is None else out.limit(limit)
    return out.select(F.col("source_canonical_key").alias("source_item_key"), F.col("target_canonical_key").alias("target_key"), "target_display", "not_fetched", "media_type", "source_run_id", "artifact_id", "artifact_path", "ordinal", "link_kind")


def item_evidence(observations: DataFrame, evidence: DataFrame, node_links: DataFrame, item_key: str, source_id: str | None = None) -> DataFrame:
    """The evidence of an item that comes of observations of the sources asked for, by ordinal, run and key."""
    own = evidence.join(node_links.where(F.col("canonical_key") == item_key).select("evidence_key", "link_kind"), "evidence_key")
    asked = selected(observations, source_id).select("run_id", F.col("ordinal").alias("raw_observation_ordinal"))
    return own.join(asked, ["run_id", "raw_observation_ordinal"], "left_semi").orderBy("raw_observation_ordinal", "run_id", "evidence_key", "link_kind")


def item_source(observations: DataFrame, source_id: str | None = None) -> DataFrame:
    """The source with the newest acquisition among those asked for (undated ones last, then by id): one row at most."""
    least, greatest = ("source_type", "policy_status"), ("source_run_id", "artifact_id", "artifact_path", "acquired_at")
    out = selected(observations, source_id).where("source_id IS NOT NULL").groupBy("source_id").agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest])
    return out.orderBy(F.desc_nulls_last("acquired_at"), "source_id").limit(1)


def explain_item(observations: DataFrame, evidence: DataFrame, node_links: DataFrame, nodes: DataFrame, edges: DataFrame, item_key: str, source_id: str | None = None) -> dict[str, DataFrame | str]:
    """An item with its source, evidence and references; the item's row shows only if evidence of the sources asked for supports it."""
    ev = item_evidence(observations, evidence, node_links, item_key, source_id)
    item = nodes.where(F.col("canonical_key") == item_key).join(ev.limit(1).select(F.lit(item_key).alias("canonical_key")), "canonical_key", "left_semi")
    refs = edges.where((F.col("source_canonical_key") == item_key) & (F.col("edge_kind") == "references")).select("target_canonical_key", "metadata").orderBy("target_canonical_key", "metadata")
    return {"item": item, "source": item_source(observations, source_id), "evidence": ev, "references": refs, "content_policy": POLICY}
