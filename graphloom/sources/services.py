"""Feeds, REST and GitHub payloads, and memory files, once they are stored; nothing is fetched here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extractors.common import obs, redact
from ..functions.keys import canonical_json


def feed_items(observations: DataFrame) -> DataFrame:
    """Feed items with their links, authors, categories and enclosures as sorted arrays, newest first."""
    items = observations.where("kind = 'feed.item'").select("source_id", F.col("name").alias("item"), F.get_json_object("metadata", "$.title").alias("title"), F.get_json_object("metadata", "$.published_at").alias("published_at"))
    sets = [F.sort_array(F.collect_set(F.when(F.col("kind") == f"feed.{k}", F.col("target")))).alias(a) for k, a in (("link", "links"), ("author", "authors"), ("category", "categories"), ("enclosure", "enclosures"))]
    refs = observations.where(F.col("kind").isin("feed.link", "feed.author", "feed.category", "feed.enclosure")).groupBy("source_id", F.col("name").alias("item")).agg(*sets)
    return items.join(refs, ["source_id", "item"], "left").orderBy(F.desc_nulls_last("published_at"), "source_id", "item")


def _rows(raw: DataFrame, make) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(o["path"], k, o["kind"], o["source_id"], o["confidence"], o["extractor"], o["extractor_version"], o["name"], o["target"], canonical_json(o["metadata"])) for p, t in zip(pdf["path"], pdf["text"], strict=True) for k, o in enumerate(make(p, t))]
            yield pd.DataFrame(rows, columns=["path", "place", "kind", "source_id", "confidence", "extractor", "extractor_version", "name", "target", "metadata"])

    return raw.select("path", "text").mapInPandas(run, "path string, place int, kind string, source_id string, confidence string, extractor string, extractor_version string, name string, target string, metadata string")


def api_observations(responses: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Provenance of stored API responses (path = endpoint, text = JSON) of allowed endpoints, secrets withheld; a refusal for any other."""

    def make(path: str, text: str) -> list[dict]:
        if path not in allowed:
            return [obs("api.refused_endpoint", path, name=path)]
        try:
            value = redact(json.loads(text))
        except ValueError:
            return [obs("api.parse_error", path, name=path)]
        rows = value if isinstance(value, list) else [value]
        return [obs("api.response", path, name=path, records=len(rows))] + [obs("api.record", path, name=str(r.get("id", k)) if isinstance(r, dict) else str(k), fields=sorted(r) if isinstance(r, dict) else []) for k, r in enumerate(rows)]

    return _rows(responses, make)


def github_observations(payloads: DataFrame) -> DataFrame:
    """Repositories, issues, pull requests, releases and workflows of stored payloads (path = record type, text = JSON)."""
    kinds = {"repository": ("github.repository", "full_name"), "issue": ("github.issue", "number"), "pull_request": ("github.pull_request", "number"), "release": ("github.release", "tag_name"), "workflow": ("github.workflow", "path")}

    def make(path: str, text: str) -> list[dict]:
        kind, key = kinds.get(path.split("/")[0], (None, None))
        if kind is None:
            return []
        value = redact(json.loads(text))
        return [obs(kind, path, name=str(r.get(key)), state=r.get("state"), title=r.get("title") or r.get("name"), author=(r.get("user") or {}).get("login"), labels=sorted(x.get("name", "") for x in r.get("labels", []))) for r in (value if isinstance(value, list) else [value])]

    return _rows(payloads, make)


def memory_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a memory file (JSON lines of entities and relations): type, name, text, redacted; malformed lines are entries of that type."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    j = lambda n: F.get_json_object("value", f"$.{n}")
    kind = F.when(F.try_parse_json("value").isNull(), "malformed").when(j("type") == "entity", "entity").when(j("type") == "relation", "relation").otherwise("unknown")
    text = F.when(kind == "relation", F.concat_ws(" ", j("from"), j("relationType"), j("to"))).otherwise(F.array_join(F.from_json(j("observations"), "array<string>"), "\n"))
    secret = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|(?i:(?:password|token|secret|api[_-]?key)\s*[=:]\s*\S+)"
    out = lines.select(kind.alias("type"), F.coalesce(j("name"), j("from")).alias("name"), j("entityType").alias("entity_type"), text.alias("raw"))
    return out.select("type", "name", "entity_type", F.regexp_replace("raw", secret, "[redacted]").alias("text"), F.coalesce(F.col("raw").rlike(secret), F.lit(False)).alias("redacted"))


def memory_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("type") == t).alias(t + "s") for t in ("entity", "relation", "unknown")], F.count_if(F.col("type") == "malformed").alias("malformed"),
        F.count_if("redacted").alias("redacted"), F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(https?://\S+)")))), F.lit(0)).alias("urls"), F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"((?:^|\s)/[\w./-]+)")))), F.lit(0)).alias("paths"),
    )
