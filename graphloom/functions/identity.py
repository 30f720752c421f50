"""Identities: prefixed digests of canonical JSON for bindings, configurations, policies, profiles, snapshots and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import canonical_json, digest_of


def binding_id(graph_id: str, alias: str) -> str:
    return digest_of("bind1", {"alias": alias, "graph_id": graph_id})


def source_id(definition: dict) -> str:
    return digest_of("source1", definition)


def configuration_id(graph_id: str, bindings: list[dict]) -> str:
    """Independent of the order of bindings."""
    return digest_of("config1", {"bindings": sorted(bindings, key=canonical_json), "graph_id": graph_id})


def selection_policy_id(include: list[str], exclude: list[str]) -> str:
    return digest_of("select1", {"exclude": sorted(set(exclude)), "include": sorted(set(include))})


def profile_id(profile: dict) -> str:
    return digest_of("profile1", profile)


def generations(config: dict, extractors: dict[str, str], canonicalizer: str) -> dict[str, str]:
    """The generation tokens beside the source's: configuration, extractors and their versions, canonicalizer."""
    return {"config": digest_of("cg1", config), "extractor": digest_of("eg1", extractors), "canonicalizer": digest_of("kg1", canonicalizer)}


def is_current(expected: dict[str, str], actual: dict[str, str]) -> bool:
    names = ("source", "config", "extractor", "canonicalizer")
    return all(expected.get(n) is not None and expected.get(n) == actual.get(n) for n in names)


def snapshot_id(manifest: DataFrame) -> str:
    """A digest of a manifest (path, size, content_hash) by sums of row hashes: independent of order, one row to the driver."""
    from ..operators.merge import family_checksum

    got = family_checksum(manifest, F.col("path"), F.concat_ws(":", F.col("size").cast("string"), F.col("content_hash")))
    return digest_of("snap1", got)


def deterministic_run_id(config: dict, included: DataFrame) -> str:
    """The same for the same configuration and included files."""
    from ..operators.merge import family_checksum

    return digest_of("run1", {"config": config, "files": family_checksum(included, F.col("path"), F.col("length").cast("string"))})
