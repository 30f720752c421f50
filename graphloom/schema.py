"""Table schemas and closed vocabularies."""

from __future__ import annotations

OBS = (
    "run_id bigint, ordinal bigint, schema_version int, kind string, source_id string, path string, confidence string, extractor string, "
    "extractor_version string, start_line int, end_line int, name string, target string, metadata string"
)
FILE = "path string, language string, role string, content_hash string, executable boolean, generated boolean, confidence string"
NODE = "graph_key_version int, canonical_key string, kind string, display_name string, metadata string, confidence string, conflict boolean"
EDGE = (
    "graph_key_version int, edge_key string, source_canonical_key string, edge_kind string, target_canonical_key string, identity_metadata string, "
    "identity_metadata_hash string, metadata string, confidence string, conflict boolean"
)
EVIDENCE = (
    "run_id bigint, graph_key_version int, evidence_key string, raw_observation_ordinal bigint, raw_schema_version int, raw_kind string, raw_source_id string, "
    "path string, start_line int, end_line int, extractor string, extractor_version string, confidence string, metadata string"
)
NODE_EVIDENCE = "canonical_key string, evidence_key string, link_kind string"
EDGE_EVIDENCE = "edge_key string, evidence_key string, link_kind string"
DIAGNOSTIC = "severity string, code string, ordinal bigint, kind string, detail string"

GRAPH_KEY_VERSION = 1
SCHEMA_VERSION = 1
# Confidences from weak to strong, evidence link kinds, file roles.
CONFIDENCES = ("unknown", "heuristic", "extracted", "manual")
LINK_KINDS = ("observed", "inferred_from_edge", "supports")
ROLES = ("generated", "test", "documentation", "config", "source", "entrypoint", "script", "unknown")
