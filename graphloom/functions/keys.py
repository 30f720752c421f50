"""Canonical keys, identity hashes and framed digests, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import CONFIDENCES, GRAPH_KEY_VERSION


def escape_segment(c: Column) -> Column:
    """A key's segment: % and : are percent-encoded, so keys split at : without loss."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def unescape_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def node_key(namespace: str, *segments: Column) -> Column:
    return F.concat_ws(":", F.lit(namespace), *[escape_segment(s.cast("string")) for s in segments])


def file_key(path: Column) -> Column:
    return node_key("file", path)


def key_kind(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def key_display_name(key: Column) -> Column:
    return unescape_segment(F.substring_index(key, ":", -1))


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCES]), c)


def canonical_json(value) -> str:
    """JSON text with sorted keys at every depth and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_text(text: str | None) -> str:
    """Canonical form of a JSON text; null and malformed texts read as an empty object."""
    try:
        return canonical_json(json.loads(text)) if text else "{}"
    except ValueError:
        return "{}"


@F.pandas_udf(StringType())
def canonical_json_text(text):
    """canonical_text of JSON texts."""
    return text.map(canonical_text)


def identity_hash(identity_json: Column) -> Column:
    """sha256 of the identity's canonical JSON text."""
    return F.sha2(identity_json.cast("binary"), 256)


def edge_key(source: Column, kind: Column, target: Column, identity_json: Column, version: int = GRAPH_KEY_VERSION) -> Column:
    """canonical-edge: and sha256 of JSON with sorted names: identity_metadata, kind, source, target, version."""
    quoted = lambda c: F.replace(F.replace(F.to_json(F.struct(c.alias("v"))), F.lit('{"v":'), F.lit("")), F.lit('"}'), F.lit('"'))
    text = F.concat(F.lit('{"identity_metadata":'), identity_json, F.lit(',"kind":'), quoted(kind), F.lit(',"source":'), quoted(source), F.lit(',"target":'), quoted(target), F.lit(f',"version":{version}}}'))
    return F.concat(F.lit("canonical-edge:"), F.sha2(text.cast("binary"), 256))


def evidence_key(ordinal: Column, path: Column, start: Column, end: Column, extractor: Column, source_id: Column) -> Column:
    span = F.concat(F.coalesce(start.cast("string"), F.lit("")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))
    return F.concat_ws(":", F.lit("evidence"), ordinal.cast("string"), path, span, extractor, source_id)


def framed_digest(prefix: str, *parts: Column) -> Column:
    """prefix: and sha256 over the number of parts and each part behind its length in bytes."""
    framed = [F.concat(F.octet_length(p.cast("binary")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";")) for p in parts]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat(F.lit(f"frame:{len(parts)}:"), *framed).cast("binary"), 256))


def digest_of(prefix: str, value) -> str:
    """prefix: and sha256 of a Python value's canonical JSON."""
    return f"{prefix}:{hashlib.sha256(canonical_json(value).encode()).hexdigest()}"
