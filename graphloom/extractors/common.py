"""What extractors share: an observation, and redaction of secret values."""

from __future__ import annotations

import re

SECRET_NAME = re.compile(r"(?i)(?:^|[_.\-])(?:password|passwd|pwd|secret|token|api[_-]?key|private[_-]?key|credential|auth)s?(?:$|[_.\-])")
SECRET_VALUE = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)")
CREDENTIALED_URL = re.compile(r"([a-z][a-z0-9+.\-]*://)[^/\s:@]+:[^/\s@]+@")


def obs(kind: str, path: str, line: int | None = None, name: str | None = None, target: str | None = None, confidence: str = "extracted", end: int | None = None, **metadata) -> dict:
    return {
        "kind": kind, "source_id": path, "path": path, "confidence": confidence, "extractor": kind.split(".")[0], "extractor_version": "1", "start_line": line, "end_line": end if end is not None else line,
        "name": name, "target": target, "metadata": {k: v for k, v in metadata.items() if v is not None},
    }


def secret_reason(name: str | None, value: str | None) -> str | None:
    """Why a named value is withheld, if it is."""
    if name and SECRET_NAME.search(name):
        return "secret_name"
    if value and SECRET_VALUE.search(value):
        return "secret_value"
    if value and CREDENTIALED_URL.search(value):
        return "credentialed_url"
    return None


def safe_value(name: str | None, value: str) -> tuple[str, str | None]:
    """The whole value, or a mark in its place where it is secret, and why."""
    reason = secret_reason(name, value)
    return ("[redacted]" if reason else value, reason)


def redact(value, key: str | None = None):
    """A JSON value with secrets withheld, at any depth."""
    if isinstance(value, dict):
        return {k: redact(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, key) for v in value]
    if key and SECRET_NAME.search(key) and value is not None:
        return "[redacted]"
    if isinstance(value, str):
        return "[redacted]" if SECRET_VALUE.search(value) else CREDENTIALED_URL.sub(r"\1[redacted]@", value)
    return value


def sanitize(value, private_markers: tuple[str, ...] = (), cap: int = 4096, depth: int = 0):
    """A value for egress: secrets and private path markers withheld, long texts and deep values cut short."""
    if depth > 16:
        return "[truncated]"
    value = redact(value) if depth == 0 else value
    if isinstance(value, dict):
        return {str(k): sanitize(v, private_markers, cap, depth + 1) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [sanitize(v, private_markers, cap, depth + 1) for v in value]
    if isinstance(value, str):
        for m in private_markers:
            value = value.replace(m, "[private]")
        return value if len(value) <= cap else value[:cap] + "[truncated]"
    return value
