"""Admission policies as expressions: the first check that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats whose bodies may be projected.
TEXT_LANGUAGES = ("python", "markdown", "javascript", "ruby", "go", "rust", "shell", "bash", "zsh", "awk", "powershell", "nix", "terraform", "html", "css", "json", "jsonc", "toml", "yaml", "xml", "sql", "text", "latex", "csv", "tsv")


def binding_exclusion(graph_private: Column, binding_private: Column, retained: Column, role: Column) -> Column:
    """Why a binding's bodies stay out, or null: privacy of graph and binding, retention, roles of mail and feeds."""
    return F.when(graph_private, "graph_private").when(binding_private, "binding_private").when(~retained, "retention_denied").when(role == "email", "email_excluded").when(role == "feed", "feed_excluded")


def body_admission(language: Column, size: Column, artifact_private: Column, binding_reason: Column, max_bytes: int = 262_144) -> Column:
    """Why a file's body stays out, or `admitted`: mail, feed, the binding's reason, privacy, format, size."""
    return (
        F.when(language.isin("eml", "mbox"), "email_excluded").when(language == "feed", "feed_excluded").when(binding_reason.isNotNull(), binding_reason).when(artifact_private, "artifact_private")
        .when(~language.isin(*TEXT_LANGUAGES), "unsupported_format").when(size > max_bytes, "too_large").otherwise("admitted")
    )


def within_budget(size: Column, order: list[str], budget: int, partition: list[str]) -> Column:
    """Whether a file still fits a budget of bytes, counted in order within a partition (a binding, a folder)."""
    from pyspark.sql import Window

    return F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) <= budget
