"""Static extractors as table functions: (path, content) to observations. Nothing is executed."""

from .registry import EXTRACTORS, extract, extract_file

__all__ = ["EXTRACTORS", "extract", "extract_file"]
