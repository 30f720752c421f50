"""Sources and sinks: repositories, observations, archives, web archives, feeds, APIs and memory files."""

from .archives import bulk_files, read_warc
from .observations import read_observations, write_observations
from .repository import discover, file_hashes, source_generation
from .services import api_observations, feed_items, github_observations, memory_entries

__all__ = ["api_observations", "bulk_files", "discover", "feed_items", "file_hashes", "github_observations", "memory_entries", "read_observations", "read_warc", "source_generation", "write_observations"]
