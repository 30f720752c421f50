"""Streaming: coalesced refresh intents, idempotent publication of batches, windowed counts."""

from .intents import coalesce_intents, intent_step
from .windows import publish_batches, session_counts, windowed_counts

__all__ = ["coalesce_intents", "intent_step", "publish_batches", "session_counts", "windowed_counts"]
