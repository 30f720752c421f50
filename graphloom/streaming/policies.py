"""Decisions around a publication: retries, what a marker means, when progress is worth writing."""

from __future__ import annotations

import random


def retry_delay(category: str, state: str, attempt: int, most: int = 5, base: float = 1.0, cap: float = 60.0, rng: random.Random | None = None) -> float | None:
    """Seconds to wait before another attempt, drawn below min(cap, base * 2^(attempt - 1)); None where there is to be none."""
    if category not in ("transient", "timeout", "worker_lost") or state not in ("none", "staged") or attempt >= most:
        return None
    return (rng or random).uniform(0, min(cap, base * 2 ** (attempt - 1)))


def reconcile(state: str, marker: bool | None, cancelled: bool) -> str:
    """What to do with a job whose publication may have happened: a marker proves it, its absence allows another try."""
    if marker:
        return "complete"
    if state == "none":
        return "cancel" if cancelled else "retry"
    if marker is None:
        return "inspect"
    return "cancel" if cancelled else "retry"


def worth_saving(previous: tuple[float, int] | None, now: tuple[float, int], interval: float = 5.0, delta: int = 100) -> bool:
    """Whether progress (time, count) differs enough from what was saved last."""
    return previous is None or (now[0] - previous[0] >= interval and now[1] != previous[1]) or now[1] - previous[1] >= delta
