"""Context packets: items packed greedily into a budget of bytes that counts itself. Driver-side, over at most a page of items."""

from __future__ import annotations

from ..functions.keys import canonical_json

MIN_BUDGET, MAX_BUDGET, MAX_ITEMS, MAX_LOCATIONS = 4096, 65_536, 50, 5


def sized(packet: dict) -> int:
    """The packet's bytes as JSON with its own actual_bytes in it: the fixed point."""
    size = 0
    while True:
        packet["actual_bytes"] = size
        now = len(canonical_json(packet).encode())
        if now == size:
            return size
        size = now


def pack(items: list[dict], budget: int, header: dict | None = None, max_items: int = 20, max_locations: int = 3) -> dict:
    """A packet of the first items that fit, in order; the others are counted by reason. An item's locations are cut to max_locations."""
    if not MIN_BUDGET <= budget <= MAX_BUDGET or not 1 <= max_items <= MAX_ITEMS or not 1 <= max_locations <= MAX_LOCATIONS:
        raise ValueError("budget, items or locations out of range")
    packet: dict = {**(header or {}), "budget_bytes": budget, "items": [], "omissions": {"over_budget": 0, "over_items": 0, "locations": 0}, "truncated": False}
    if sized(packet) > budget:
        packet = {"budget_bytes": budget, "items": [], "omissions": packet["omissions"], "truncated": True}
    for item in items:
        if len(packet["items"]) == max_items:
            packet["omissions"]["over_items"] += 1
            continue
        places = item.get("locations", [])
        kept = {**item, "locations": places[:max_locations]} if "locations" in item else item
        packet["items"].append(kept)
        packet["omissions"]["locations"] += len(places) - len(places[:max_locations])
        if sized(packet) > budget:
            packet["items"].pop()
            packet["omissions"]["locations"] -= len(places) - len(places[:max_locations])
            packet["omissions"]["over_budget"] += 1
    packet["truncated"] = packet["truncated"] or any(packet["omissions"].values())
    while sized(packet) > budget and packet["items"]:  # the counts of omissions may have grown by a digit
        packet["items"].pop()
        packet["omissions"]["over_budget"] += 1
    return packet


def vector_status(entries: list[dict], binding: str, revision: int, snapshot: str) -> str:
    own = [e for e in entries if e["binding"] == binding]
    good = len(own) == 1 and own[0]["revision"] == revision and own[0]["snapshot"] == snapshot
    return "verified_vector" if good else "unbound_or_conflicting_vector"
