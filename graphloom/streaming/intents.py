"""Refresh intents of a graph, coalesced: at most one queued and one running, however many hints come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def intent_step(state: dict, event: dict) -> tuple[dict, str]:
    """The next state of a graph and what became of an event.

    state: queued, running, done: each the four generations of a job (a list) or None; queued_manual. event: type hint, manual, start
    or finish, with generations for the first two. A hint equal to what is queued, or to what runs or was done last with nothing queued,
    is `unchanged`; one beside a running job is its `follow_up`; one beside a queued job has `replaced` it, but a manual job stays (`kept_manual`).
    """
    s = {"queued": None, "queued_manual": False, "running": None, "done": None, **state}
    kind, g = event["type"], event.get("generations")
    if kind == "start":
        if s["queued"] is None or s["running"] is not None:
            return s, "refused"
        return {**s, "running": s["queued"], "queued": None, "queued_manual": False}, "started"
    if kind == "finish":
        return ({**s, "done": s["running"], "running": None}, "finished") if s["running"] is not None else (s, "refused")
    if kind == "manual":
        return {**s, "queued": g, "queued_manual": True}, "queued_manual"
    if s["queued"] is not None:
        if s["queued_manual"]:
            return s, "kept_manual"
        return (s, "unchanged") if s["queued"] == g else ({**s, "queued": g}, "replaced")
    if (s["running"] if s["running"] is not None else s["done"]) == g:
        return s, "unchanged"
    return {**s, "queued": g}, "follow_up" if s["running"] is not None else "queued"


def coalesce_intents(events: DataFrame):
    """Outcomes of a stream of events (graph_id, seq, type, generations array<string>): graph_id, seq, outcome; state is kept per graph."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):
        import pandas as pd

        now = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("seq").to_dict("records"):
                g = None if r["generations"] is None else [str(x) for x in r["generations"]]
                now, outcome = intent_step(now, {"type": r["type"], "generations": g})
                rows.append((key[0], r["seq"], outcome))
        state.update((json.dumps(now),))
        yield pd.DataFrame(rows, columns=["graph_id", "seq", "outcome"])

    return events.groupBy("graph_id").applyInPandasWithState(run, "graph_id string, seq bigint, outcome string", "state string", "append", GroupStateTimeout.NoTimeout)
