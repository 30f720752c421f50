"""Command line: discover, files, entrypoints, host-mutators, build, nodes, edges, search, neighborhood, summary, context."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .session import GraphSession
from .sources import discover
from .sources.repository import filtered
from .sources.tables import format_table


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("discover", "files", "entrypoints"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--role")
        c.add_argument("--language")
        c.add_argument("--generated", default="include")
    c = sub.add_parser("build")
    c.add_argument("root")
    c.add_argument("folder")
    c.add_argument("--run", type=int, default=1)
    for name in ("nodes", "edges", "host-mutators", "summary", "status"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--limit", type=int, default=100)
        c.add_argument("--kind")
        c.add_argument("--family", default="python")
    for name in ("search", "neighborhood", "context"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("query")
        c.add_argument("--intent")
        c.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command in ("discover", "files", "entrypoints"):
        files = filtered(discover(spark, a.root, tuple(a.exclude)), "entrypoint" if a.command == "entrypoints" else a.role, a.language, a.generated)
        columns = ["path", "language", "role", "executable", "generated"]
        return format_table([r.asDict() for r in files.select(*columns).orderBy("path").collect()], columns)
    if a.command == "build":
        return json.dumps(GraphSession.build(spark, a.root, a.folder, a.run).status().first().asDict())
    g = GraphSession(spark, a.folder)
    if a.command == "neighborhood":
        return json.dumps(g.neighborhood(a.query, node_limit=a.limit, edge_limit=a.limit))
    if a.command == "context":
        return json.dumps(g.context_packet(a.query, a.intent, max_items=min(50, a.limit)))
    df = {
        "nodes": lambda: g.canonical_nodes(kind=a.kind, limit=a.limit).select("canonical_key", "kind", "display_name"), "edges": lambda: g.canonical_edges(kind=a.kind, limit=a.limit).select("source_canonical_key", "edge_kind", "target_canonical_key"),
        "host-mutators": lambda: g.host_mutators().limit(a.limit), "summary": lambda: getattr(g, f"{a.family}_summary")(), "status": g.status, "search": lambda: g.navigation_search(a.query, a.intent).limit(a.limit).select("rank", "canonical_key", "kind", "match_class"),
    }[a.command]()
    return format_table([r.asDict() for r in df.collect()], df.columns)


if __name__ == "__main__":
    print(main())
