"""Read operators over the graph tables: listings, searches, neighborhoods, explanations, locations, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import under
from ..functions.keys import file_key


#: Edge keys and links of one explanation that the driver hands on; beyond these, tables are joined.
MAX_KEYS, MAX_LINKS = 1000, 50_000


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A window of an ordered listing; an offset needs a limit."""
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit")
        return df
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are not negative")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def read_page(df: DataFrame, limit: int, offset: int = 0) -> dict[str, object]:
    """Rows of a page, whether more follow (from one row beyond it), and the lower bound of the total."""
    rows = [r.asDict(recursive=True) for r in page(df, limit + 1, offset).collect()]  # a page is what the caller asks for
    return {"records": rows[:limit], "has_more": len(rows) > limit, "limit": limit, "offset": offset, "total": offset + min(len(rows), limit)}


def matches(query: str, *columns: Column) -> Column:
    """Any column holds the query, letters of any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(query))), F.lit(False))
    return out


def escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def nodes(df: DataFrame, kind: str | None = None, canonical_key: str | None = None, path_prefix: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    if canonical_key is not None:
        df = df.where(F.col("canonical_key") == canonical_key)
    if path_prefix not in (None, "", "."):
        p = path_prefix.strip("/")
        df = df.where((F.col("canonical_key") == f"file:{p}") | F.col("canonical_key").startswith(f"file:{p}/"))
    return page(df.orderBy("canonical_key"), limit, offset)


def edges(df: DataFrame, kind: str | None = None, source_key: str | None = None, target_key: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    for column, value in (("edge_kind", kind), ("source_canonical_key", source_key), ("target_canonical_key", target_key)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return page(df.orderBy("source_canonical_key", "edge_kind", "target_canonical_key", "identity_metadata_hash"), limit, offset)


def search_nodes(df: DataFrame, query: str, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.where(matches(query, F.col("canonical_key"), F.col("kind"), F.col("display_name")))
    return nodes(df, kind=kind, limit=limit, offset=offset)


def search_files(df: DataFrame, query: str, path: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.where(matches(query, F.col("path"), F.col("language"), F.col("role")))
    return page((df if path is None else df.where(under(F.col("path"), path))).orderBy("path"), limit, offset)


def search_observations(df: DataFrame, query: str, kind: str | None = None, path: str | None = None, payload: str = "metadata", limit: int | None = None, offset: int = 0, include_raw: bool = False) -> DataFrame:
    df = df.where(matches(query, F.col("kind"), F.col("source_id"), F.col("path"), F.col(payload)))
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    if path is not None:
        df = df.where(under(F.col("path"), path))
    df = df if include_raw else df.drop(payload)
    return page(df.orderBy(F.desc("run_id"), "ordinal"), limit, offset)


def incident(edge: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges at a node, a loop once: two filters, each pushed to the scan, and a distinct union."""
    if direction not in ("both", "incoming", "outgoing"):
        raise ValueError(f"unknown direction {direction!r}")
    out, into = edge.where(F.col("source_canonical_key") == node), edge.where(F.col("target_canonical_key") == node)
    return out if direction == "outgoing" else into if direction == "incoming" else out.union(into).distinct()


def neighborhood(node_table: DataFrame, edge_table: DataFrame, node: str, direction: str = "both", depth: int = 1, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(neighbours, edges) one step around a node; the node itself isn't its neighbour. Only depth 1 exists."""
    if depth != 1:
        raise ValueError("only depth 1 is supported")
    e = incident(edge_table if kinds is None else edge_table.where(F.col("edge_kind").isin(*kinds)), node, direction)
    keys = e.select(F.explode(F.array("source_canonical_key", "target_canonical_key")).alias("canonical_key")).where(F.col("canonical_key") != node).distinct()
    return node_table.join(keys, "canonical_key", "left_semi").orderBy("canonical_key"), e.orderBy("source_canonical_key", "edge_kind", "target_canonical_key", "identity_metadata_hash")


def expand_seeds(node_table: DataFrame, edge_table: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, per_seed: int = 64) -> DataFrame:
    """Edges at each seed with the neighbour's node, at most per_seed each (the feature's limit), a loop in both directions.

    The kinds, where given in order of priority, filter before the limit.
    """
    e = edge_table if kinds is None else edge_table.where(F.col("edge_kind").isin(*kinds))
    prio = F.lit(0) if kinds is None else F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("edge_kind"))
    side = lambda own, other, name: e.join(seeds.select(F.col("canonical_key").alias("seed")), F.col(own) == F.col("seed")).select("seed", F.lit(name).alias("direction"), F.col(other).alias("neighbor"), "edge_kind", "edge_key")
    both = side("source_canonical_key", "target_canonical_key", "outgoing").union(side("target_canonical_key", "source_canonical_key", "incoming"))
    named = both.join(node_table.select(F.col("canonical_key").alias("neighbor"), F.col("kind").alias("neighbor_kind"), F.col("display_name").alias("neighbor_name")), "neighbor")
    w = Window.partitionBy("seed").orderBy(prio, "edge_kind", "direction", "neighbor", "edge_key")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_seed)


def explain_edge(edge_table: DataFrame, edge_links: DataFrame, evidence: DataFrame, observations: DataFrame, source_key: str, kind: str, target_key: str, identity_hash: str | None = None) -> DataFrame:
    """An edge's evidence with the raw observations behind it, where these are kept."""
    e = edge_table.where((F.col("source_canonical_key") == source_key) & (F.col("edge_kind") == kind) & (F.col("target_canonical_key") == target_key))
    if identity_hash is not None:
        e = e.where(F.col("identity_metadata_hash") == identity_hash)
    keys = [r[0] for r in e.select("edge_key").distinct().limit(MAX_KEYS + 1).collect()]  # one for each identity
    few = len(keys) <= MAX_KEYS
    links = edge_links.where(F.col("edge_key").isin(*keys)) if few else edge_links.join(e.select("edge_key"), "edge_key", "left_semi")  # a filter on the key reaches below links' own aggregate
    held = links.limit(MAX_LINKS + 1).collect() if few else []
    few = few and len(held) <= MAX_LINKS  # few links are sent to evidence and observations, which then stay where they are
    near = F.broadcast if few else (lambda df: df)
    links = edge_links.sparkSession.createDataFrame(held, edge_links.schema) if few else links
    ev = evidence.join(near(links), "evidence_key")
    raw = observations.select(F.col("run_id").alias("_run"), F.col("ordinal").alias("_ordinal"), F.col("kind").alias("_kind"), F.col("metadata").alias("raw_metadata"))
    seen = raw.join(near(ev.select(F.col("run_id").alias("_run"), F.col("raw_observation_ordinal").alias("_ordinal"))), ["_run", "_ordinal"], "left_semi") if few else raw
    out = ev.join(near(seen), (F.col("run_id") == F.col("_run")) & (F.col("raw_observation_ordinal") == F.col("_ordinal")), "left")
    return out.select("edge_key", "evidence_key", "link_kind", F.coalesce("_kind", "raw_kind").alias("raw_kind"), "path", "start_line", "end_line", "extractor", "confidence", "raw_metadata").orderBy("evidence_key")


def overlaps(spans: DataFrame, evidence: DataFrame, keys: list[str], bin_lines: int = 64) -> DataFrame:
    """Evidence whose lines overlap each span: spans(keys, start_line, end_line, ...) with evidence(keys, ev_start, ev_end, ...).

    An equality join on the keys and on bins of lines, so that a file of very many spans spreads; each pair shows once, in its first common bin.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_lines), F.floor(F.col(b) / bin_lines)))
    left, right = spans.withColumn("_bin", bins("start_line", "end_line")), evidence.withColumn("_bin", bins("ev_start", "ev_end"))
    both = left.join(right, [*keys, "_bin"]).where("start_line <= ev_end and end_line >= ev_start")
    return both.where(F.col("_bin") == F.floor(F.greatest("start_line", "ev_start") / bin_lines)).drop("_bin")


def first_overlap(spans: DataFrame, evidence: DataFrame, keys: list[str], span_id: list[str]) -> DataFrame:
    """Each span with its first overlapping evidence by (start, end, key), or nulls: a lateral top 1."""
    found = overlaps(spans, evidence, keys)
    best = found.groupBy(*span_id).agg(F.min(F.struct("ev_start", "ev_end", "evidence_key")).alias("_b"))
    return spans.join(best, span_id, "left").select(*spans.columns, F.col("_b.evidence_key").alias("evidence_key"), F.col("_b.ev_start").alias("ev_start"), F.col("_b.ev_end").alias("ev_end"))


def node_locations(node_links: DataFrame, evidence: DataFrame, accepted_run: int, role: Column | None = None) -> DataFrame:
    """Each node's places: from the accepted run if it has any link there, else from its latest run; the run is chosen before roles filter."""
    at = node_links.join(evidence, "evidence_key")
    chosen = at.groupBy("canonical_key").agg(F.coalesce(F.max(F.when(F.col("run_id") == accepted_run, F.col("run_id"))), F.max("run_id")).alias("_run"))
    out = at.join(chosen, "canonical_key").where("run_id = _run").drop("_run")
    out = out if role is None else out.where(role)
    return out.withColumn("relation", F.when(F.col("run_id") == accepted_run, "current").otherwise("historical"))


def admitted_nodes(node_table: DataFrame, node_links: DataFrame, evidence: DataFrame, accepted_run: int, role: Column, admitted: Column) -> DataFrame:
    """Nodes with evidence of a direct role that is admitted, in the run that node_locations chooses from all their links: a semi join after two aggregates."""
    held = node_locations(node_links, evidence, accepted_run, (role == "direct") & admitted).select("canonical_key")
    return node_table.join(held, "canonical_key", "left_semi")


def grouped(candidates: DataFrame, destination: list[str], order: list[str], groups: int, members: int, skip: int = 0) -> DataFrame:
    """Candidates grouped by destination in the order of each group's first member: a page of groups, each with its first members (the feature's limits)."""
    w = Window.partitionBy(*destination)
    ranked = candidates.withColumn("_first", F.min(F.struct(*order)).over(w)).withColumn("_member", F.row_number().over(w.orderBy(*order)))
    heads = ranked.where("_member = 1").orderBy("_first", *destination).offset(skip).limit(groups).select(*destination)
    return ranked.join(heads, destination, "left_semi").where(F.col("_member") <= members).orderBy("_first", "_member").drop("_first").withColumnRenamed("_member", "member")


def file_listing(file_table: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files with the number of their pieces of evidence and the sorted extractors and kinds of these."""
    stats = evidence.groupBy("path").agg(F.count(F.lit(1)).alias("n_evidence"), F.sort_array(F.collect_set("extractor")).alias("extractors"), F.sort_array(F.collect_set("raw_kind")).alias("kinds"))
    return file_table.join(stats, "path", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).withColumn("canonical_key", file_key(F.col("path"))).orderBy("path")
