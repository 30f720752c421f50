"""Registered queries of the graph engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, keys, rank, text
from ..operators import canonical, lexical, merge, ranking, read as ops, similar, summary
from . import tables
from .tables import ENDINGS, EVENT_KINDS, TOOLS, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NODES = " UNION ALL ".join(f"SELECT '{t}:' || {k} AS canonical_key, '{t}' AS kind, {n} AS display_name FROM {t}" for t, k, n in tables.NODE_TABLES) + " UNION ALL SELECT 'orders:' || o_orderkey, 'orders', o_orderpriority FROM orders"
EDGES = " UNION ALL ".join(f"SELECT '{a}:' || {s} AS s, '{k}' AS k, '{b}:' || {t} AS t FROM {table}" for table, a, s, k, b, t in tables.EDGE_TABLES)
EVIDENCE = """SELECT 'evidence:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS evidence_key, 'orders/' || l_orderkey AS path, l_linenumber * 10 AS ev_start,
  l_linenumber * 10 + CAST(floor(l_quantity) AS INTEGER) % 15 AS ev_end, lower(l_returnflag) AS raw_kind, 'orders:' || l_orderkey AS order_key, 'part:' || l_partkey AS part_key, CAST(year(l_shipdate) - 1990 AS BIGINT) AS run_id FROM lineitem"""
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_KINDS.items()) + " END"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
OBS = f"""SELECT CAST((day(ts) - 1) // 7 + 1 AS BIGINT) AS run_id, event_id AS ordinal, {_KIND} AS kind, 'user-' || user_id AS source_id, 'u' || (user_id % 10) || '/f' || user_id || '.py' AS path,
  {_K} + 1 AS start_line, 'n' || {_K} AS name, 'lib' || ({_K} % 7) AS target, 'c' || ({_K} % 3) AS category, {_K} % 2 = 0 AS privileged, CASE {_K} % 4 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOLS))} END AS tool,
  '{{"category":"c' || ({_K} % 3) || '","k":' || {_K} || ',"privileged":"' || CASE WHEN {_K} % 2 = 0 THEN 'yes' ELSE 'off' END || '","tool":"' || CASE {_K} % 4 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOLS))} END || '"}}' AS metadata FROM events"""
PATHS = f"SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/d' || doc_id || CASE doc_id % {len(ENDINGS)} {' '.join(f'WHEN {i} THEN {e!r}' for i, e in enumerate(ENDINGS))} END AS path, text, lang FROM documents"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Listings, searches and neighborhoods.


@query(f"SELECT canonical_key, kind, display_name FROM ({NODES}) WHERE kind = 'customer' ORDER BY canonical_key LIMIT 50 OFFSET 20")
def canonical_nodes(spark, d):
    """A page of a listing: the limit is the feature."""
    return ops.nodes(tables.node_table(spark, d), kind="customer", limit=50, offset=20)


@query(f"SELECT s AS source_canonical_key, k AS edge_kind, t AS target_canonical_key FROM ({EDGES}) WHERE k = 'references' AND t = 'nation:3'")
def canonical_edges(spark, d):
    return ops.edges(tables.edge_table(spark, d), kind="references", target_key="nation:3").drop("identity_metadata_hash")


@query(f"SELECT canonical_key, kind, display_name FROM ({NODES}) WHERE contains(lower(canonical_key), 'red w') OR contains(lower(kind), 'red w') OR contains(lower(display_name), 'red w')")
def search_nodes(spark, d):
    return ops.search_nodes(tables.node_table(spark, d), "Red W")


@query(f"SELECT run_id, ordinal, kind, path FROM ({OBS}) WHERE contains(lower(metadata), 'brew') AND (path = 'u3' OR starts_with(path, 'u3/'))")
def search_observations(spark, d):
    return ops.search_observations(tables.observations(spark, d), "BREW", path="u3").select("run_id", "ordinal", "kind", "path")


@query(f"WITH e AS ({EDGES}), i AS (SELECT * FROM e WHERE s = 'customer:1' UNION SELECT * FROM e WHERE t = 'customer:1') SELECT canonical_key, kind, display_name FROM ({NODES}) WHERE canonical_key IN (SELECT s FROM i UNION SELECT t FROM i) AND canonical_key <> 'customer:1'")
def neighborhood_nodes(spark, d):
    return ops.neighborhood(tables.node_table(spark, d), tables.edge_table(spark, d), "customer:1")[0]


@query(f"WITH e AS ({EDGES}) SELECT s AS source_canonical_key, k AS edge_kind, t AS target_canonical_key FROM e WHERE s = 'nation:2' UNION SELECT s, k, t FROM e WHERE t = 'nation:2'")
def neighborhood_edges(spark, d):
    return ops.neighborhood(tables.node_table(spark, d), tables.edge_table(spark, d), "nation:2")[1].drop("identity_metadata_hash")


@query(f"""WITH e AS ({EDGES}), n AS ({NODES}), seeds AS (SELECT 'nation:' || n_nationkey AS seed FROM nation),
b AS (SELECT seed, 'outgoing' AS direction, t AS neighbor, k AS edge_kind, s, t FROM e JOIN seeds ON s = seed UNION ALL SELECT seed, 'incoming', s, k, s, t FROM e JOIN seeds ON t = seed),
r AS (SELECT b.*, n.kind AS neighbor_kind, n.display_name AS neighbor_name, row_number() OVER (PARTITION BY seed ORDER BY CASE edge_kind WHEN 'contains' THEN 1 ELSE 2 END, edge_kind, direction, neighbor) AS place FROM b JOIN n ON n.canonical_key = neighbor)
SELECT seed, direction, neighbor, edge_kind, neighbor_kind, neighbor_name, CAST(place AS INTEGER) AS place FROM r WHERE place <= 64""")
def expand_seeds(spark, d):
    """At most 64 edges of a seed: the feature's limit."""
    seeds = read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("canonical_key"))
    return ops.expand_seeds(tables.node_table(spark, d), tables.with_edge_keys(tables.edge_table(spark, d)), seeds, ["contains", "references"]).drop("edge_key")


@query(f"SELECT evidence_key, path, ev_start, ev_end, raw_kind, part_key, o_orderstatus AS status FROM ({EVIDENCE}) JOIN orders ON order_key = 'orders:' || o_orderkey LEFT JOIN part ON part_key = 'part:' || p_partkey WHERE o_custkey = 7")
def explain_evidence(spark, d):
    """Edge, evidence and raw row: inner, inner, left."""
    orders = read(spark, d, "orders").where("o_custkey = 7").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("order_key"), F.col("o_orderstatus").alias("status"))
    parts = read(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("part_key"), F.col("p_name"))
    return tables.evidence_table(spark, d).join(orders, "order_key").join(parts, "part_key", "left").select("evidence_key", "path", "ev_start", "ev_end", "raw_kind", "part_key", "status")


_SPANS = "SELECT 'orders/' || o_orderkey AS path, o_orderkey AS span_id, CAST(o_orderkey % 40 AS INTEGER) + 1 AS start_line, CAST(o_orderkey % 40 AS INTEGER) + 26 AS end_line FROM orders"


def _spans(spark, d):
    start = (F.col("o_orderkey") % 40).cast("int") + 1
    return read(spark, d, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("span_id"), start.alias("start_line"), (start + 25).alias("end_line"))


@query(f"SELECT span_id, evidence_key, s.start_line, s.end_line, ev_start, ev_end FROM ({_SPANS}) s JOIN ({EVIDENCE}) e ON s.path = e.path AND s.start_line <= e.ev_end AND s.end_line >= e.ev_start")
def line_overlaps(spark, d):
    return ops.overlaps(_spans(spark, d), tables.evidence_table(spark, d), ["path"]).select("span_id", "evidence_key", "start_line", "end_line", "ev_start", "ev_end")


@query(f"""SELECT span_id, evidence_key, ev_start, ev_end FROM (SELECT s.span_id, e.evidence_key, coalesce(e.ev_start, -1) AS ev_start, coalesce(e.ev_end, -1) AS ev_end, row_number() OVER (PARTITION BY s.span_id ORDER BY e.ev_start, e.ev_end, e.evidence_key) AS r
FROM ({_SPANS}) s LEFT JOIN ({EVIDENCE}) e ON s.path = e.path AND s.start_line <= e.ev_end AND s.end_line >= e.ev_start) WHERE r = 1""")
def first_overlaps(spark, d):
    return ops.first_overlap(_spans(spark, d), tables.evidence_table(spark, d), ["path"], ["span_id"]).select("span_id", "evidence_key", F.coalesce("ev_start", F.lit(-1)).alias("ev_start"), F.coalesce("ev_end", F.lit(-1)).alias("ev_end"))


@query(f"""WITH e AS ({EVIDENCE}), c AS (SELECT order_key, coalesce(max(CASE WHEN run_id = 5 THEN run_id END), max(run_id)) AS run FROM e GROUP BY order_key)
SELECT e.order_key AS canonical_key, evidence_key, run_id, CASE WHEN run_id = 5 THEN 'current' ELSE 'historical' END AS relation FROM e JOIN c ON e.order_key = c.order_key AND run_id = run WHERE raw_kind <> 'n'""")
def node_locations(spark, d):
    ev = tables.evidence_table(spark, d)
    links = ev.select(F.col("order_key").alias("canonical_key"), "evidence_key")
    return ops.node_locations(links, ev.drop("order_key"), 5, F.col("raw_kind") != "n").select("canonical_key", "evidence_key", "run_id", "relation")


@query(f"""WITH c AS (SELECT path AS dest, ordinal, kind FROM ({OBS})), m AS (SELECT dest, ordinal, kind, row_number() OVER (PARTITION BY dest ORDER BY ordinal) AS member FROM c),
g AS (SELECT dest FROM m WHERE member = 1 ORDER BY ordinal LIMIT 10 OFFSET 5) SELECT dest, ordinal, kind, CAST(member AS INTEGER) AS member FROM m WHERE dest IN (SELECT dest FROM g) AND member <= 3""")
def navigation_groups(spark, d):
    """A page of groups with their first members: the feature's limits."""
    c = tables.observations(spark, d).select(F.col("path").alias("dest"), "ordinal", "kind")
    return ops.grouped(c, ["dest"], ["ordinal"], 10, 3, skip=5)


@query(f"""SELECT f.path, coalesce(n, 0) AS n_evidence, kinds FROM (SELECT 'orders/' || o_orderkey AS path FROM orders) f LEFT JOIN (SELECT path, count(*) AS n, array_to_string(list_sort(list(DISTINCT raw_kind)), ',') AS kinds FROM ({EVIDENCE}) GROUP BY path) e ON f.path = e.path""")
def file_listing(spark, d):
    files = read(spark, d, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"))
    out = ops.file_listing(files, tables.evidence_table(spark, d).withColumn("extractor", F.lit("x")))
    return out.select("path", "n_evidence", F.array_join("kinds", ",").alias("kinds"))


# Merges, guards, digests.


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_proposal_wins(spark, d):
    return merge.first_wins(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_proposal_wins(spark, d):
    return merge.last_wins(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""WITH p AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_acctbal > 0)
SELECT c_custkey AS k, CASE WHEN p.k IS NOT NULL THEN p.v ELSE c_mktsegment END AS v, 1 AS first_seen_run_id, CASE WHEN p.k IS NOT NULL THEN 2 ELSE 1 END AS last_seen_run_id FROM customer LEFT JOIN p ON c_custkey = p.k
UNION ALL SELECT -1 - s_suppkey, upper(s_name), 2, 2 FROM supplier""")
def upsert(spark, d):
    """All customers as current; those with a balance, and all suppliers as new keys, as proposed."""
    c = read(spark, d, "customer")
    current = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(1).alias("first_seen_run_id"), F.lit(1).alias("last_seen_run_id"))
    proposed = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"))
    return merge.upsert(current, proposed.union(read(spark, d, "supplier").select(-1 - F.col("s_suppkey"), F.upper("s_name"))), ["k"], 2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 20)")
def missing_references(spark, d):
    return merge.missing_references(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, d, "customer").where("c_nationkey < 20"), "c_custkey")


@query("SELECT p_name, p_brand, count(DISTINCT p_type) AS n_payloads FROM part GROUP BY p_name, p_brand HAVING count(DISTINCT p_type) > 1")
def identity_conflicts(spark, d):
    return merge.identity_conflicts(read(spark, d, "part"), ["p_name", "p_brand"], F.col("p_type"))


@query("""SELECT l_orderkey, array_to_string(list_distinct_ordered, '>') AS flags FROM (SELECT l_orderkey, list(f ORDER BY o, f) AS list_distinct_ordered FROM (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber * 1000000 + l_partkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey)""")
def first_seen_values(spark, d):
    """File facts: distinct values in the order of their first appearance."""
    facts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit("role").alias("name"), F.col("l_returnflag").alias("value"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"))
    return merge.file_nodes(facts).select(F.col("path").alias("l_orderkey"), F.array_join(F.col("facts")["role"], ">").alias("flags"))


@query(f"SELECT s || '>' || t AS edge, 'canonical-edge:' || sha256('{{\"identity_metadata\":{{}},\"kind\":\"' || k || '\",\"source\":\"' || s || '\",\"target\":\"' || t || '\",\"version\":1}}') AS edge_key FROM ({EDGES})")
def edge_keys(spark, d):
    return tables.with_edge_keys(tables.edge_table(spark, d)).select(F.concat("source_canonical_key", F.lit(">"), "target_canonical_key").alias("edge"), "edge_key")


@query("SELECT p_partkey, 'chunk:' || sha256('frame:2:' || strlen(p_name) || ':' || p_name || ';' || strlen(p_brand) || ':' || p_brand || ';') AS digest FROM part")
def framed_digests(spark, d):
    return read(spark, d, "part").select("p_partkey", keys.framed_digest("chunk", F.col("p_name"), F.col("p_brand")).alias("digest"))


@query("SELECT page_id, 'url:' || replace(replace(url, '%', '%25'), ':', '%3A') AS key, 'url' AS kind, url AS display_name FROM pages")
def key_grammar(spark, d):
    k = read(spark, d, "pages").select("page_id", keys.node_key("url", F.col("url")).alias("key"))
    return k.select("page_id", "key", keys.key_kind(F.col("key")).alias("kind"), keys.key_display_name(F.col("key")).alias("display_name"))


# Summaries.


@query(f"""SELECT 'nodes' AS metric, '' AS key, count(*) AS value FROM ({NODES}) UNION ALL SELECT 'nodes_by_kind', kind, count(*) FROM ({NODES}) GROUP BY kind UNION ALL SELECT 'edges', '', count(*) FROM ({EDGES})
UNION ALL SELECT 'edges_by_edge_kind', k, count(*) FROM ({EDGES}) GROUP BY k UNION ALL SELECT 'observations', '', count(*) FROM events UNION ALL SELECT 'observations_by_kind', kind, count(*) FROM ({OBS}) GROUP BY kind""")
def graph_summary(spark, d):
    return summary.metrics({"nodes": (tables.node_table(spark, d), "kind"), "edges": (tables.edge_table(spark, d), "edge_kind"), "observations": (tables.observations(spark, d), "kind")})


@query(f"""WITH b AS (SELECT 'observations_by_kind' AS metric, kind AS key, count(*) AS v FROM ({OBS}) WHERE run_id <= 2 GROUP BY kind UNION ALL SELECT 'observations', '', count(*) FROM ({OBS}) WHERE run_id <= 2),
c AS (SELECT 'observations_by_kind' AS metric, kind AS key, count(*) AS v FROM ({OBS}) WHERE run_id <= 4 AND kind <> 'shell.command' GROUP BY kind UNION ALL SELECT 'observations', '', count(*) FROM ({OBS}) WHERE run_id <= 4 AND kind <> 'shell.command')
SELECT coalesce(b.metric, c.metric) AS metric, coalesce(b.key, c.key) AS key, coalesce(b.v, -1) AS before, coalesce(c.v, -1) AS after FROM b FULL JOIN c ON b.metric = c.metric AND b.key = c.key WHERE b.v IS DISTINCT FROM c.v""")
def baseline_drift(spark, d):
    o = tables.observations(spark, d)
    out = summary.drift(summary.metrics({"observations": (o.where("run_id <= 4 and kind <> 'shell.command'"), "kind")}), summary.metrics({"observations": (o.where("run_id <= 2"), "kind")}))
    return out.fillna(-1, ["before", "after"])


@query(f"SELECT category, tool, count(*) AS count, CAST(sum(CAST(privileged AS INTEGER)) AS BIGINT) AS privileged_count FROM ({OBS}) WHERE kind = 'shell.host_mutation' GROUP BY category, tool")
def host_mutators_summary(spark, d):
    return summary.host_mutator_summary(tables.observations(spark, d))


@query(f"SELECT path, start_line AS line, name, category, tool, privileged FROM ({OBS}) WHERE kind = 'shell.host_mutation' AND tool = 'brew'")
def host_mutators(spark, d):
    return summary.host_mutators(tables.observations(spark, d), tool="brew")


@query(f"SELECT count(*) FILTER (starts_with(kind, 'python.')) AS python_observations, count(*) FILTER (kind = 'python.module') AS modules, count(*) FILTER (kind = 'python.function') AS functions, count(*) FILTER (kind = 'python.import') AS imports FROM ({OBS})")
def python_summary(spark, d):
    return summary.python_summary(tables.observations(spark, d)).select("python_observations", "modules", "functions", "imports")


@query(f"SELECT source_id, count(DISTINCT run_id) AS runs, count(*) AS observations, count(DISTINCT path) AS artifacts, max(run_id) AS latest_run_id, arg_max(path, run_id * 1000000000 + ordinal) AS latest_artifact FROM ({OBS}) GROUP BY source_id")
def ingested_sources(spark, d):
    return summary.ingested_sources(tables.observations(spark, d))


@query(f"SELECT source_id, run_id, count(*) AS observations, count(DISTINCT kind) AS kinds FROM ({OBS}) GROUP BY source_id, run_id")
def source_runs(spark, d):
    return summary.source_runs(tables.observations(spark, d))


@query("SELECT user_id AS graph_id, max(event_id) AS latest_run_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END, event_id) AS latest_status, max(event_id) FILTER (event_type = 'purchase') AS accepted_run_id FROM events GROUP BY user_id")
def refresh_status(spark, d):
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("running")
    return summary.accepted_run(read(spark, d, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("run_id"), status.alias("status")))


@query(f"SELECT count(*) FILTER (kind = 'shell.command') AS command, count(*) FILTER (kind = 'shell.host_mutation') AS host_mutation FROM ({OBS})")
def shell_kind_counts(spark, d):
    return summary.counts(tables.observations(spark, d), {"command": F.col("kind") == "shell.command", "host_mutation": F.col("kind") == "shell.host_mutation"})


# Classification and text.


@query(f"""WITH p AS ({PATHS}), x AS (SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) AS ext FROM p)
SELECT doc_id, path, CASE WHEN name = 'go.mod' THEN 'go-module' WHEN regexp_matches(name, '^requirements(-[0-9A-Za-z_.-]+)?\\.txt$') THEN 'python' WHEN ext = 'py' THEN 'python' WHEN ext = 'md' THEN 'markdown' WHEN ext = 'go' THEN 'go' WHEN ext = 'tf' THEN 'terraform'
  WHEN ext = 'json' THEN 'json' WHEN ext = 'zsh' THEN 'zsh' WHEN ext = 'rb' THEN 'ruby' WHEN ext = 'js' THEN 'javascript' ELSE 'unknown' END AS language,
 CASE WHEN contains(path, '/generated/') THEN 'generated' WHEN ends_with(name, '_test.go') OR contains(name, '.test.') THEN 'test' WHEN ends_with(name, '.md') THEN 'documentation'
  WHEN name = 'go.mod' OR ends_with(name, '.tf') OR regexp_matches(name, '^requirements(-[0-9A-Za-z_.-]+)?\\.txt$') THEN 'config' WHEN ends_with(name, '.zsh') THEN 'source' ELSE 'unknown' END AS role,
 CASE WHEN ext IN ('py') THEN 'python' WHEN ext = 'md' THEN 'markdown' WHEN ext = 'gz' THEN 'archive' WHEN ext = 'json' THEN 'config' WHEN ext = 'zsh' THEN 'zsh' WHEN ext = 'txt' THEN 'document' WHEN ext = 'rb' THEN 'ruby' WHEN ext = 'js' THEN 'javascript' END AS route FROM x""")
def classified_files(spark, d):
    p = F.col("path")
    return tables.document_files(spark, d).select("doc_id", "path", classify.language(p).alias("language"), classify.role(p, F.lit(False), classify.generated(p)).alias("role"), classify.bulk_route(p).alias("route"))


@query(f"SELECT doc_id, path FROM ({PATHS}) WHERE NOT (starts_with(path, 'src0/en/') OR path = 'src0/en' OR list_contains(string_split(path, '/'), 'de') OR regexp_matches(path, '^src1[^/]*/fr/[^/]*\\.md(/.*)?$'))")
def included_files(spark, d):
    return tables.document_files(spark, d).where(~classify.excluded(F.col("path"), ("src0/en", "de", "src1*/fr/*.md"))).select("doc_id", "path")


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS INTEGER) END AS line_count FROM documents")
def line_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).alias("line_count"))


_ALIAS = """WITH r AS (SELECT p_partkey, 'lib/' || p_type || 'Node_' || p_size || '.readAll:' || p_brand AS t FROM part),
c AS (SELECT p_partkey, i, cand FROM (SELECT p_partkey, unnest(regexp_extract_all(t, '[A-Za-z0-9_./:-]+')) AS cand, generate_subscripts(regexp_extract_all(t, '[A-Za-z0-9_./:-]+'), 1) AS i FROM r)),
p AS (SELECT p_partkey, i, list_filter(regexp_split_to_array(cand, '[/_.:-]+'), lambda x: x <> '') AS parts FROM c),
q AS (SELECT p_partkey, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM p),
m AS (SELECT p_partkey, i, j, 0 AS a, 0 AS b, lower(part) AS tok FROM q
  UNION ALL SELECT p_partkey, i, j, a, 0, lower(s) FROM (SELECT p_partkey, i, j, unnest(sp) AS s, generate_subscripts(sp, 1) AS a FROM (SELECT p_partkey, i, j, string_split(regexp_replace(regexp_replace(part, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ') AS sp FROM q))
  UNION ALL SELECT p_partkey, i, j, a, b, s2 FROM (SELECT p_partkey, i, j, a, unnest(sp2) AS s2, generate_subscripts(sp2, 1) AS b FROM (SELECT p_partkey, i, j, a, string_split(regexp_replace(regexp_replace(lower(s), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), ' ') AS sp2
    FROM (SELECT p_partkey, i, j, unnest(sp) AS s, generate_subscripts(sp, 1) AS a FROM (SELECT p_partkey, i, j, string_split(regexp_replace(regexp_replace(part, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ') AS sp FROM q))))
  UNION ALL SELECT p_partkey, i, 1000000, 0, 0, lower(array_to_string(parts, '')) FROM p WHERE len(parts) > 1),
f AS (SELECT p_partkey, tok, min((i, j, a, b)) AS o FROM m WHERE regexp_matches(tok, '^[a-z0-9]{2,64}$') GROUP BY p_partkey, tok)
SELECT p_partkey, string_agg(tok, ' ' ORDER BY o) AS aliases FROM f GROUP BY p_partkey"""


@query(_ALIAS)
def alias_tokens(spark, d):
    p = read(spark, d, "part")
    t = F.concat(F.lit("lib/"), "p_type", F.lit("Node_"), F.col("p_size").cast("string"), F.lit(".readAll:"), "p_brand")
    return p.select("p_partkey", F.array_join(text.alias_tokens(F.lit(""), t), " ").alias("aliases"))


@query("""SELECT item_id, CASE WHEN a = '' THEN 'section' ELSE a END AS anchor FROM (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(regexp_replace(text || ' [x](y) *z*', '[`*_\\[\\]()]', '', 'g')), ' '), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS a FROM benchmark)""")
def markdown_anchors(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.markdown_anchor(F.concat("text", F.lit(" [x](y) *z*"))).alias("anchor"))


@query("""WITH h AS (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS pos FROM documents WHERE contains(text, 'anan')) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(1 + length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) AS INTEGER) AS start_line,
CAST(1 + length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) AS INTEGER) AS end_line FROM h WHERE substr(text, pos, 4) = 'anan'""")
def literal_occurrences(spark, d):
    """Every occurrence, overlapping ones too, with its lines."""
    return text.occurrences(read(spark, d, "documents").select("doc_id", "text"), "anan")


_BODY = "(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ')"


@query(f"SELECT doc_id FROM documents WHERE contains({_BODY}, ' of the ')")
def phrase_search(spark, d):
    return lexical.phrase(read(spark, d, "documents").select("doc_id", "text"), "of the", ["doc_id"], "text").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE (contains({_BODY}, ' and of ') AND NOT contains({_BODY}, ' shall ')) OR (contains({_BODY}, ' und ') AND contains({_BODY}, ' der '))")
def web_search(spark, d):
    q = lexical.parse_web_query('"and of" -shall or und der')
    return read(spark, d, "documents").where(lexical.satisfies(F.col("text"), q)).select("doc_id")


@query("""WITH e AS (SELECT event_id, event_type, value, user_id FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'run_incomplete' WHEN user_id % 5 = 0 THEN 'lexical_building' WHEN value > 50 THEN 'privacy_refused' ELSE 'ok' END AS state FROM e""")
def publication_fence(spark, d):
    return read(spark, d, "events").select("event_id", lexical.fence({"privacy_refused": F.col("value") > 50, "lexical_building": F.col("user_id") % 5 == 0, "run_incomplete": F.col("event_type") == "error"}).alias("state"))


# Ranking and similarity.


@query(f"""WITH n AS ({NODES}), c AS (SELECT *, CASE WHEN display_name = 'red widget' THEN 0 WHEN lower(display_name) = 'red widget' THEN 1 WHEN starts_with(lower(display_name), 'red widget') THEN 3 WHEN contains(lower(display_name), 'red widget') THEN 4 ELSE 6 END AS m,
 CASE WHEN hash_id % 4 = 0 THEN 3 WHEN hash_id % 3 = 0 THEN 0 WHEN hash_id % 2 = 0 THEN 1 ELSE 2 END AS ev FROM (SELECT *, CAST(split_part(canonical_key, ':', 2) AS BIGINT) AS hash_id FROM n WHERE kind IN ('part', 'customer')))
SELECT canonical_key, CASE WHEN m <= 2 THEN 0 ELSE 1 END AS exactness_tier, 1 AS affinity_tier, CAST(m AS INTEGER) AS match_class_tier, ev AS evidence_tier, CAST(hash_id % 2 AS INTEGER) AS publication_tier,
CAST(row_number() OVER (ORDER BY CASE WHEN m <= 2 THEN 0 ELSE 1 END, m, ev, hash_id % 2, canonical_key) AS INTEGER) AS rank FROM c""")
def ranked_candidates(spark, d):
    return _ranked(spark, d).select("canonical_key", *ranking.TIERS, "rank")


def _ranked(spark, d):
    n = F.split_part("canonical_key", F.lit(":"), F.lit(2)).cast("long")
    c = tables.node_table(spark, d).where(F.col("kind").isin("part", "customer")).select(
        "*", F.lit("other").alias("subject_family"), (n % 2 == 0).alias("has_direct_evidence"), (n % 3 == 0).alias("has_verified_direct_location"), (n % 4 == 0).alias("identity_withheld"), (n % 2 == 0).alias("is_current_publication"),
    )
    return ranking.rank_candidates(c, "red widget", "general")


@query("SELECT CASE WHEN count(*) >= 2 THEN 'ambiguous' WHEN count(*) = 1 THEN 'unambiguous' ELSE 'empty' END AS status, count(*) AS tied_top_count FROM part WHERE p_name = 'red widget'")
def ranking_ambiguity(spark, d):
    return ranking.ambiguity(_ranked(spark, d))


@query("""WITH k(kind) AS (VALUES ('python.function'), ('doc.page'), ('email.message'), ('bats.test_case'), ('zunit.hook'), ('x.y')), r(raw) AS (VALUES ('python.function'), ('markdown.document'), ('email.message'), ('bats.test_case'), ('zunit.setup')), l(link) AS (VALUES ('observed'), ('inferred_from_edge'), ('supports'))
SELECT kind, raw, link, CASE WHEN (link = 'observed' AND kind = raw AND kind IN ('python.function', 'email.message')) OR (link = 'observed' AND kind = 'doc.page' AND raw = 'markdown.document') OR (link IN ('observed', 'inferred_from_edge') AND kind = 'bats.test_case' AND raw = kind)
 OR (link IN ('observed', 'inferred_from_edge') AND kind = 'zunit.hook' AND raw = 'zunit.setup') THEN 'direct' WHEN link = 'inferred_from_edge' THEN 'reference' ELSE 'unknown' END AS role FROM k, r, l""")
def evidence_roles(spark, d):
    """The rules over a small table of all combinations."""
    one = lambda name, xs: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))
    c = one("kind", ["python.function", "doc.page", "email.message", "bats.test_case", "zunit.hook", "x.y"]).crossJoin(one("raw", ["python.function", "markdown.document", "email.message", "bats.test_case", "zunit.setup"])).crossJoin(one("link", ["observed", "inferred_from_edge", "supports"]))
    return c.withColumn("role", rank.evidence_role(F.col("link"), F.col("kind"), F.col("raw")))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 8), 6) AS distance FROM embeddings, q WHERE vec_id <> 3 ORDER BY round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 8), vec_id LIMIT 25""")
def nearest_vectors(spark, d):
    """A top-k: the limit is the feature."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("canonical_key"), "embedding")
    _, out = similar.similar_nodes(rows, 3, 25)
    return out.select(F.col("canonical_key").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS seed, e.vec_id, round(1 - list_cosine_similarity(e.v, q.v), 8) AS d FROM e JOIN e q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT seed, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY d, vec_id) AS r FROM p) WHERE r <= 25""")
def nearest_vectors_each(spark, d):
    """Every row whose id is divisible by 50 as a seed against all rows; the top-k is the feature."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return similar.nearest_each(rows, rows.where("vec_id % 50 = 0"), 25).select("seed", "vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) - 1) <= 1e-5 AS valid FROM embeddings")
def vector_validation(spark, d):
    return read(spark, d, "embeddings").select("vec_id", similar.valid_vector(F.col("embedding"), 64).alias("valid"))


# Graph construction.


@query(f"""WITH o AS ({OBS}), t AS (SELECT *, CASE WHEN kind IN ('python.module', 'python.function') THEN kind || ':' || path || ':' || name ELSE 'external:' || target END AS tk FROM o),
n AS (SELECT DISTINCT 'file:' || path AS canonical_key, 'file' AS kind FROM o UNION SELECT DISTINCT tk, split_part(tk, ':', 1) FROM t) SELECT canonical_key, kind FROM n""")
def canonicalized_nodes(spark, d):
    return canonical.canonicalize(tables.observations(spark, d)).nodes.select("canonical_key", "kind")


@query(f"""WITH o AS ({OBS}), t AS (SELECT *, CASE WHEN kind IN ('python.module', 'python.function') THEN kind || ':' || path || ':' || name ELSE 'external:' || target END AS tk, CASE kind WHEN 'shell.command' THEN 'executes' WHEN 'python.import' THEN 'imports' WHEN 'shell.host_mutation' THEN 'mutates_host' ELSE 'defines' END AS ek FROM o)
SELECT 'file:' || path AS source_canonical_key, ek AS edge_kind, tk AS target_canonical_key, count(DISTINCT ordinal) AS n_evidence FROM t GROUP BY ALL""")
def canonicalized_edges(spark, d):
    g = canonical.canonicalize(tables.observations(spark, d))
    n = g.edge_links.groupBy("edge_key").agg(F.count(F.lit(1)).alias("n_evidence"))
    return g.edges.join(n, "edge_key").select("source_canonical_key", "edge_kind", "target_canonical_key", "n_evidence")


@query(f"SELECT kind || ':' || path || ':' || name AS canonical_key, arg_min(metadata, ordinal) AS metadata FROM ({OBS}) WHERE kind IN ('python.module', 'python.function') GROUP BY 1")
def node_metadata(spark, d):
    """The first metadata of a key stays."""
    g = canonical.canonicalize(tables.observations(spark, d))
    return g.nodes.where(F.col("kind").isin("python.module", "python.function")).select("canonical_key", "metadata")


@query(f"WITH o AS ({OBS}) SELECT 'warning' AS severity, 'unsupported_observation' AS code, ordinal FROM o WHERE kind = 'shell.command'")
def unsupported_kinds(spark, d):
    rules = {k: v for k, v in canonical.RULES.items() if k != "shell.command"}
    return canonical.canonicalize(tables.observations(spark, d), rules).diagnostics.select("severity", "code", "ordinal")


# Events in windows: an extension beside the reference's operators.


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_events(spark, d):
    e = read(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM s)
SELECT user_id, min(ts) AS began, count(*) AS n FROM g GROUP BY user_id, sid""")
def user_sessions(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("began"), "n")


# Extraction, admission and chunks.


@query("SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, list_min(l) AS first_link, list_max(l) AS last_link FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages) WHERE len(l) > 0")
def page_links(spark, d):
    """Links that the HTML extractor finds in pages."""
    from ..extractors import extract

    files = read(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").cast("binary").alias("content"))
    links = extract(files).where("kind = 'html.link'").groupBy("path").agg(F.count(F.lit(1)).alias("n_links"), F.min("target").alias("first_link"), F.max("target").alias("last_link"))
    return links.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), "n_links", "first_link", "last_link")


@query(f"""WITH p AS ({PATHS}) SELECT doc_id, CASE WHEN starts_with(path, 'src3/') THEN 'binding_private' WHEN doc_id % 7 = 0 THEN 'artifact_private' WHEN ends_with(path, 'Makefile') OR ends_with(path, '.tar.gz') OR ends_with(path, 'go.mod') THEN 'unsupported_format'
WHEN strlen(text) > 4000 THEN 'too_large' ELSE 'admitted' END AS reason FROM p""")
def body_admission(spark, d):
    from ..functions import policy

    f = tables.document_files(spark, d).withColumn("language", classify.language(F.col("path")))
    binding = policy.binding_exclusion(F.lit(False), F.col("path").startswith("src3/"), F.lit(True), F.lit("code"))
    return f.select("doc_id", policy.body_admission(F.col("language"), F.octet_length("text"), F.col("doc_id") % 7 == 0, binding, 4000).alias("reason"))


@query()
def document_chunks(spark, d):
    """Chunks of at most 80 lines and 8192 bytes: a state per line, which SQL can't express; tests hold it against its rules."""
    return text.chunks(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


@query()
def ranked_chunks(spark, d):
    """Full-text ranking of documents by cover density."""
    docs = read(spark, d, "documents").select("doc_id", F.lit("d").alias("path"), F.col("text").alias("chunk_text"))
    _, out = lexical.ranked(docs, '"of the" -shall', ["doc_id"], max_chunks=10**9, max_files=10**9)
    return out.select("doc_id", "score")


@query()
def family_digest(spark, d):
    """The order-independent checksum of the node family."""
    got = merge.family_checksum(tables.node_table(spark, d), F.col("canonical_key"), F.concat_ws("|", "kind", "display_name"))
    return spark.createDataFrame([(got["rows"], got["digest"])], "n long, digest string")
