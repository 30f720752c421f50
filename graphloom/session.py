"""GraphSession: the catalogue of read-only queries over a published graph, each giving a DataFrame or a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extractors import extract
from .functions import rank
from .operators import canonical, context, lexical, publish, ranking, read, similar, summary
from .sources import discover, feed_items, memory_entries
from .sources.services import memory_summary


class GraphSession:
    """Tables of one accepted run, registered as temporary views, and methods for each query of the catalogue."""

    def __init__(self, spark: SparkSession, folder: str, graph_id: str = "graph", run_id: int | None = None):
        self.spark, self.folder, self.graph_id = spark, folder, graph_id
        self.run_id = run_id if run_id is not None else publish.accepted(spark, folder, graph_id)
        if self.run_id is None:
            raise ValueError(f"{graph_id} has no complete run")
        self.t = publish.load(spark, folder, self.run_id)
        for name, df in self.t.items():
            df.createOrReplaceTempView(f"graph_{name}")

    @classmethod
    def build(cls, spark: SparkSession, root: str, folder: str, run_id: int = 1, excludes: tuple[str, ...] = (), profile: dict | None = None, graph_id: str = "graph") -> GraphSession:
        """Scan a repository, extract it once, canonicalize what was stored, and publish it."""
        files = discover(spark, root, excludes, profile)
        observations = publish.staged(folder, run_id, "observations", extract(files, run_id), graph_id)
        publish.publish(folder, run_id, canonical.canonicalize(observations), observations, files, graph_id)
        return cls(spark, folder, graph_id, run_id)

    # Status.
    def projects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs").select("graph_id").distinct().orderBy("graph_id")

    list_graphs = projects

    def refresh_status(self) -> DataFrame:
        return summary.accepted_run(self.spark.read.parquet(f"{self.folder}/runs"))

    graph_status = refresh_status

    def status(self) -> DataFrame:
        t = self.t
        runs = self.spark.read.parquet(f"{self.folder}/runs").where(F.col("graph_id") == self.graph_id)
        return summary.storage_summary(t["observations"], t.get("files", t["observations"].limit(0)), t["nodes"], t["edges"], t["evidence"], t["node_links"], t["edge_links"], runs)

    def project_summary(self) -> DataFrame:
        t = self.t
        families = {"observations": (t["observations"], "kind"), "nodes": (t["nodes"], "kind"), "edges": (t["edges"], "edge_kind")}
        return summary.metrics(families | ({"files": (t["files"], "language")} if "files" in t else {}))

    def drift(self, baseline: DataFrame) -> DataFrame:
        return summary.drift(self.project_summary(), baseline)

    # Listings and searches.
    def canonical_nodes(self, **filters) -> DataFrame:
        return read.nodes(self.t["nodes"], **filters)

    def canonical_edges(self, **filters) -> DataFrame:
        return read.edges(self.t["edges"], **filters)

    def search_nodes(self, query: str, **filters) -> DataFrame:
        return read.search_nodes(self.t["nodes"], query, **filters)

    def search_files(self, query: str, **filters) -> DataFrame:
        return read.search_files(self.t["files"], query, **filters)

    def search_observations(self, query: str, **filters) -> DataFrame:
        return read.search_observations(self.t["observations"], query, **filters)

    def files(self, role: str | None = None, language: str | None = None, generated: str = "include") -> DataFrame:
        from .sources.repository import filtered

        return filtered(self.t["files"], role, language, generated).orderBy("path")

    def entrypoints(self) -> DataFrame:
        return self.files(role="entrypoint")

    def host_mutators(self, **filters) -> DataFrame:
        return summary.host_mutators(self.t["observations"], **filters)

    # Neighborhoods and explanations.
    def neighborhood(self, node: str, direction: str = "both", node_limit: int = 100, edge_limit: int = 200) -> dict[str, object]:
        n, e = read.neighborhood(self.t["nodes"], self.t["edges"], node, direction)
        return {"center": node, "nodes": read.read_page(n, node_limit), "edges": read.read_page(e, edge_limit)}

    canonical_neighborhood = neighborhood

    def explain_canonical_edge(self, source_key: str, kind: str, target_key: str) -> DataFrame:
        t = self.t
        return read.explain_edge(t["edges"], t["edge_links"], t["evidence"], t["observations"], source_key, kind, target_key)

    def node_locations(self, node: str | None = None) -> DataFrame:
        links = self.t["node_links"] if node is None else self.t["node_links"].where(F.col("canonical_key") == node)
        return read.node_locations(links, self.t["evidence"], self.run_id)

    def navigation_search(self, query: str, intent: str | None = None, kinds: list[str] | None = None) -> DataFrame:
        """Ranked candidates with whether they have direct evidence."""
        found = read.search_nodes(self.t["nodes"], query)
        found = found if kinds is None else found.where(F.col("kind").isin(*kinds))
        at = self.t["node_links"].join(self.t["evidence"].select("evidence_key", "raw_kind", "path", "start_line"), "evidence_key").join(found.select("canonical_key", "kind"), "canonical_key")
        direct = rank.evidence_role(F.col("link_kind"), F.col("kind"), F.col("raw_kind")) == "direct"
        has = at.groupBy("canonical_key").agg(F.max(direct).alias("has_direct_evidence"), F.max(direct & F.col("start_line").isNotNull()).alias("has_verified_direct_location"), F.min("path").alias("path"))
        c = found.join(has, "canonical_key", "left").fillna(False, ["has_direct_evidence", "has_verified_direct_location"])
        c = c.withColumn("subject_family", rank.subject_family(F.col("kind"), F.col("canonical_key"), F.col("display_name"), F.col("path"))).withColumn("identity_withheld", F.lit(False)).withColumn("is_current_publication", F.lit(True))
        return ranking.rank_candidates(c, query, intent).orderBy("rank")

    def context_packet(self, query: str, intent: str | None = None, budget: int = 16_384, max_items: int = 20, max_locations: int = 3) -> dict:
        """The first ranked nodes with places, packed into a budget of bytes."""
        top = self.navigation_search(query, intent).limit(max_items)
        w = self.node_locations().join(top.select("canonical_key", "rank"), "canonical_key").groupBy("canonical_key").agg(F.slice(F.sort_array(F.collect_set(F.struct("path", "start_line", "end_line"))), 1, context.MAX_LOCATIONS).alias("locations"))
        rows = top.join(w, "canonical_key", "left").orderBy("rank").collect()  # at most max_items
        items = [{"key": r["canonical_key"], "kind": r["kind"], "name": r["display_name"], "rank": r["rank"], "match": r["match_class"], "locations": [x.asDict() for x in r["locations"] or []]} for r in rows]
        return context.pack(items, budget, {"query": query, "intent": intent}, max_items, max_locations)

    # Full text and vectors.
    def lexical_query(self, chunks: DataFrame, query: str, key: list[str], **options) -> tuple[str, DataFrame]:
        return lexical.ranked(chunks, query, key, **options)

    def similar_nodes(self, embeddings: DataFrame, seed_key: str, k: int = 10) -> tuple[str, DataFrame | None]:
        return similar.similar_nodes(embeddings, seed_key, k, in_scope=self.t["nodes"])

    def embedding_profiles(self, profiles: DataFrame, dimensions: int) -> DataFrame:
        return profiles.where((F.col("dimensions") == dimensions) & (F.col("normalization") == "l2-unit") & (F.col("metric") == "cosine"))

    # Sources.
    def ingested_sources(self) -> DataFrame:
        return summary.ingested_sources(self.t["observations"])

    def source_runs(self) -> DataFrame:
        return summary.source_runs(self.t["observations"])

    def source_summary(self, source_id: str) -> DataFrame:
        return summary.count_map(self.t["observations"].where(F.col("source_id") == source_id), "kind")

    def source_feed_items(self) -> DataFrame:
        return feed_items(self.t["observations"])

    def explain_source_feed_item(self, item: str) -> DataFrame:
        return self.source_feed_items().where(F.col("item") == item)

    def source_references(self, source_id: str | None = None) -> DataFrame:
        o = self.t["observations"].where(F.col("kind").isin("feed.link", "feed.author", "feed.category", "feed.enclosure"))
        return (o if source_id is None else o.where(F.col("source_id") == source_id)).select("source_id", F.col("name").alias("item"), "kind", "target").orderBy("source_id", "item", "kind", "target")

    def server_memory_summary(self, path: str) -> DataFrame:
        return memory_summary(memory_entries(self.spark, path))

    def server_memory_search(self, path: str, query: str) -> DataFrame:
        return memory_entries(self.spark, path).where(read.matches(query, F.col("name"), F.col("text"), F.col("entity_type"))).orderBy("type", "name", "text")

    # Summaries by family: python_summary(), openapi_summary(), terraform_summary(), nix_summary(), js_framework_summary() and so on.
    def __getattr__(self, name: str):
        family = name.removesuffix("_summary")
        if name.endswith("_summary") and family in summary.SUMMARIES:
            return lambda: summary.SUMMARIES[family](self.t["observations"])
        raise AttributeError(name)
