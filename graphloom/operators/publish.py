"""Generations: immutable tables of a run under a folder, and the pointer to the accepted one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge
from .canonical import Graph

FAMILIES = ("observations", "files", "nodes", "edges", "evidence", "node_links", "edge_links")


class IntegrityError(ValueError):
    """A generation that names missing rows, or has errors."""


def publish(folder: str, run_id: int, graph: Graph, observations: DataFrame, files: DataFrame | None = None, graph_id: str = "graph") -> dict[str, object]:
    """Write a run's families as Parquet, guard them, then append the run's row: readers see it only after that.

    A run that fails its guards leaves a failed run and its tables for diagnosis; the accepted run stays what it was. A run that is
    published already is refused: its tables never change. The graph should come from stored observations (staged), or each family
    extracts them anew.
    """
    spark = observations.sparkSession
    base = f"{folder.rstrip('/')}/run={run_id}"
    if published(spark, folder, run_id, graph_id):
        raise IntegrityError(f"run {run_id} of {graph_id} is published already")
    tables = {"observations": observations, "nodes": graph.nodes, "edges": graph.edges, "evidence": graph.evidence, "node_links": graph.node_links, "edge_links": graph.edge_links, "diagnostics": graph.diagnostics}
    if files is not None:
        tables["files"] = files.drop("content")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    t = {name: spark.read.parquet(f"{base}/{name}") for name in tables}
    bad = merge.integrity_violations(t["nodes"], t["edges"], t["evidence"], t["node_links"], t["edge_links"])
    errors = bad.limit(1).count() + t["diagnostics"].where("severity = 'error'").limit(1).count()
    digest = merge.structural_digest({"nodes": (t["nodes"], ["canonical_key"], ["kind", "display_name", "metadata"]), "edges": (t["edges"], ["edge_key"], ["metadata"]), "evidence": (t["evidence"], ["evidence_key"], ["path"])})
    status = "failed" if errors else "complete"
    counts = {name: df.count() for name, df in t.items()}
    row = spark.createDataFrame([(graph_id, run_id, status, digest, counts)], "graph_id string, run_id bigint, status string, digest string, counts map<string,bigint>")
    row.write.mode("append").parquet(f"{folder.rstrip('/')}/runs")
    if errors:
        raise IntegrityError(f"run {run_id} has missing references or errors")
    return {"run_id": run_id, "status": status, "digest": digest, "counts": counts}


def _known_runs(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/runs")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def published(spark: SparkSession, folder: str, run_id: int, graph_id: str = "graph") -> bool:
    """Whether the run is complete."""
    runs = _known_runs(spark, folder)
    return runs is not None and runs.where((F.col("graph_id") == graph_id) & (F.col("run_id") == run_id) & (F.col("status") == "complete")).limit(1).count() > 0


def staged(folder: str, run_id: int, name: str, df: DataFrame, graph_id: str = "graph") -> DataFrame:
    """df written under the folder of staged tables and read again, so that what follows doesn't make it anew. A published run is refused first."""
    spark = df.sparkSession
    if published(spark, folder, run_id, graph_id):
        raise IntegrityError(f"run {run_id} of {graph_id} is published already")
    path = f"{folder.rstrip('/')}/staged/run={run_id}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def accepted(spark: SparkSession, folder: str, graph_id: str = "graph") -> int | None:
    """The newest complete run."""
    return spark.read.parquet(f"{folder.rstrip('/')}/runs").where((F.col("graph_id") == graph_id) & (F.col("status") == "complete")).agg(F.max("run_id")).first()[0]


def load(spark: SparkSession, folder: str, run_id: int) -> dict[str, DataFrame]:
    base, out = f"{folder.rstrip('/')}/run={run_id}", {}
    for name in (*FAMILIES, "diagnostics"):
        try:
            out[name] = spark.read.parquet(f"{base}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def purge(spark: SparkSession, folder: str, keep: int = 1, graph_id: str = "graph", dry_run: bool = True) -> list[int]:
    """Runs older than the newest `keep` complete ones; their tables are deleted unless it is a dry run. The runs' rows stay."""
    runs = spark.read.parquet(f"{folder.rstrip('/')}/runs").where((F.col("graph_id") == graph_id) & (F.col("status") == "complete"))
    done = sorted((r[0] for r in runs.select("run_id").distinct().collect()), reverse=True)  # one number for each run
    old = done[keep:]
    if not dry_run:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for run in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run={run}")
            path.getFileSystem(conf).delete(path, True)
    return old


def export_bundle(folder_to: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, int]:
    """A portable bundle: each family as sorted JSON lines in its folder, and a manifest with their counts."""
    counts = {}
    for name, df in tables.items():
        rows = df.orderBy(*keys[name]).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
        rows.write.mode("overwrite").text(f"{folder_to}/{name}")
        counts[name] = df.count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(counts.items()), "family string, records bigint").coalesce(1).write.mode("overwrite").json(f"{folder_to}/manifest")
    return counts


def latest_receipt(runs: DataFrame, receipts: list[str]) -> DataFrame:
    """The newest complete run with all receipt columns."""
    full = runs.where("status = 'complete'")
    for c in receipts:
        full = full.where(F.col(c).isNotNull())
    return full.orderBy(F.desc("run_id")).limit(1)


class LexicalStore:
    """Lexical generations under a folder: chunks are written, then a state row makes them readable; states only ever get newer."""

    STATES = ("building", "published", "revoked", "invalidated")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _state(self, generation: str, state: str, reason: str | None = None) -> None:
        row = self.spark.createDataFrame([(generation, state, reason)], "generation string, state string, reason string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/states")

    def build(self, generation: str, chunks: DataFrame) -> int:
        self._state(generation, "building")
        chunks.write.mode("overwrite").parquet(f"{self.folder}/chunks/{generation}")
        self._state(generation, "published")
        return self.chunks(generation).count()

    def state(self, generation: str) -> str | None:
        rows = self.spark.read.parquet(f"{self.folder}/states").where(F.col("generation") == generation)
        return rows.agg(F.max_by("state", "at")).first()[0]

    def chunks(self, generation: str) -> DataFrame:
        if (state := self.state(generation)) != "published":
            raise IntegrityError(f"generation {generation} is {state}")
        return self.spark.read.parquet(f"{self.folder}/chunks/{generation}")

    def revoke(self, generation: str, reason: str, dry_run: bool = False) -> int:
        n = self.chunks(generation).count()
        if not dry_run:
            self._state(generation, "revoked", reason)
        return n
