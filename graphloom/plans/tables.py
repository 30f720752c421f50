"""The star schema, events and documents as graph tables: projections only, so filters and columns reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import edge_key, identity_hash


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (table, key column, name column, kind)
NODE_TABLES = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
#: (table, source kind, source column, edge kind, target kind, target column)
EDGE_TABLES = (
    ("nation", "nation", "n_nationkey", "contains", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "references", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "references", "nation", "s_nationkey"), ("orders", "orders", "o_orderkey", "references", "customer", "o_custkey"),
)


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, key, name in NODE_TABLES:
        rows = read(spark, sf_dir, table).select(F.concat(F.lit(table + ":"), F.col(key).cast("string")).alias("canonical_key"), F.lit(table).alias("kind"), F.col(name).alias("display_name"))
        out = rows if out is None else out.union(rows)
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")), F.lit("orders"), F.col("o_orderpriority"))
    return out.union(orders)


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, source, s, kind, target, t in EDGE_TABLES:
        rows = read(spark, sf_dir, table).select(F.concat(F.lit(source + ":"), F.col(s).cast("string")).alias("source_canonical_key"), F.lit(kind).alias("edge_kind"), F.concat(F.lit(target + ":"), F.col(t).cast("string")).alias("target_canonical_key"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("identity_metadata_hash", identity_hash(F.lit("{}")))


def with_edge_keys(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_key", edge_key(F.col("source_canonical_key"), F.col("edge_kind"), F.col("target_canonical_key"), F.lit("{}")))


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is evidence, at lines of its order's file, that the order contains the part."""
    li = read(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    start = (F.col("l_linenumber") * 10).cast("int")
    return li.select(
        F.concat(F.lit("evidence:"), text("l_orderkey"), F.lit(":"), text("l_linenumber"), F.lit(":"), text("l_partkey"), F.lit(":"), text("l_suppkey")).alias("evidence_key"),
        F.concat(F.lit("orders/"), text("l_orderkey")).alias("path"), start.alias("ev_start"), (start + F.col("l_quantity").cast("int") % 15).alias("ev_end"), F.lower("l_returnflag").alias("raw_kind"),
        F.concat(F.lit("orders:"), text("l_orderkey")).alias("order_key"), F.concat(F.lit("part:"), text("l_partkey")).alias("part_key"), (F.year("l_shipdate") - 1990).cast("long").alias("run_id"),
    )


#: Observation kinds of event types.
EVENT_KINDS = {"click": "shell.command", "view": "python.import", "error": "shell.host_mutation", "signup": "python.module", "purchase": "python.function"}
TOOLS = ("apt", "brew", "pip", "systemctl")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations, ordinals by event id, a run for each week."""
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    metadata = F.concat(F.lit('{"category":"c'), (k % 3).cast("string"), F.lit('","k":'), k.cast("string"), F.lit(',"privileged":"'), F.when(k % 2 == 0, "yes").otherwise("off"), F.lit('","tool":"'), F.get(F.array(*[F.lit(t) for t in TOOLS]), k % 4), F.lit('"}'))
    return e.select(
        (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("long").alias("run_id"), F.col("event_id").alias("ordinal"), F.lit(1).alias("schema_version"), kind.alias("kind"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.lit("extracted").alias("confidence"), F.lit("events").alias("extractor"), F.lit("1").alias("extractor_version"),
        (k + 1).alias("start_line"), (k + 1).alias("end_line"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.lit("lib"), (k % 7).cast("string")).alias("target"), metadata.alias("metadata"),
    )


#: Endings that stand for a repository's files, by doc_id modulo their number.
ENDINGS = (".py", ".md", "_test.go", ".tf", "/Makefile", ".tar.gz", ".JSON", ".zsh", "/requirements-dev.txt", "/go.mod", "/generated/x.rb", ".test.js")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository: path and text."""
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % len(ENDINGS)).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/d"), F.col("doc_id").cast("string"), ending).alias("path"), "text", "lang")
