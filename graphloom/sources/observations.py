"""Observations as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OBS


def read_observations(spark: SparkSession, path: str, run_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(observations, malformed lines with their text): blank lines are skipped; ordinals follow file and place."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    fields = "schema_version int, kind string, source_id string, path string, confidence string, extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string, _bad string"
    parsed = lines.withColumn("o", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("o._bad is null and o.kind is not null")
    names = [c.strip().split()[0] for c in OBS.split(",")]
    out = good.select(F.lit(run_id).cast("bigint").alias("run_id"), F.col("_at").alias("ordinal"), "o.*").withColumn("schema_version", F.coalesce("schema_version", F.lit(1))).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    return out.select(*names), parsed.where("o._bad is not null or o.kind is null").select(F.col("_at").alias("line"), "value")


def write_observations(observations: DataFrame, path: str) -> None:
    """JSON lines with sorted names; metadata as an object."""
    names = sorted(c for c in observations.columns if c not in ("metadata", "run_id", "ordinal", "payload_hash"))
    head = F.to_json(F.struct(*names))
    meta = F.concat(F.lit('"metadata":'), F.coalesce("metadata", F.lit("{}")))
    observations.select(F.concat(F.lit("{"), meta, F.lit(","), F.substr(head, F.lit(2))).alias("value")).write.mode("overwrite").text(path)
