"""A repository as a table of files, and its generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify


def discover(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), profile: dict | None = None) -> DataFrame:
    """Files below root with path, language, role, content_hash, executable, generated, confidence and content.

    Spark lists and reads the files, so root may lie in any store that it reads. Stores without modes have no executable files.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", r"^[a-z]+:/{1,3}(?=/)", "")
    tail = base.split("://")[-1].strip("/")
    path = F.substr(plain, F.instr(plain, tail) + len(tail) + 1)
    files = raw.select(path.alias("path"), "content", "length").where(~classify.excluded(F.col("path"), excludes))
    # The text before the first line feed: only #! lines decide, so bytes that aren't text do no harm.
    first = F.substring_index(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), "\n", 1)
    p = profile or {}
    generated = classify.generated(F.col("path")) | ((classify.extension(F.col("path")) == "go") & F.decode(F.substring("content", 1, 4000), "ISO-8859-1").rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$"))
    for d in p.get("generated_dirs", ()):
        generated = generated | classify.under(F.col("path"), d)
    executable = first.startswith("#!")
    files = files.withColumn("language", classify.language(F.col("path"), first)).withColumn("generated", generated).withColumn("executable", executable)
    role = classify.profiled_role(F.col("path"), classify.role(F.col("path"), F.col("executable"), F.col("generated")), p.get("roles"), p.get("generated_dirs", ()), p.get("command_dirs", ()), p.get("script_dirs", ()))
    return files.select("path", "language", role.alias("role"), F.sha2("content", 256).alias("content_hash"), "executable", "generated", F.when(F.col("path").isin(*p.get("roles", {"": ""})), "manual").otherwise("extracted").alias("confidence"), "content")


def filtered(files: DataFrame, role: str | None = None, language: str | None = None, generated: str = "include") -> DataFrame:
    """Files of a role and a language; generated ones included, excluded or alone."""
    out = files if role is None else files.where(F.col("role") == role)
    out = out if language is None else out.where(F.col("language") == language)
    if generated not in ("include", "exclude", "only"):
        raise ValueError(f"unknown filter {generated!r}")
    return out if generated == "include" else out.where(F.col("generated") == (generated == "only"))


def entrypoints(files: DataFrame) -> DataFrame:
    return files.where("role = 'entrypoint'").orderBy("path")


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit("file").alias("entry_type"), "content_hash")


def source_generation(files: DataFrame) -> str:
    """A digest of paths and contents. Each of 4096 buckets of paths is hashed on its own, so the driver hashes at most so many digests."""
    bucket = F.pmod(F.xxhash64("path"), F.lit(4096))
    line = F.concat_ws("\x00", "path", F.lit("file"), "content_hash")
    parts = files.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n").cast("binary"), 256).alias("h"))
    from ..functions.keys import digest_of

    return digest_of("sg1", [[r["b"], r["h"]] for r in sorted(parts.collect())])
