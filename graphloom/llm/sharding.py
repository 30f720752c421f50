"""Sharding by sampled splitters: range-partition by key with splitters drawn by size, and subdivide overfull ranges. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, packed_rest, unpacked

PARAMETERS = {
    "ranges": 2000,  # ranges aimed at, at least; more rows make more
    "range_rows": 200_000,  # rows aimed at in a range
    "most_ranges": 250_000,  # ranges of larger inputs hold more rows, and are divided
    "per_range": 50,  # records drawn for each range's splitter, about
    "coarse_sample": 20_000,  # of these, those that give the splitters of the upper level, about
    "slack": 2.0,  # a range of more than slack times the mean bytes, or rows, is overfull
    "large": 50,  # a record of more than one part in so many of a shard's mean is large, and is dealt first
    "splitter_bytes": 64 << 20,  # the table of splitters is broadcast; where long keys make it larger, every second, third, ... stays
}


def shard_by_size(df: DataFrame, key_col: str, size_col: str, shards: int = 40, **parameters) -> DataFrame:
    """Add shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard), the sums of size_col nearly equal.

    1. Large records (fewer than shards * `large`, whatever the input) go to the least full shard, the largest first. 2. Of the others a
    sample, drawn with a chance that grows with size, gives splitters at equal steps of size in the order of the key (any orderable
    type), in two levels; every record goes to its range. 3. Ranges of more than `slack` times the mean size or rows are divided by a
    record's place, so equal keys and repeated rows come apart, whatever number one key has. 4. Ranges are dealt to shards in the order
    of keys, where the running size says, up to the room that large records leave; so but for large records a shard is a run of
    ranges (a divided range that holds a shard's end is parted there by place), and its bytes differ from the mean by less than a record
    that is not large. Null keys are one key, the first; null, zero or negative
    sizes count 0. Records of equal text or key are records like others and may lie in several shards. Columns named shard or slot are
    replaced, all others stay. An empty table gives an empty one.

    Records are cut durably first (keep the columns few). The driver gets the large records' sizes and a sum for each range of the upper
    level, of which there are as many as the root of the ranges. The splitters are a table of as many arrays, broadcast within splitter_bytes.
    """
    p, spark = PARAMETERS | parameters, df.sparkSession
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    size = F.greatest(F.coalesce(quoted(size_col).cast("long"), F.lit(0)), F.lit(0))
    base = durable(df.select(packed_rest(names).alias("rest"), quoted(key_col).alias("key"), size.alias("size"), F.monotonically_increasing_id().alias("row")))
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return base.select(*unpacked("rest", names), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    # Large records first. Each is more than one part in shards * large of all bytes, so they are fewer than that.
    is_large = F.col("size") * F.lit(shards * p["large"]) > F.lit(total)
    found = sorted(((r["size"], r["row"]) for r in base.where(is_large).select("size", "row").collect()), key=lambda r: (-r[0], r[1]))
    load, held, dealt = [0] * shards, [0] * shards, []
    for own, row in found:
        s = min(range(shards), key=lambda i: (load[i], held[i], i))
        dealt.append({"row": row, "shard": s, "slot": held[s]})
        load[s] += own
        held[s] += 1
    room = _room(load, total)
    large = base.join(F.broadcast(_table(spark, dealt, "row bigint, shard int, slot bigint")), "row").select("rest", "shard", "slot") if dealt else None
    rest = base.where(~is_large)
    n, weight = rows - len(found), total - sum(load)
    if not n:
        return large.select(*unpacked("rest", names), "shard", "slot")

    # Splitters in two levels; all but the counts stays in tables.
    ranges = min(max(p["ranges"], -(-n // p["range_rows"])), p["most_ranges"])
    upper = max(2, math.isqrt(ranges))
    lower = max(2, -(-ranges // upper))
    ranged = _in_ranges(rest, upper, lower, n, weight, p)

    # Overfull ranges are divided; the pieces of a range follow each other.
    sums = ranged.groupBy("coarse", "fine").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    over = lambda c, mean: F.ceil(F.col(c) / F.lit(p["slack"] * max(1, mean) / (upper * lower)))
    sums = durable(sums.select("coarse", "fine", F.greatest(over("bytes", weight), over("n", n), F.lit(1)).cast("int").alias("pieces")))
    divided = ranged.join(sums, ["coarse", "fine"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces")

    # The running size over pieces, and over the records of a piece, gives the shard.
    piece = durable(divided.groupBy("coarse", "fine", "piece").agg(F.sum("size").alias("bytes")))
    start, run = [], 0
    for c, b in sorted(map(tuple, piece.groupBy("coarse").agg(F.sum("bytes")).collect())):  # one row for each range of the upper level
        start.append({"coarse": c, "start": run})
        run += b
    before = Window.partitionBy("coarse").orderBy("fine", "piece").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("inner", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(F.broadcast(_table(spark, start, "coarse int, start bigint")), "coarse")
    piece = piece.select("coarse", "fine", "piece", (F.col("start") + F.col("inner")).alias("start"))
    in_piece = Window.partitionBy("coarse", "fine", "piece").orderBy("key", "row")
    placed = divided.join(piece, ["coarse", "fine", "piece"]).withColumn("run", F.col("start") + F.sum("size").over(in_piece) - F.col("size"))
    if weight:
        ends = F.array(*[F.lit(sum(room[: s + 1])).cast("double") for s in range(shards - 1)]) if shards > 1 else F.array().cast("array<double>")
        shard = _below(ends, F.col("run") + F.col("size") / 2, shards - 1)
    else:
        shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    placed = placed.withColumn("shard", shard)

    # Slots: large records of the shard, rows of it before this piece, and before this record within its piece.
    placed = placed.withColumn("in", F.row_number().over(Window.partitionBy("coarse", "fine", "piece", "shard").orderBy("key", "row")) - 1)
    counts = durable(placed.groupBy("shard", "coarse", "fine", "piece").agg(F.count(F.lit(1)).alias("n")))
    offset, seen = [], list(held)
    for s, c, m in sorted(map(tuple, counts.groupBy("shard", "coarse").agg(F.sum("n")).collect())):  # as many rows as upper ranges and shards
        offset.append({"shard": s, "coarse": c, "offset": seen[s]})
        seen[s] += m
    ahead = Window.partitionBy("shard", "coarse").orderBy("fine", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(F.broadcast(_table(spark, offset, "shard int, coarse int, offset bigint")), ["shard", "coarse"])
    out = placed.join(counts, ["coarse", "fine", "piece", "shard"]).select("rest", "shard", (F.col("offset") + F.col("ahead") + F.col("in")).cast("long").alias("slot"))
    out = out if large is None else out.union(large)
    return out.select(*unpacked("rest", names), "shard", "slot")


def _in_ranges(rest: DataFrame, upper: int, lower: int, n: int, weight: int, p: dict) -> DataFrame:
    """rest with coarse and fine (int): the range of the key among upper * lower ranges of nearly equal size, in the order of keys."""
    unit = (weight + n) / (p["per_range"] * upper * lower)  # each drawn record stands for so much
    share = (F.col("size") + 1) / F.lit(unit)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "row"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rest.where(draw < share).select("key", "row", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(share)).cast("int"))))
    few = F.pmod(F.xxhash64(F.lit("upper"), "row", "col"), F.lit(1 << 30)) / float(1 << 30) < p["coarse_sample"] / (p["per_range"] * upper * lower)
    steps = lambda keys, k: F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.get(keys, F.floor(i * F.size(keys) / F.lit(k)).cast("int")))
    kept = lambda keys, k: F.when(F.size(keys) > 0, steps(keys, k))
    top = durable(drawn.where(few).agg(F.sort_array(F.collect_list("key")).alias("keys")).select(kept(F.col("keys"), upper).alias("top")))  # one row; nulls don't enter, and lie before all
    fine = drawn.join(F.broadcast(top)).select("key", _below(F.col("top"), F.col("key"), upper - 1).alias("coarse"))
    fine = durable(fine.groupBy("coarse").agg(F.sort_array(F.collect_list("key")).alias("keys")).select("coarse", kept(F.col("keys"), lower).alias("low")))  # about coarse_sample / upper * lower keys a row
    length = fine.agg(F.coalesce(F.sum(F.octet_length(F.to_json("low"))), F.lit(0))).first()[0]
    each = -(-length // p["splitter_bytes"])
    if each > 1:
        fine = fine.withColumn("low", F.filter("low", lambda x, i: i % each == 0))
    at = rest.join(F.broadcast(top)).withColumn("coarse", _below(F.col("top"), F.col("key"), upper - 1)).drop("top").join(F.broadcast(fine), "coarse", "left")
    return at.withColumn("fine", _below(F.col("low"), F.col("key"), lower - 1)).drop("low")


def _room(load: list[int], total: int) -> list[float]:
    """What each shard takes besides its load, so that shards are as equal as can be: total in all."""
    low, high = 0.0, float(total)
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0.0, level - x) for x in load) < total - sum(load) else (low, level)
    return [max(0.0, high - x) for x in load]


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(':'.join(f.split()) for f in schema.split(','))}>>")))


def _below(sorted_array: Column, value: Column, n: int) -> Column:
    """How many entries of a sorted array of up to n are at most value, by bisection (array functions read no further). 0 for null."""
    steps = []
    while 2 ** len(steps) <= n:
        steps.insert(0, 2 ** len(steps))
    if not steps:
        return F.lit(0)
    probe = lambda at, step: F.when((at + step <= F.size(sorted_array)) & (F.get(sorted_array, at + step - 1) <= value), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), probe)
