"""Best-two-fit packing of token sequences.

Only lengths matter to the fill, and there are at most `capacity` different ones. So the plan is made on counts per length (a table
of at most `capacity` rows, whatever the corpus), as patterns with a multiplicity, and pieces take their places by rank among pieces of
their length. Ranks come from counts per (length, group) and small windows within a group, so no key gathers in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, text_ids
from .common import durable, free_name, packed_rest, small_batches, unpacked

CAPACITY = 2048
GROUP_ROWS = 20_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, in order) and how many bins follow each, by best-two-fit.

    A bin is filled greedily with the longest lengths that fit. Then its smallest length goes back if two lengths left over fill the
    gap that this leaves more tightly. A pattern is used as often as its lengths last, so patterns are about as many as lengths.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return out
        taken: dict[int, int] = {}
        gap = capacity
        while True:
            k = int(np.searchsorted(sizes, gap, side="right")) - 1
            while k >= 0 and left[sizes[k]] <= taken.get(int(sizes[k]), 0):
                k -= 1
            if k < 0:
                break
            size = int(sizes[k])
            n = int(min(gap // size, left[size] - taken.get(size, 0))) if size * 2 <= gap else 1
            taken[size] = taken.get(size, 0) + n
            gap -= n * size
        if gap and sum(taken.values()) > 1:
            smallest = min(taken)
            room = gap + smallest
            free = left.copy()
            for size, n in taken.items():
                free[size] -= n
            free[smallest] = free[smallest] + 1  # it may be one of the two
            small = np.flatnonzero(free[: room + 1])
            if len(small):
                # The best partner b <= a of each a: the longest b with a + b <= room.
                at = np.searchsorted(small, np.minimum(room - small, small), side="right") - 1
                lone = (at >= 0) & (small[at] == small) & (free[small] < 2)
                at = np.where(lone, at - 1, at)
                total = np.where(at >= 0, small + small[at], 0)
                k = int(np.argmax(total))
                if total[k] > smallest:
                    taken[smallest] -= 1
                    for size in (int(small[k]), int(small[at[k]])):
                        taken[size] = taken.get(size, 0) + 1
        taken = {s: n for s, n in taken.items() if n}
        times = min(int(left[s]) // n for s, n in taken.items())
        out.append(([s for s in sorted(taken, reverse=True) for _ in range(taken[s])], times))
        for s, n in taken.items():
            left[s] -= n * times


def _places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset): pieces of a length, by rank, to their places."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            rank = seen.get(size, 0)
            out.append((size, rank, rank + times, sequence, offset))
            seen[size] = rank + times
            offset += size
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add sequence_id and offset (long): where each row goes among sequences of at most `capacity`.

    Each sequence's rows lie one after another from offset 0. Lengths are from 1 to `capacity`; a row with another or a null length
    has nulls. Repeated rows are packed each. An empty table gives an empty table. Columns named sequence_id or offset are replaced.
    Rows are first cut durably, as their ranks must not change when a task runs again. To the driver goes one count for each length.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    length = F.col("`" + length_col.replace("`", "``") + "`")
    base = durable(pieces.select(packed_rest(names).alias("rest"), length.alias("_size"), F.monotonically_increasing_id().alias("_row")))
    good = F.col("_size").between(1, capacity)
    total = base.where(good).count()
    groups = max(1, -(-total // group_rows))
    keyed = base.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    per = keyed.where("_good").groupBy(F.col("_size").alias("_len"), "_group").agg(F.count(F.lit(1)).alias("_n"))
    per = durable(per)
    counts = {int(r["_len"]): int(r["n"]) for r in per.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    sizes = np.array([p[0] for p in places], dtype=np.int64)
    order = np.lexsort((np.array([p[1] for p in places], dtype=np.int64), sizes)) if places else np.zeros(0, np.int64)
    table = np.array(places, dtype=np.int64).reshape(-1, 5)[order]
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # about as many rows as lengths and patterns: it doesn't grow with the corpus

    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("_len").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.select("_group", "_len", F.coalesce("_before", F.lit(0)).cast("long").alias("_start"))
    ranked = keyed.withColumn("_len", F.when(F.col("_good"), F.col("_size"))).withColumn("_rank", F.row_number().over(Window.partitionBy("_group", "_len").orderBy("_row")) - 1)
    ranked = ranked.join(starts, ["_group", "_len"], "left").withColumn("_rank", F.col("_rank") + F.col("_start"))  # null where the length is odd

    @F.pandas_udf("struct<s:long,o:long>")
    def place(size, rank):
        import pandas as pd

        t = shared.value
        ok = rank.notna().to_numpy()
        out = pd.DataFrame({"s": pd.array([None] * len(size), dtype="Int64"), "o": pd.array([None] * len(size), dtype="Int64")})
        if ok.any():
            s, r = size[ok].to_numpy(np.int64), rank[ok].to_numpy(np.int64)
            span = int(t[:, 2].max()) + 1
            k = np.searchsorted(t[:, 0] * span + t[:, 1], s * span + r, side="right") - 1
            out.loc[ok, "s"] = t[k, 3] + r - t[k, 1]
            out.loc[ok, "o"] = t[k, 4]
        return out

    placed = ranked.withColumn("_at", place(F.col("_size").cast("long"), F.col("_rank").cast("long")))
    return placed.select(*unpacked("rest", names), F.col("_at.s").alias("sequence_id"), F.col("_at.o").alias("offset"))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def token_pieces(df: DataFrame, vocabulary: bytes, text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece with the other columns of df and piece, start, length, ids_crc32 and, on demand, ids (binary, little-endian).

    A document's ids end with end_id; null and empty texts have just that. Each of several equal rows has its pieces; an empty table has
    none. Columns with these names are replaced, and text_col goes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = _parse_datatype_string("piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    new = {f.name for f in added}
    keep = [f for f in df.schema.fields if f.name.lower() not in new and f.name.lower() != text_col.lower()]
    schema = StructType(keep + added.fields)
    arrow = to_arrow_schema(added)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            at, rows = [], []
            for k, ids in enumerate(text_ids(batch.column(len(keep)), enc, reuse=False)):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(k)
                    rows.append((piece, start, length, zlib.crc32(part), part)[: len(arrow)])
            index = pa.array(at, type=pa.int64())
            cols = [batch.column(i).take(index) for i in range(len(keep))]
            cols += [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    q = lambda n: df["`" + n.replace("`", "``") + "`"]
    return df.select(*[q(f.name) for f in keep], q(text_col).alias(free_name("_text", df.columns))).mapInArrow(run, schema)


def pack_documents(df: DataFrame, vocabulary: bytes, text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack documents: the rows of token_pieces with sequence_id and offset. With ids, pieces are cut durably as well."""
    return pack_pieces(token_pieces(df, vocabulary, text_col, capacity, end_id, with_ids), "length", capacity)
