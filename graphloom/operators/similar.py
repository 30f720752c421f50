"""Vector similarity: validated unit vectors, exact cosine, nearest k with a total order."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def valid_vector(a: Column, dimensions: int, tolerance: float = 1e-5) -> Column:
    """Of the right length, finite, of unit length within the tolerance."""
    return F.coalesce((F.size(a) == dimensions) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def nearest(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude: Column | None = None) -> DataFrame:
    """The k rows nearest to a query vector by cosine distance, rounded to 8 places; ties go to the smaller id. A top-k, kept per task."""
    scored = vectors.withColumn("distance", F.round(1 - cosine(F.col(vector_col), query), 8))
    scored = scored if exclude is None else scored.where(~exclude)
    return scored.orderBy("distance", id_col).limit(k)


#: Values of a block of vectors, and rows of a block of vectors, of a block of seeds, and of the tiles in which the two meet.
BLOCK_VALUES, BLOCK_ROWS, SEED_ROWS, TILE_ROWS, TILE_SEEDS = 1 << 22, 1 << 16, 1 << 13, 1 << 13, 1 << 8


def nearest_each(vectors: DataFrame, seeds: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """seed, id_col, distance: for each seed the k other rows nearest to it by distance, rounded to 8 places, and id.

    All pairs are compared: blocks of vectors meet blocks of seeds, one pair of blocks in a task's memory at a time, in matrix products. What these
    leave within a margin of the k-th is compared as dot() does, so distances are those of cosine(). Distances of vectors with no direction are NaN, of
    missing ones and of other lengths null; they follow the others, in this order, as in SQL.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    element = lambda df: df.schema[vector_col].dataType.elementType.simpleString()
    vec = lambda df: F.col(vector_col) if element(df) in ("float", "double") else F.col(vector_col).cast("array<double>")
    known = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), vec(vectors).alias("_vec"))
    asked = seeds.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), vec(seeds).alias("_vec"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("dim")).first()
    per_block = max(1, min(block_rows, BLOCK_VALUES // max(size["dim"] or 1, 1)))
    seed_blocks = max(1, -(-asked.count() // min(seed_rows, per_block)))
    # Blocks: as many as the rows ask for, or as many as keep the cluster's cores at work, if none gets fewer than a quarter of a tile.
    blocks = max(1, -(-size["n"] // per_block), min(size["n"] * 4 // TILE_ROWS, vectors.sparkSession.sparkContext.defaultParallelism // seed_blocks))
    place = lambda n: F.pmod(F.xxhash64("_id", "_vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select(place(blocks).alias("_block"), every(seed_blocks).alias("_asked"), "_id", "_vec")
    right = asked.select(every(blocks).alias("_block"), place(seed_blocks).alias("_asked"), "_id", "_vec")
    schema = f"seed {kind}, `{id_col}` {kind}, distance double"
    best = left.groupBy("_block", "_asked").cogroup(right.groupBy("_block", "_asked")).applyInArrow(lambda a, b: _nearest_in_block(a, b, k, id_col), schema)
    return best.withColumn("_rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("distance").asc_nulls_last(), id_col))).where(F.col("_rank") <= k).drop("_rank")


def _nearest_in_block(rows: pa.Table, seeds: pa.Table, k: int, id_col: str) -> pa.Table:
    """The k rows of a block nearest to each seed of a block: numbers first, then NaN, then null, each by id."""
    rows = rows.take(pc.sort_indices(rows.column("_id")))  # from here on places stand for ids
    n = len(rows)
    code = pa.chunked_array([*rows.column("_id").chunks, *seeds.column("_id").chunks], type=rows.schema.field("_id").type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    own, asked = code[:n], code[n:]
    vec, length = _lists(rows.column("_vec"))
    seed_vec, seed_length = _lists(seeds.column("_vec"))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []  # seeds, places, distances, whether these are null

    def fill(seed: int, places: np.ndarray, room: int, value: float, null: bool) -> int:
        places = places[: room + np.count_nonzero(own[places] == asked[seed])] if room > 0 else places[:0]
        places = places[own[places] != asked[seed]][:room]
        if len(places):
            found.append((np.full(len(places), seed), places, np.full(len(places), value), null))
        return room - len(places)

    for dim in np.unique(seed_length):
        those = np.flatnonzero(seed_length == dim)
        same = np.flatnonzero(length == dim) if dim >= 0 else np.zeros(0, np.int64)
        other = np.flatnonzero(length != dim) if dim >= 0 else np.arange(n)
        room = dict.fromkeys(those.tolist(), k)
        if dim >= 0 and len(same):
            x, q = _matrix(vec, same, dim), _matrix(seed_vec, those, dim)
            x_norm, q_norm = _norms(x), _norms(q)
            x_good, q_good = np.isfinite(x_norm) & (x_norm > 0), np.isfinite(q_norm) & (q_norm > 0)
            at, ask = np.flatnonzero(x_good), np.flatnonzero(q_good)
            at = at[_first_copies(x[at], k + 1)]
            for s, p, d in _nearest_tiles(x[at], x_norm[at], own[same[at]], q[ask], q_norm[ask], asked[those[ask]], k):
                found.append((those[ask[s]], same[at[p]], d, False))
                for seed, held in zip(*np.unique(those[ask[s]], return_counts=True), strict=True):
                    room[int(seed)] -= int(held)
            for i, seed in enumerate(those.tolist()):
                if room[seed]:
                    room[seed] = fill(seed, same[~x_good] if q_good[i] else same, room[seed], np.nan, False)
        for seed in those.tolist():
            if room[seed]:
                fill(seed, other, room[seed], 0.0, True)
    joined = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
    null = np.concatenate([np.full(len(f[0]), f[3]) for f in found]) if found else np.zeros(0, bool)
    return pa.table({"seed": seeds.column("_id").take(pa.array(joined(0, np.int64))), id_col: rows.column("_id").take(pa.array(joined(1, np.int64))), "distance": pa.array(joined(2, np.float64), mask=null)})


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Lists and their lengths, -1 where a list or one of its values is missing."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    if values.null_count:
        length[pc.list_parent_indices(lists).filter(pc.is_null(values)).to_numpy(zero_copy_only=False)] = -1
    return lists, length


def _matrix(lists: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def _norms(x: np.ndarray) -> np.ndarray:
    """As norm(): squares are added one after the other."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            total += x[:, j] * x[:, j]
    return np.sqrt(total)


def _first_copies(x: np.ndarray, most: int) -> np.ndarray:
    """Places of the first copies of each row, as many as a seed can need: equal vectors are equally far from every seed."""
    if not len(x) or not x.shape[1]:
        return np.arange(len(x))
    h = np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel()
    _, group = np.unique(h, return_inverse=True)
    order = np.argsort(group, kind="stable")
    count = np.bincount(group)
    place = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(order[place < most])


def _rounded(d: np.ndarray) -> np.ndarray:
    """Distances in units of 1e-8, rounded as Spark does: half up, of the shortest decimal."""
    q = d * 1e8 + 0.5
    out = np.floor(q).astype(np.int64)
    for i in np.flatnonzero(np.abs(q - np.rint(q)) < 1e-6):
        out[i] = int(Decimal(repr(float(d[i]))).scaleb(8).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _nearest_tiles(x, x_norm, own, q, q_norm, asked, k):
    """For tiles of seeds: (seeds, places, distances) of the k nearest rows of each, ties to the smaller place, itself left out."""
    if not len(x) or not len(q) or k < 1:
        return
    unit_x = x / x_norm[:, None]
    by_code = np.argsort(own, kind="stable")
    for lo in range(0, len(q), TILE_SEEDS):
        part, n = slice(lo, lo + TILE_SEEDS), len(q[lo : lo + TILE_SEEDS])
        unit_q, columns = q[part] / q_norm[part, None], np.ascontiguousarray(q[part].T)
        begin, end = np.searchsorted(own, asked[part], "left", by_code), np.searchsorted(own, asked[part], "right", by_code)
        self_row = np.repeat(np.arange(n), end - begin)
        self_at = by_code[np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])] if len(self_row) else np.zeros(0, np.int64)
        row, value, at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        worst = np.full(n, np.inf)
        for left in range(0, len(x), TILE_ROWS):
            tile = slice(left, left + TILE_ROWS)
            sims = unit_q @ unit_x[tile].T
            here = (self_at >= left) & (self_at < left + TILE_ROWS)
            sims[self_row[here], self_at[here] - left] = -np.inf
            width = sims.shape[1]
            low = 1 - worst - 1.1e-8  # half a unit of rounding on both sides, and the products' error
            if width > k and not np.isfinite(worst).all():
                low = np.maximum(low, np.partition(sims, width - k, axis=1)[:, width - k] - 1.1e-8)
            near, col = np.divmod(np.flatnonzero(sims >= np.maximum(low, -2)[:, None]), width)
            columns_x = np.ascontiguousarray(x[tile].T)
            units = []
            for a in range(0, len(near), 1 << 18):
                i, j = near[a : a + (1 << 18)], col[a : a + (1 << 18)]
                total = np.zeros(len(i))
                for c in range(x.shape[1]):
                    total += columns_x[c][j] * columns[c][i]
                units.append(_rounded(1 - total / (x_norm[left + j] * q_norm[lo + i])))
            row, value, at = np.concatenate([row, near]), np.concatenate([value, *units]), np.concatenate([at, col + left])
            order = np.lexsort((at, value, row))
            row, value, at = row[order], value[order], at[order]
            count = np.bincount(row, minlength=n)
            keep = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k
            row, value, at = row[keep], value[keep], at[keep]
            last = np.cumsum(np.minimum(count, k)) - 1
            worst = np.where(count >= k, value[np.maximum(last, 0)] / 1e8, np.inf) if len(value) else worst
        yield lo + row, at, value / 1e8


def similar_nodes(embeddings: DataFrame, seed_key: str, k: int, key_col: str = "canonical_key", vector_col: str = "embedding", in_scope: DataFrame | None = None) -> tuple[str, DataFrame | None]:
    """("ok", the k nodes nearest to a stored node's vector, itself left out), or a status where the seed isn't exactly one."""
    seed = [r[0] for r in embeddings.where(F.col(key_col) == seed_key).select(vector_col).limit(2).collect()]
    if len(seed) != 1:
        return ("seed_missing" if not seed else "seed_ambiguous"), None
    rows = embeddings if in_scope is None else embeddings.join(in_scope.select(key_col).distinct(), key_col, "left_semi")
    query = F.array(*[F.lit(float(x)) for x in seed[0]])
    return "ok", nearest(rows, query, k, key_col, vector_col, F.col(key_col) == seed_key)

MAX_IMPORT = 500


def import_embeddings(entries: DataFrame, dimensions: int, public_keys: DataFrame, key_col: str = "canonical_key", vector_col: str = "embedding") -> DataFrame:
    """An import's rows with a status: imported, private, bad_vector or duplicate; more than MAX_IMPORT rows are refused as a whole."""
    from pyspark.sql import Window

    if entries.limit(MAX_IMPORT + 1).count() > MAX_IMPORT:
        raise ValueError(f"an import has at most {MAX_IMPORT} rows")
    marked = entries.join(public_keys.select(key_col).distinct().withColumn("_public", F.lit(True)), key_col, "left")
    n = F.count(F.lit(1)).over(Window.partitionBy(key_col))
    status = F.when(F.col("_public").isNull(), "private").when(~valid_vector(F.col(vector_col), dimensions), "bad_vector").when(n > 1, "duplicate").otherwise("imported")
    return marked.withColumn("status", status).drop("_public")
