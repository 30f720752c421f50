"""N-gram Jaccard self-join: MinHash bands propose pairs, Bayesian pruning drops them as hashes are compared, exact sets verify.

Equal texts are one class from the start. Classes whose MinHash agrees on a band meet in a bucket. Large buckets that hold much the same
classes, as a group of near copies has in most bands, are merged to one group, so its classes are dealt out once and not once a band. A
group is split into blocks, and each pair of blocks is a tile of bounded size; within a tile pairs are only numbers in arrays. A tile
gives, for each class, the weight of its links and a spanning forest of them, so edges don't grow with the square of a group. Counting
every link of m near copies takes m^2 / 2 comparisons and, for the tiles, m^2 / BLOCK rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import _RNG, durable, mix, packed_rest, shingle_sets, small_batches, span_hashes, text_slices, unpacked, window_hashes, word_bounds
from .components import connected_components

WIDTH = 5  # words of a shingle
THRESHOLD = 0.8
ROWS, BANDS = 6, 40  # a pair at the threshold shares no band with a chance of 5e-6
HASHES = ROWS * BANDS
MISS = 6e-6  # the most of that chance for other thresholds
STEP = 24  # hashes compared at a time
TOLERANCE = 1e-9  # a pair is dropped when its chance to reach the threshold is less
BLOCK = 512  # classes of a block; a tile has two blocks at most, and a bucket of more classes is large
PAIRS = 1 << 17  # pairs compared at a time
MARK_BITS = 1 << 22  # size of the filter that says which texts are read again
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... compared hashes: the least number of matches with which a pair goes on.

    With a uniform prior the similarity after m matches of n has the distribution Beta(m + 1, n - m + 1), and the chance that it
    reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def bands_for(threshold: float = THRESHOLD) -> tuple[int, int]:
    """(rows, bands) of HASHES at most, of the most rows with which a pair at the threshold shares no band with a chance of MISS at most."""
    if threshold >= THRESHOLD:
        return ROWS, BANDS
    for rows in range(ROWS, 0, -1):
        if threshold > 0 and (1 - threshold**rows) ** (HASHES // rows) <= MISS:
            return rows, HASHES // rows
    raise ValueError(f"{HASHES} hashes miss pairs at a threshold of {threshold} with a chance above {MISS}")


def signatures(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (n, HASHES) of the texts, and which of them have a word at all."""
    n = len(offsets) - 1
    starts, ends, counts = word_bounds(buf, offsets)
    words = span_hashes(buf, starts, ends)
    h, _, per = window_hashes(words, counts, WIDTH)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):  # few and tiny: their single shingle is made as in shingle_sets
        pieces, first = [], np.concatenate([[0], np.cumsum(per)])
        small = set(short.tolist())
        for d in range(n):
            if d in small:
                pieces.append(shingle_sets(buf[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]]))[0])
            else:
                pieces.append(h[first[d] : first[d + 1]])
        h, per = np.concatenate(pieces), np.array([len(x) for x in pieces])
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(per)
    if len(full):
        seg = np.concatenate([[0], np.cumsum(per[full])[:-1]])
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(h * _MULTIPLY[k], seg) >> np.uint64(32)
    return out, counts > 0


def band_keys(sig: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band (n, bands); the band's number enters it."""
    x = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands].astype(np.uint64))
    return x.view(np.int64)


def _band_rows(batches, rows: int, bands: int):
    """(id, key, node, bands) of each text with a word: node is its key's first 64 bits. Columns in: id, key, text."""
    for batch in batches:
        keys = batch.column(1).to_pylist()
        for lo, _, buf, offsets in text_slices(batch.column(2)):
            sig, good = signatures(buf, offsets)
            at = np.flatnonzero(good)
            n, take = len(at), pa.array(at + lo)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band_keys(sig[at], rows, bands).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(_nodes([keys[lo + d] for d in at])), lists], names=["id", "key", "node", "bands"])


def _nodes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">i8")[::2].astype(np.int64)


class _Tiles:
    """Whole tiles out of batches sorted by tile: rows of a tile are kept until the next tile begins."""

    def __init__(self, most_rows: int = 4096):
        self.most = most_rows

    def __call__(self, batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.most:
                t = pa.Table.from_batches(held).combine_chunks()
                tile = t.column("tile").to_numpy()
                cut = int(np.flatnonzero(tile[1:] != tile[:-1])[-1]) + 1 if (tile[1:] != tile[:-1]).any() else 0
                if cut:
                    yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()


def _bounds(tile: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])


def _pairs(lo: int, hi: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile: all of one block (sides 0), or those across two (sides 1 and 2)."""
    n = hi - lo
    if side[lo:hi].any():
        a, b = lo + np.flatnonzero(side[lo:hi] == 1), lo + np.flatnonzero(side[lo:hi] == 2)
        return np.repeat(a, len(b)), np.tile(b, len(a))
    i, j = np.triu_indices(n, 1)
    return lo + i, lo + j


def _lists(column) -> np.ndarray:
    """Lists of numbers as a matrix; short ones end with their first number again, empty and null ones are all -1."""
    rows = [x or [-1] for x in column.to_pylist()]
    width = max(map(len, rows))
    return np.array([x + x[:1] * (width - len(x)) for x in rows], np.int64)


def _prune(batches, bars: list[int], rows_out: list[str], shape: tuple[int, int]):
    """For each class of a tile, the places in the tile of the classes that it may reach the threshold with, each pair once.

    A pair that shares groups belongs to the least of these, another pair to the first band that it shares.
    """
    for t in _Tiles()(batches):
        tile, side = t.column("tile").to_numpy(), t.column("side").to_numpy()
        band, group = t.column("band").to_numpy(), t.column("group").to_numpy()
        groups = _lists(t.column("groups"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        keys = band_keys(sig, *shape)
        bounds = _bounds(tile)
        found_i, found_j = [], []

        def own(i, j):
            """Which pairs belong to their tile."""
            out = np.ones(len(i), dtype=bool)
            grouped = np.flatnonzero((groups[i, 0] != -1) & (groups[j, 0] != -1))
            if len(grouped):
                a, b = groups[i[grouped]], groups[j[grouped]]
                least = np.full(len(grouped), np.iinfo(np.int64).max)
                for x in range(a.shape[1]):
                    for y in range(b.shape[1]):
                        least = np.where((a[:, x] == b[:, y]) & (a[:, x] < least), a[:, x], least)
                within = band[i[grouped]] < 0
                out[grouped] = np.where(within, least == group[i[grouped]], least == np.iinfo(np.int64).max)
            return out

        def compare(i, j):
            for lo in range(0, len(i), PAIRS):
                few(i[lo : lo + PAIRS], j[lo : lo + PAIRS])

        def few(i, j):
            mine = own(i, j)
            i, j = i[mine], j[mine]
            for k in range(0, int(band[i].max()) if len(i) else 0):
                new = (keys[i, k] != keys[j, k]) | (band[i] <= k)
                i, j = i[new], j[new]
            same = np.zeros(len(i), np.int32)
            for s, bar in enumerate(bars):
                if not len(i):
                    break
                cols = slice(s * STEP, (s + 1) * STEP)
                same += (sig[i, cols] == sig[j, cols]).sum(axis=1, dtype=np.int32)
                go = same >= bar
                i, j, same = i[go], j[go], same[go]
            found_i.append(i)
            found_j.append(j)

        ready, pending = 0, []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            pending.append(_pairs(int(lo), int(hi), side))
            ready += len(pending[-1][0])
            if ready >= PAIRS:
                compare(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]))
                ready, pending = 0, []
        if pending:
            compare(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]))
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
        if not len(i):
            continue
        first = np.repeat(bounds[:-1], np.diff(bounds))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        used = np.unique(np.concatenate([i, j]))
        lo, hi = np.searchsorted(i, used, "left"), np.searchsorted(i, used, "right")
        place = j - first[j]
        partners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]), pa.int32()), pa.array(np.concatenate([place[a:b] for a, b in zip(lo, hi, strict=True)]), pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(tile[used]), pa.array(used - first[used], pa.int32()), t.column("key").combine_chunks().take(pa.array(used)), partners], names=rows_out)


def _sets(batches, shared):
    """(node, key, sig, shingles) of the texts that the filter marks. Columns in: key, mark, text. A task gives a text once, or rarely more."""
    marks, seen = np.frombuffer(shared.value, np.uint8), set()
    for batch in batches:
        keys, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        pick = []
        for k in np.flatnonzero((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).tolist():
            if keys[k] not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(keys[k])
                pick.append(k)
        for lo, hi, buf, offsets in text_slices(batch.column(2).take(pa.array(pick, pa.int64()))):
            own = [keys[k] for k in pick[lo:hi]]
            sig, _ = signatures(buf, offsets)
            h, n = shingle_sets(buf, offsets)
            ends = np.cumsum(n)
            sets = [h[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(own)), pa.array(own, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(sets, pa.binary())], names=["node", "key", "sig", "shingles"])


def _verify(batches, threshold: float):
    """Of each tile: (key, null, weight of its links) for each linked class, and (key, other, 0) for a spanning forest."""
    for t in _Tiles(2048)(batches):
        tile, place, weight = t.column("tile").to_numpy(), t.column("place").to_numpy(), t.column("copies").to_numpy()
        keys, partners = t.column("key").to_pylist(), t.column("partners").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        out_a, out_b, out_w = [], [], []
        bounds = _bounds(tile)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            row_of = {int(p): r for r, p in enumerate(place[lo:hi], lo)}
            total, parent = dict.fromkeys(range(lo, hi), 0), list(range(lo, hi))

            def root(x):
                while parent[x - lo] != x:
                    parent[x - lo] = x = parent[parent[x - lo] - lo]
                return x

            for r in range(lo, hi):
                rows = [row_of[p] for p in partners[r]]
                if not rows:
                    continue
                mine = sets[r]
                n = np.array([len(sets[q]) for q in rows])
                every = np.concatenate([sets[q] for q in rows])
                at = np.searchsorted(mine, every)
                hit = mine[np.minimum(at, len(mine) - 1)] == every
                common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
                for q, c, m in zip(rows, common.tolist(), n.tolist(), strict=True):
                    if c >= threshold * (len(mine) + m - c) - 1e-9:
                        total[r] += int(weight[q])
                        total[q] += int(weight[r])
                        x, y = root(r), root(q)
                        if x != y:
                            parent[y - lo] = x
                            out_a.append(keys[r]), out_b.append(keys[q]), out_w.append(0)
            for r, w in total.items():
                if w:
                    out_a.append(keys[r]), out_b.append(None), out_w.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_w, pa.int64())], names=["key", "other", "weight"])


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df with class_id, n_links (long), kept and repeated (boolean).

    Texts are linked whose sets of word five-grams have a Jaccard similarity of at least `threshold` (0.8, or less with more and shorter bands; below about 0.049 is refused); equal texts are linked too.
    class_id: the smallest id reachable by links; n_links: other rows linked directly, copies included; kept: true for one row of each
    group of linked rows, that with the smallest id (nulls last), and for rows without links. A text of one to four words has a single
    shingle, all its words. Null texts, and texts without words, link with nothing: class_id is their own id, n_links 0. Repeated rows
    count as copies;
    where the row to keep is one of several equal in id and text, all of these are `kept` and `repeated`, and one_of_each keeps one. Columns with these names are replaced. An empty table gives an empty table.
    """
    spark, shape = df.sparkSession, bands_for(threshold)
    small_batches(spark)
    names = [c for c in df.columns if c.lower() not in ("class_id", "n_links", "kept", "repeated")]
    ids, texts = (F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col))
    text_key = F.when(texts.rlike("[^\\x20\\x09-\\x0D]"), F.unhex(F.md5(texts.cast("binary"))))  # null: no word
    docs = df.select(ids.alias("id"), text_key.alias("key"), texts.alias("text")).where("key is not null")

    # Buckets: band keys that different texts share.
    schema = StructType([StructField("id", df.schema[id_col].dataType), *_parse_datatype_string("key binary, node bigint, bands array<bigint>").fields])
    bands = durable(docs.mapInArrow(lambda b: _band_rows(b, *shape), schema))
    spread = bands.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = durable(spread.join(shared, "bucket").distinct())

    # Texts of those, read again: a filter of fixed size says which.
    mark = lambda node: F.pmod(node, F.lit(MARK_BITS))
    bits = members.select((mark(F.col("node")) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    marks = np.zeros(MARK_BITS // 8, np.uint8)  # at most MARK_BITS / 32768 rows come, of 4096 bytes
    for r in bits:
        marks[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    marks = spark.sparkContext.broadcast(marks.tobytes())
    node = F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("bigint")
    again = docs.select("key", mark(node).alias("mark"), "text").mapInArrow(lambda b: _sets(b, marks), "node bigint, key binary, sig binary, shingles binary")
    texts_of = durable(again.dropDuplicates(["key"]))

    # Tiles: a small bucket is one; a group's members come in blocks, two blocks to a tile.
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = durable(members.join(size.where(F.col("n") > BLOCK), "bucket"))
    of_group, groups = _merged(large)
    small = members.join(size.where(F.col("n") <= BLOCK).select("bucket"), "bucket").select("node", "band", F.lit(0).cast("bigint").alias("group"), F.col("bucket").alias("tile"), F.lit(0).alias("side"))
    blocks = of_group.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocked = of_group.join(blocks, "group").withColumn("x", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = blocked.select("node", "group", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    tile = F.xxhash64("group", F.least("x", "y"), F.greatest("x", "y"))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    tiled = small.union(dealt.select("node", F.lit(-1).alias("band"), "group", tile.alias("tile"), side.alias("side")))
    held = texts_of.select("node", "key", "sig").join(groups, "node", "left")
    ready = tiled.join(held, "node").select("tile", "side", "band", "group", "groups", "key", "sig").repartition("tile").sortWithinPartitions("tile")
    bars = least_matches(threshold)
    columns = ["tile", "place", "key", "partners"]
    near = durable(ready.mapInArrow(lambda b: _prune(b, bars, columns, shape), "tile bigint, place int, key binary, partners array<int>"))

    # Exact sets decide.
    docs = bands.select("id", "key")
    classes = docs.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    same = docs.groupBy("key", "id").agg(F.count(F.lit(1)).alias("same")).where("same > 1")
    near_keys = near.select("key").distinct()
    copies = near_keys.join(classes.select("key", "copies"), "key")
    full = near.join(texts_of.select("key", "shingles"), "key").join(copies, "key").select("tile", "place", "key", "partners", "shingles", "copies").repartition("tile").sortWithinPartitions("tile")
    links = durable(full.mapInArrow(lambda b: _verify(b, threshold), "key binary, other binary, weight bigint"))
    component = connected_components(links.where("other is not null"), "key", "other")
    weights = links.where("other is null").groupBy("key").agg(F.sum("weight").alias("weight"))

    # Verdicts for classes with copies or links; all other rows stand alone.
    info = classes.join(weights, "key", "left").where("copies > 1 or weight is not null").join(component.withColumnRenamed("node", "key"), "key", "left")
    info = durable(info.select("key", "least", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("component", "key").alias("component")))
    heads = info.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("key"))).alias("head"))
    info = info.join(heads, "component").select(F.col("key").alias("_key"), F.col("links").alias("_links"), F.col("head.least").alias("_least"), (F.col("head.key") == F.col("key")).alias("_head"))
    info = info.join(same.select(F.col("key").alias("_key"), F.col("id").alias("_least"), F.lit(True).alias("_same")), ["_key", "_least"], "left")
    out = df.select(packed_rest(names).alias("_rest"), ids.alias("_id"), text_key.alias("_key")).join(info, "_key", "left")
    kept = F.col("_links").isNull() | (F.col("_head") & F.col("_id").eqNullSafe(F.col("_least")))
    return out.select(
        *unpacked("_rest", names), F.when(F.col("_links").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        kept.alias("kept"), (kept & F.coalesce("_same", F.lit(False))).alias("repeated"),
    )


def _merged(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((group, node) of the members of large buckets; each such node's groups in a list) of (bucket, node, band).

    A node's first large bucket is that of its least band. A bucket of which half the members or more have the same first one goes into
    that one's group, another is a group. So two nodes that share a large bucket share a group.
    """
    first = large.groupBy("node").agg(F.min(F.struct("band", "bucket")).alias("f")).select("node", F.col("f.bucket").alias("first"))
    met = large.join(first, "node").groupBy("bucket", "first").agg(F.count(F.lit(1)).alias("c"))
    into = met.groupBy("bucket").agg(F.max(F.struct("c", "first")).alias("m"), F.sum("c").alias("n"))
    into = into.select("bucket", F.when(F.col("m.c") * 2 >= F.col("n"), F.col("m.first")).otherwise(F.col("bucket")).alias("group"))
    of_group = durable(large.join(into, "bucket").select("group", "node").distinct())
    return of_group, of_group.groupBy("node").agg(F.sort_array(F.collect_list("group")).alias("groups"))  # at most one for each band


def one_of_each(joined: DataFrame) -> DataFrame:
    """The rows of ngram_join to keep, one for each group; of rows equal in id and text, any one."""
    again = joined.where("kept and repeated")
    return joined.where("kept and not repeated").union(again.dropDuplicates(["class_id"])).drop("class_id", "n_links", "kept", "repeated")
