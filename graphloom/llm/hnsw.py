"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Every vector queries every shard's graph: a task loads a graph once and streams vectors past it. A shard's beam is widened until audits,
against brute force, find all links. Hits are closed
under the links of their neighbourhood, verified by cosine in double precision, and joined into components. A task gives the weight of
each vector's links and stars over its local components, so nothing grows with the square of a group.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, packed_rest, unpacked
from .components import connected_components

PARAMETERS = {
    "threshold": 0.95,
    "shards": 4,  # at least
    "shard_rows": 65_536,  # vectors in a shard, about, at most: what a task holds
    "part_rows": 65_536,  # vectors that query a shard in one task, about, at most; they come in slices
    "slice": 8_192,  # vectors that a task looks up at once
    "links": 24,  # of a node in the lowest layer; half as many above
    "margin": 0.03,  # a search goes on through nodes that miss the threshold by no more
    "spare": 8,  # more links, to nodes that few link to
    "build_beam": 40,
    "beam": 32,  # to begin with; doubled until the audit passes
    "audit": 1024,  # audit queries for each shard, a bounded sample: vectors turned to just over the threshold
    "entries": 16,  # to a layer, from the one above
    "whole_layer": 4096,  # an upper layer of no more nodes is compared with as a whole
    "layer": 16,  # a layer has one in so many nodes of the one below
}
BLOCK = 256


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, expand: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The nodes (len(q), width; -1: none) nearest to each query that a beam of this width finds from its entries, and their cosines."""
    rows = len(q)
    seen = np.zeros((rows, len(x) + 1), dtype=bool)  # the last column is for places without a node
    ids = np.full((rows, width), -1, np.int64)
    sims = np.full((rows, width), -np.inf, np.float32)
    done = np.zeros((rows, width), dtype=bool)
    e = entry[:, :width]
    ids[:, : e.shape[1]] = e
    sims[:, : e.shape[1]] = np.where(e >= 0, np.matmul(x[e], q[:, :, None])[:, :, 0], -np.inf)
    seen[np.arange(rows)[:, None], e] = True
    active, k = np.arange(rows), min(expand, width)
    while len(active):
        s, i, d = sims[active], ids[active], done[active]
        score = np.where(d | (i < 0), -np.inf, s)
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(active), 1))
        good = np.take_along_axis(score, top, axis=1) > -np.inf
        go = good.any(axis=1)
        active, top, good, s, i, d = active[go], top[go], good[go], s[go], i[go], d[go]
        if not len(active):
            break
        every = np.arange(len(active))[:, None]
        d[every, top] |= good
        near = links[i[every, top]]
        near[~good] = -1
        near = near.reshape(len(active), -1)
        row, col = np.nonzero((near >= 0) & ~seen[active[:, None], near])
        flat = np.unique(row * (len(x) + 1) + near[row, col])  # each new node of a query once; only these are compared
        row, node = np.divmod(flat, len(x) + 1)
        seen[active[row], node] = True
        if len(row):
            count = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            found, found_sims = np.full((len(active), int(count.max())), -1, np.int64), np.full((len(active), int(count.max())), -np.inf, np.float32)
            found[row, place], found_sims[row, place] = node, np.einsum("ij,ij->i", x[node], q[active[row]])
            s, i, d = np.concatenate([s, found_sims], axis=1), np.concatenate([i, found], axis=1), np.concatenate([d, np.zeros(found.shape, dtype=bool)], axis=1)
            best = np.argpartition(-s, width - 1, axis=1)[:, :width]
            s, i, d = (np.take_along_axis(v, best, axis=1) for v in (s, i, d))
        sims[active], ids[active], done[active] = s, i, d
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, up to `most`: those nearer to the row's node than to one chosen before, then the nearest of the rest."""
    c = x[ids]
    gram = np.matmul(c, c.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, dtype=bool)
    closest = np.full(ids.shape, -np.inf, np.float32)
    for k in range(ids.shape[1]):
        take = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        closest = np.where(take[:, None], np.maximum(closest, gram[:, :, k]), closest)
    rank = np.where(ids < 0, 2, np.where(chosen, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """A navigable graph in layers over unit vectors; nodes of higher layers come first, so each layer is a prefix of nodes."""

    def __init__(self, x: np.ndarray, p: dict, seed: int = 5):
        self.x, self.p = np.ascontiguousarray(x, dtype=np.float32), p
        self.sizes = [len(x)]
        while self.sizes[-1] > 2 * p["layer"]:
            self.sizes.append(self.sizes[-1] // p["layer"])
        self.layers: list[np.ndarray] = [None] * len(self.sizes)
        for level in range(len(self.sizes) - 1, -1, -1):
            self.layers[level] = self._build(level)
        self.layers[0] = self._reachable(self.layers[0])

    def _reachable(self, links: np.ndarray) -> np.ndarray:
        """Links with `spare` more for each node: to nodes that few link to, from those that they link to."""
        spare = self.p["spare"]
        out = np.concatenate([links, np.full((len(links), spare), -1, np.int64)], axis=1)
        free = np.full(len(links), spare)
        linked = np.bincount(links[links >= 0], minlength=len(links))
        for node in np.flatnonzero(linked < 3).tolist():
            for near in links[node, :4].tolist():
                if near >= 0 and free[near] and not (out[near] == node).any():
                    out[near, links.shape[1] + spare - free[near]] = node
                    free[near] -= 1
        return out

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes that these link to, or that link to them, in the lowest layer."""
        if not hasattr(self, "_into"):
            src = np.repeat(np.arange(len(self.x)), self.layers[0].shape[1])
            dst = self.layers[0].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            self._into = src[order], np.searchsorted(dst[order], np.arange(len(self.x) + 1))
        src, start = self._into
        back = [src[start[a] : start[a + 1]] for a in nodes.tolist()]
        out = np.unique(np.concatenate([self.layers[0][nodes].reshape(-1), *back]))
        return out[out >= 0]

    def _entry(self, q: np.ndarray, level: int) -> np.ndarray:
        """Entries to a layer: the nearest nodes of the layer above, which is searched with a beam as wide as itself where it is small."""
        entry = np.zeros((len(q), 1), np.int64)
        for above in range(len(self.sizes) - 1, level, -1):
            n, most = self.sizes[above], self.p["entries"]
            if n <= self.p["whole_layer"]:
                sims = q @ self.x[:n].T
                entry = np.argpartition(-sims, most - 1, axis=1)[:, :most] if n > most else np.tile(np.arange(n), (len(q), 1))
            else:
                entry = beam_search(self.x[:n], self.layers[above], q, entry, 4 * most)[0][:, :most]
        return entry

    def _build(self, level: int) -> np.ndarray:
        n, most = self.sizes[level], self.p["links"] if level == 0 else self.p["links"] // 2
        links, x = np.full((n, most), -1, np.int64), self.x[:n]
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            q = x[lo:hi]
            own = q @ q.T
            own[np.triu_indices(hi - lo)] = -np.inf  # a node sees those before it
            k = min(self.p["build_beam"], hi - lo)
            ids = np.argsort(-own, axis=1, kind="stable")[:, :k]
            sims = np.take_along_axis(own, ids, axis=1)
            ids = np.where(sims > -np.inf, ids + lo, -1)
            if lo:
                entry = self._entry(q, level)
                entry = np.concatenate([np.zeros((hi - lo, 1), np.int64), np.where((entry < lo) & (entry > 0), entry, -1)], axis=1)
                far, far_sims = beam_search(x[:lo], links[:lo], q, entry, self.p["build_beam"])
                ids, sims = np.concatenate([ids, far], axis=1), np.concatenate([sims, far_sims], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, : self.p["build_beam"]]
                ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            links[lo:hi] = diverse(x, ids, sims, most)
            self._back(x, links, lo, hi, most)
        return links

    def _back(self, x: np.ndarray, links: np.ndarray, lo: int, hi: int, most: int) -> None:
        """Links back to the new nodes lo to hi; a node with more than `most` keeps diverse ones."""
        src = np.repeat(np.arange(lo, hi), most)
        dst = links[lo:hi].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("ij,ij->i", x[src], x[dst])
        order = np.lexsort((-sim, dst))
        src, dst, sim = src[order], dst[order], sim[order]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.concatenate([first, [len(dst)]])))
        keep = rank < 8
        nodes = dst[first]
        place = np.searchsorted(nodes, dst[keep])
        new = np.full((len(nodes), 8), -1, np.int64)
        new[place, rank[keep]] = src[keep]
        for a in range(0, len(nodes), 2048):
            at = nodes[a : a + 2048]
            ids = np.concatenate([links[at], new[a : a + 2048]], axis=1)
            own = ids[:, most:]
            own[(own[:, :, None] == ids[:, None, :most]).any(axis=2)] = -1
            sims = np.where(ids >= 0, np.matmul(x[ids], x[at][:, :, None])[:, :, 0], -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            links[at] = diverse(x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), most)

    def near(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width >= len(self.x):  # as wide as the shard: compare with all
            sims = q @ self.x.T
            return np.tile(np.arange(len(self.x)), (len(q), 1)), sims
        return beam_search(self.x, self.layers[0], q, self._entry(q, 0), width)

    def audited_beam(self, seed: int = 9) -> tuple[int, list[tuple[int, float]]]:
        """The least of the widths beam, 2 beam, ... with which audit queries find every node that brute force finds, and (width, recall) of each width tried."""
        p, rng = self.p, np.random.Generator(np.random.PCG64(seed))
        at = rng.integers(0, len(self.x), min(p["audit"], 4 * len(self.x)))
        noise = rng.normal(size=(len(at), self.x.shape[1]))
        base = self.x[at].astype(np.float64)
        noise -= (noise * base).sum(axis=1, keepdims=True) * base
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        noise = np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-9)
        c = p["threshold"] + (1 - p["threshold"]) * rng.uniform(0.02, 0.3, (len(at), 1))
        q = np.concatenate([(c * base + np.sqrt(1 - c**2) * noise).astype(np.float32), self.x[at[: len(at) // 4]]])
        truth = (q @ self.x.T) >= p["threshold"]
        width, tried = p["beam"], []
        while width < len(self.x):
            found = np.zeros(truth.shape, dtype=bool)
            for queries, nodes in links_of(self, q.astype(np.float64), width, p["threshold"]):
                found[np.ix_(queries, nodes)] = True
            tried.append((width, float((truth & found).sum() / max(1, truth.sum()))))
            if not (truth & ~found).any():
                return width, tried
            width *= 2
        return len(self.x), [*tried, (len(self.x), 1.0)]


def dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists of one length, without nulls, as a matrix, without a Python object for each component."""
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def links_of(graph: Graph, vectors: np.ndarray, width: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Local components: (queries, nodes, matrix of links between them), of queries and nodes linked at `threshold` or more.

    A beam's hits open a component; it takes in the hits of its queries and nodes' neighbours in the graph until none is new.
    vectors: of the queries, in double precision and of unit length. Nodes' own unit vectors stand in graph.exact.
    """
    loose, q32 = np.float32(threshold - graph.p["margin"]), vectors.astype(np.float32)
    hit_q, hit_x = [], []
    for lo in range(0, len(q32), BLOCK):
        ids, sims = graph.near(q32[lo : lo + BLOCK], width)
        r, c = np.nonzero((sims >= loose) & (ids >= 0))
        hit_q.append(r + lo)
        hit_x.append(ids[r, c])
    hq, hx = np.concatenate(hit_q), np.concatenate(hit_x)
    out, q_of, x_of = [], {}, {}
    for a, b in zip(hq.tolist(), hx.tolist(), strict=True):
        q_of.setdefault(b, []).append(a)
        x_of.setdefault(a, []).append(b)
    left = set(x_of)
    for begin in list(x_of):
        if begin not in left:
            continue
        queries, nodes, todo_q, todo_x = {begin}, set(), [begin], []
        while todo_q or todo_x:
            if todo_q:
                for x in x_of[todo_q.pop()]:
                    if x not in nodes:
                        nodes.add(x)
                        todo_x.append(x)
            else:
                for a in q_of.get(todo_x.pop(), ()):
                    if a not in queries:
                        queries.add(a)
                        todo_q.append(a)
        left -= queries
        qs, pool = np.array(sorted(queries)), np.array(sorted(nodes))
        while True:  # neighbours of nodes that a query reaches
            around = np.setdiff1d(graph.neighbours(pool), pool)
            reach = np.zeros(len(around), dtype=bool)
            for lo in range(0, len(qs), 1024):
                reach |= ((q32[qs[lo : lo + 1024]] @ graph.x[around].T) >= loose).any(axis=0)
            if not reach.any():
                break
            pool = np.union1d(pool, around[reach])
        out.append((qs, pool))
    return out


def _packed(**arrays) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _graph_row(p: dict):
    def make(t: pa.Table) -> pa.Table:
        keys, raw = np.array(t.column("key").to_pylist(), dtype=object), dense(t.column("vec"))
        order = np.random.Generator(np.random.PCG64(3)).permutation(np.argsort(keys, kind="stable"))
        raw = raw[order]
        graph = Graph(unit(raw.astype(np.float64)).astype(np.float32), p)
        width, tried = graph.audited_beam()
        blob = _packed(
            raw=raw, width=np.array(width), sizes=np.array(graph.sizes), keys=np.frombuffer(b"".join(keys[order]), np.uint8), copies=t.column("copies").to_numpy()[order],
            **{f"layer{k}": v.astype(np.int32) for k, v in enumerate(graph.layers)},
        )
        audit = pa.array([[{"beam": w, "recall": r} for w, r in tried]], pa.list_(pa.struct([("beam", pa.int64()), ("recall", pa.float64())])))
        return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "nodes": pa.array([len(raw)], pa.int64()), "beam": pa.array([width], pa.int64()), "audit": audit, "graph": pa.array([blob], pa.binary())})

    return make


_GRAPH = "dim int, shard int, nodes bigint, beam bigint, audit array<struct<beam:bigint,recall:double>>, graph binary"


class _Shard:
    """A shard's graph in a task; double-precision vectors are made for hits only."""

    def __init__(self, blob: bytes, p: dict):
        z = np.load(io.BytesIO(blob))
        self.raw, self.copies, self.width, self.threshold = z["raw"], z["copies"], int(z["width"]), p["threshold"]
        self.graph = g = Graph.__new__(Graph)
        g.x = np.concatenate([unit(self.raw[k : k + 8192].astype(np.float64)).astype(np.float32) for k in range(0, len(self.raw), 8192)])
        g.p, g.sizes = p, z["sizes"].tolist()
        g.layers = [z[f"layer{k}"].astype(np.int64) for k in range(len(g.sizes))]
        self.keys = [x.tobytes() for x in z["keys"].reshape(-1, 16)]

    def links(self, own: list[bytes], raw: np.ndarray, out: tuple[list, list, list]) -> None:
        """Appends (key, null, weight of its links here) for each linked query, and (key, other, 0) as stars over local components."""
        keys, others, weights = out
        vectors = unit(raw.astype(np.float64))
        for qs, xs in links_of(self.graph, vectors, self.width, self.threshold):
            exact = unit(self.raw[xs].astype(np.float64))
            label_q = np.arange(len(qs))
            place = {self.keys[x]: k for k, x in enumerate(xs.tolist())}
            total, linked, blocks = np.zeros(len(qs), np.int64), [], range(0, len(qs), 512)
            for lo in blocks:
                m = (vectors[qs[lo : lo + 512]] @ exact.T) >= self.threshold
                total[lo : lo + 512] = m @ self.copies[xs]
                linked.append(np.packbits(m, axis=1))
            for k, a in enumerate(qs.tolist()):  # not itself
                if own[a] in place:
                    total[k] -= self.copies[xs[place[own[a]]]]
            # Stars: each query or node of a local component with the component's first query.
            big = len(qs)
            while True:
                before = label_q.copy()
                label_x = np.full(len(xs), big)
                for lo, bits in zip(blocks, linked, strict=True):
                    m = np.unpackbits(bits, axis=1, count=len(xs)).astype(bool)
                    label_x = np.minimum(label_x, np.where(m, label_q[lo : lo + 512, None], big).min(axis=0))
                for lo, bits in zip(blocks, linked, strict=True):
                    m = np.unpackbits(bits, axis=1, count=len(xs)).astype(bool)
                    label_q[lo : lo + 512] = np.minimum(label_q[lo : lo + 512], np.where(m, label_x[None], big).min(axis=1))
                if (before == label_q).all():
                    break
            for a, w, head in zip(qs.tolist(), total.tolist(), label_q.tolist(), strict=True):
                if w:
                    keys.append(own[a]), others.append(None), weights.append(w)
                if own[a] != own[qs[head]]:
                    keys.append(own[a]), others.append(own[qs[head]]), weights.append(0)
            for x, head in zip(xs.tolist(), label_x.tolist(), strict=True):
                if head < big and self.keys[x] != own[qs[head]]:
                    keys.append(self.keys[x]), others.append(own[qs[head]]), weights.append(0)


def _query(batches, p: dict):
    """Links of the vectors that follow a graph's row in a sorted partition. Columns in: dim, shard, part, graph, key, vec."""
    shard, held, rows = None, [], 0

    def found():
        out: tuple[list, list, list] = ([], [], [])
        if shard is not None and held:
            t = pa.Table.from_batches(held)
            shard.links(t.column("key").to_pylist(), dense(t.column("vec")), out)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "other", "weight"])

    for batch in batches:
        starts = np.flatnonzero(batch.column("graph").is_valid().to_numpy(zero_copy_only=False)).tolist()
        begins = sorted({0, *starts})
        for lo, hi in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            if lo in starts:
                yield found()
                held, rows, shard = [], 0, None  # the last graph goes before the next is read
                shard = _Shard(batch.column("graph")[lo].as_py(), p)
                lo += 1
            while lo < hi:
                take = min(hi - lo, p["slice"] - rows)
                held.append(batch.slice(lo, take).select(["key", "vec"]))
                lo, rows = lo + take, rows + take
                if rows == p["slice"]:
                    yield found()
                    held, rows = [], 0
    yield found()


def _graphs(rows: DataFrame, p: dict) -> tuple[DataFrame, DataFrame, int]:
    """(nodes: key, copies, least, vec, dim, shard, part; graphs by dim and shard; parts) of rows (id, key, vec)."""
    spark = rows.sparkSession
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("vec").alias("vec"))
    classes = durable(classes.withColumn("dim", F.size("vec")))
    n = classes.count()
    shards = max(p["shards"], -(-n // p["shard_rows"]))
    # Parts: as many as part_rows asks for, or as many as keep the cluster's cores at work, if no part gets fewer than a slice.
    parts = max(1, -(-n // p["part_rows"]), min(-(-n // p["slice"]), -(-spark.sparkContext.defaultParallelism // shards)))
    nodes = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts)).cast("int"))
    return nodes, durable(nodes.select("key", "copies", "vec", "dim", "shard").groupBy("dim", "shard").applyInArrow(_graph_row(p), _GRAPH)), parts


def _rows(df: DataFrame, id_col: str, vector_col: str, names: list[str]) -> DataFrame:
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    vec = q(vector_col)
    element = df.schema[vector_col].dataType.elementType.simpleString()
    vec = vec if element in ("float", "double") else vec.cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, number) & F.exists(vec, lambda x: x != 0)
    key = F.when(valid, F.unhex(F.md5(F.transform(vec, lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast("string").cast("binary"))))
    return df.select(packed_rest(names).alias("rest"), q(id_col).alias("id"), key.alias("key"), vec.alias("vec"))


def shard_audits(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **parameters) -> DataFrame:
    """For each dim and shard its nodes, the beam that its audit chose and the recall at each beam tried."""
    return _graphs(_rows(df, id_col, vector_col, []), PARAMETERS | parameters)[1].drop("graph")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **parameters) -> DataFrame:
    """The rows of df, without vector_col, with n_links, component_id and kept.

    n_links: other rows linked directly (cosine of at least `threshold`; equal vectors count as linked); component_id: the smallest id
    reachable by links; kept: id = component_id. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing: n_links 0, component_id their own id. Vectors of different lengths don't link. Repeated rows are copies of a vector, each
    with its own result. Columns with these names are replaced. An empty table gives an empty table.

    Equal vectors are one node with a weight. Nodes are dealt to shards by a hash; the number of shards follows the input beyond
    shards * shard_rows. A task holds one graph and a slice of vectors. That every node queries every shard is the method: vectors are
    sent once to each shard, and a graph once for each part_rows vectors.
    """
    p = PARAMETERS | parameters
    names = [c for c in df.columns if c.lower() not in ("n_links", "component_id", "kept", vector_col.lower())]
    rows = _rows(df, id_col, vector_col, names)
    nodes, graphs, parts = _graphs(rows, p)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    graph_rows = graphs.select("dim", "shard", every(parts).alias("part"), "graph", F.lit(None).cast("binary").alias("key"), F.lit(None).cast(nodes.schema["vec"].dataType).alias("vec"))
    shards = graphs.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a row for each length of vectors
    asked = nodes.select("dim", "part", "key", "vec").join(F.broadcast(shards), "dim").select("dim", F.explode("shards").alias("shard"), "part", F.lit(None).cast("binary").alias("graph"), "key", "vec")
    tasks = max(1, graphs.count() * parts)
    met = graph_rows.union(asked).repartition(tasks, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("graph").isNull())
    links = durable(met.mapInArrow(lambda b: _query(b, p), "key binary, other binary, weight bigint"))
    component = connected_components(links.where("other is not null"), "key", "other").withColumnRenamed("node", "key")
    weights = links.where("other is null").groupBy("key").agg(F.sum("weight").alias("weight"))
    info = nodes.select("key", "copies", "least").join(weights, "key", "left").where("copies > 1 or weight is not null").join(component, "key", "left")
    info = durable(info.select("key", "least", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("component", "key").alias("component")))
    heads = info.groupBy("component").agg(F.min("least").alias("head"))
    info = info.join(heads, "component").select("key", "links", "head")
    out = rows.drop("vec").join(info, "key", "left")
    alone = F.col("links").isNull()
    return out.select(
        *unpacked("rest", names), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("head")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("head"))).alias("kept"),
    )
