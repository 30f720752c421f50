"""Language identification by a byte convolutional network trained here in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 run over them, each filter's maximum over a window of 256 bytes feeds a softmax layer.
A filter's response is a sum over positions of what the filter gives for the embedded byte there, so after training it is tabulated for
byte pairs: the convolution over a text is then a few table look-ups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, with_columns

WIDTHS = (2, 3, 4)
PARAMETERS = {
    "filters": 8,  # of each width
    "embedding": 8,
    "window": 256,  # bytes
    "sample_docs": 600,  # documents of each language that the fit reads, at most about so many: the bound of the sample
    "sample_windows": 2,  # windows from each of these
    "epochs": 8,
    "batch": 32,
    "rate": 0.01,
    "seed": 7,
}


def _windows(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of `size` bytes of each text, one after another, padded with zeros; and the text of each. Empty texts have none."""
    length = np.diff(offsets)
    n = -(-length // size)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((int(first[-1]), size), np.uint8)
    flat = out.reshape(-1)
    for d in np.flatnonzero(n):
        at = int(first[d]) * size
        flat[at : at + int(length[d])] = buf[offsets[d] : offsets[d + 1]]
    return out, np.repeat(np.arange(len(n)), n)


class Network:
    """Weights as plain arrays; forward by tables (predict) or by embeddings (fit)."""

    def __init__(self, classes: list[str], p: dict):
        rng = np.random.Generator(np.random.PCG64(p["seed"]))
        self.classes, self.p = classes, p
        e, f = p["embedding"], p["filters"]
        self.w = {"emb": rng.normal(0, 0.3, (256, e)).astype(np.float32)}
        for width in WIDTHS:
            self.w[f"f{width}"] = rng.normal(0, 1 / np.sqrt(width * e), (width * e, f)).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.1, (f * len(WIDTHS), len(classes))).astype(np.float32)
        self.w["bias"] = np.zeros(len(classes), np.float32)
        self.tables: dict[str, np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the cross entropy of windows x (n, window) of classes y."""
        p, rng = self.p, np.random.Generator(np.random.PCG64(self.p["seed"] + 1))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        step = 0
        for epoch in range(p["epochs"]):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), p["batch"]):
                at = order[lo : lo + p["batch"]]
                grads = self._grads(x[at], y[at])
                step += 1
                rate = p["rate"] * (0.5 ** (2 * epoch / p["epochs"])) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n, e = self.w, len(x), self.p["embedding"]
        emb = w["emb"][x]  # n, t, e
        feats, kept = [], []
        for width in WIDTHS:
            t = x.shape[1] - width + 1
            cols = np.concatenate([emb[:, k : k + t] for k in range(width)], axis=2)  # n, t, width * e
            r = cols @ w[f"f{width}"]
            at = r.argmax(axis=1)  # n, f
            top = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
            feats.append(np.maximum(top, 0))
            kept.append((at, top, cols))
        h = np.concatenate(feats, axis=1)
        z = h @ w["out"] + w["bias"]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"out": h.T @ prob, "bias": prob.sum(axis=0), "emb": np.zeros_like(w["emb"])}
        back = prob @ w["out"].T
        f = self.p["filters"]
        for i, width in enumerate(WIDTHS):
            at, top, cols = kept[i]
            d = back[:, i * f : (i + 1) * f] * (top > 0)  # n, f
            picked = np.take_along_axis(cols[:, :, :, None], at[:, None, None, :], axis=1)[:, 0]  # n, width * e, f
            g[f"f{width}"] = np.einsum("nf,nkf->kf", d, picked)
            to_emb = np.einsum("nf,kf->nkf", d, w[f"f{width}"])  # n, width * e, f
            for k in range(width):
                np.add.at(g["emb"], np.take_along_axis(x, at + k, axis=1), to_emb[:, k * e : (k + 1) * e].transpose(0, 2, 1))
        return g

    def digest(self) -> str:
        h = hashlib.sha256(repr((self.classes, sorted(self.p.items()))).encode())
        for name in sorted(self.w):
            h.update(name.encode() + self.w[name].tobytes())
        return h.hexdigest()

    def tabulate(self) -> Network:
        """Tables of responses: of widths 2 and 4 for pairs of bytes, of width 3 for a pair and a byte."""
        e, w = self.p["embedding"], self.w
        part = {(width, k): w["emb"] @ w[f"f{width}"][k * e : (k + 1) * e] for width in WIDTHS for k in range(width)}  # 256, f
        pair = lambda width, k: (part[width, k][:, None] + part[width, k + 1][None]).reshape(65536, -1)
        self.tables = {"2": pair(2, 0), "3a": pair(3, 0), "3b": part[3, 2], "4a": pair(4, 0), "4b": pair(4, 2)}
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes for each window (n, window)."""
        if self.tables is None:
            self.tabulate()
        t, n = self.tables, len(x)
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        r2 = t["2"].take(pairs, axis=0).max(axis=1)
        r3 = t["3a"].take(pairs[:, :-1], axis=0)
        r3 += t["3b"].take(x[:, 2:], axis=0)
        r4 = t["4a"].take(pairs[:, :-2], axis=0)
        r4 += t["4b"].take(pairs[:, 2:], axis=0)
        z = np.maximum(np.concatenate([r2, r3.max(axis=1), r4.max(axis=1)], axis=1), 0) @ self.w["out"] + self.w["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True) if n else z


def _has_letter(raw: bytes) -> bool:
    text = raw.decode()
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def predict_texts(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text: the mean probability of the language over all windows of the text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    size = net.p["window"]
    for lo, hi, buf, offsets in text_slices(texts, 1 << 18):
        x, doc = _windows(buf, offsets, size)
        prob = np.concatenate([net.predict(x[k : k + 64]) for k in range(0, len(x), 64)]) if len(x) else np.zeros((0, len(net.classes)))
        total = np.zeros((hi - lo, len(net.classes)))
        np.add.at(total, doc, prob)
        mean = total / np.maximum(np.bincount(doc, minlength=hi - lo), 1)[:, None]
        best = mean.argmax(axis=1)
        raw = buf.tobytes()
        for d in range(hi - lo):
            if _has_letter(raw[offsets[d] : offsets[d + 1]]):
                langs[lo + d], scores[lo + d] = net.classes[best[d]], float(min(1.0, mean[d, best[d]]))
    return langs, scores


def train(df: DataFrame, text_col: str, lang_col: str, key: str, **parameters) -> Network | None:
    """Fit on a bounded sample of the labelled rows of df: about sample_docs rows of each language, chosen by a hash of `key`.

    None if no row has a language and a text.
    """
    p = PARAMETERS | parameters
    good = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r["n"] for r in good.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    size, k = p["window"], p["sample_windows"]
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, p["sample_docs"] / n))])
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    raw = F.encode(text_col, "UTF-8")
    starts = [F.pmod(F.xxhash64(F.lit(i), F.col(key).cast("string")), F.greatest(F.octet_length(text_col) - size, F.lit(1))).cast("int") for i in range(k)]
    picked = good.where(chance < share[F.col(lang_col)]).select(F.col(lang_col).alias("y"), *[F.substring(raw, s + 1, F.lit(size)).alias(f"x{i}") for i, s in enumerate(starts)])
    rows = sorted(tuple(r) for r in picked.collect())  # at most about sample_docs * languages rows of sample_windows * window bytes
    classes = sorted(counts)
    x = np.zeros((len(rows) * k, size), np.uint8)
    y = np.zeros(len(rows) * k, np.int64)
    for i, (lang, *parts) in enumerate(rows):
        for j, part in enumerate(parts):
            x[i * k + j, : len(part)] = np.frombuffer(bytes(part), np.uint8)
            y[i * k + j] = classes.index(lang)
    return Network(classes, p).fit(x, y)


def identify(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) to each row, from all windows of the whole text.

    Null and empty texts, and those without a letter, are `und` with score 0; so is all if net is None (nothing to learn from).
    One pass without a shuffle. Columns of df with these names are replaced. The network (fixed size, under 15 MB) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast((net.digest(), net.classes, net.p, net.w) if net else None)

    def make(cols):
        return predict_texts(_network(shared), cols[0])

    return with_columns(df, [("lang_pred", "string"), ("score", "double")], make, [text_col])


_networks: dict[str, Network] = {}  # this worker's network, by the digest of its weights


def _network(shared) -> Network | None:
    if shared.value is None:
        return None
    key, classes, p, w = shared.value
    if key not in _networks:
        _networks.clear()
        net = Network.__new__(Network)
        net.classes, net.p, net.w = classes, p, w
        net.tables = None
        _networks[key] = net.tabulate()
    return _networks[key]
