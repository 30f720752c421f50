"""Helpers shared by the training-data operators: tables, durable cuts, text buffers and hashes."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20  # of an Arrow batch that goes to Python, about: Spark's own limits are 10,000 rows and 64 MB
#: ASCII white space, the only separators of a word.
SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_STEP_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_JOIN = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable cuts: the cluster's spark.checkpoint.dir, or a private one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at BATCH_BYTES, so a task's buffers don't grow with its texts. A limit set by others stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":
        spark.conf.set(limit, BATCH_BYTES)


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20):
    """Yield (lo, hi, bytes, offsets) over rows lo..hi of a string column, about max_bytes each; null reads as empty.

    A single text above max_bytes comes alone, whole.
    """
    arr = texts.fill_null("").cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i below n; kept up to 2 million entries."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _STEP, dtype=np.uint64)
        down = np.full(size, _STEP_BACK, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 1 << 21:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words of the texts in buf, and the number of words of each text."""
    n = len(buf)
    docs = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    space = _IS_SPACE[buf]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = space[:-1]
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = space[1:]
    inner = offsets[1:-1]
    first[inner[inner < n]] = True
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _JOIN)


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within a text, the index of each window's first word, and windows per text."""
    per_doc = np.maximum(counts - width + 1, 0)
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per_doc
    h = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        h = h * _JOIN + words[k : len(words) - width + 1 + k]
    doc_of = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc_of[: len(h)] == doc_of[width - 1 :])
    return mix(h[at]), at, per_doc


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within a text, and their number.

    A text of fewer than `width` words, but at least one, has one shingle: all its words. A text without words has none.
    """
    starts, ends, counts = word_bounds(buf, offsets)
    words = span_hashes(buf, starts, ends)
    h, _, per_doc = window_hashes(words, counts, width)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for d in short:
            x = np.uint64(counts[d])
            with np.errstate(over="ignore"):
                for w in words[first[d] : first[d + 1]]:
                    x = x * _JOIN + w
            extra.append(x)
        h, doc = np.concatenate([h, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.empty(len(h), dtype=bool)
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(counts)).astype(np.int64) if len(doc) else np.zeros(len(counts), np.int64)


def free_name(name: str, taken) -> str:
    """The name, or one that begins with it and that no column has, in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def packed_rest(names: list[str]):
    """The columns of these names as one struct, so that an operator's own names can't clash with them; unpacked() gives them back."""
    from pyspark.sql import functions as F

    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    return F.struct(*quoted) if quoted else F.lit(None).cast("int")


def unpacked(rest: str, names: list[str]) -> list:
    from pyspark.sql import functions as F

    return [F.col(rest)[n].alias(n) for n in names]


def with_columns(df: DataFrame, fields: list[tuple[str, str]], make, inputs: list[str]) -> DataFrame:
    """Add columns computed batch by batch from the columns `inputs`, by Arrow, keeping all others.

    make(columns: list[pa.Array]) returns one list or array for each of `fields` (name, Spark type).
    A column of df with the name of a new one (in any case) is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = {name.lower() for name, _ in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    added = _parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = StructType(keep + added.fields)
    arrow = to_arrow_schema(added)
    kept = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            got = make([batch.column(len(kept) + i) for i in range(len(inputs))])
            cols = [batch.column(i) for i in range(len(kept))]
            cols += [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(got, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    small_batches(df.sparkSession)
    q = lambda n: df["`" + n.replace("`", "``") + "`"]
    shaped = df.select(*[q(n) for n in kept], *[q(n).alias(free_name(f"_in{i}", kept)) for i, n in enumerate(inputs)])
    return shaped.mapInArrow(run, schema)
