"""Line-first quality rules: punctuation, navigation and boilerplate rules per line, then a limit on lost text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import span_hashes, text_slices, window_hashes, with_columns, word_bounds

WIDTH = 5
# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPS = b".!?;:,"
SEPARATORS = ("|", "/", ">", "::", "-", "*", "·", "•", "»", "›")
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "we use cookies", "accept cookies",
    "enable javascript", "click here to", "subscribe to our newsletter", "sign up for our", "share on facebook", "share on twitter", "lorem ipsum",
)
PARAMETERS = {
    "min_words": 10,  # a document with fewer words fails
    "max_repeat_percent": 20,  # of its words, in repeated windows of five
    "max_punctuation_percent": 18,  # of a line's characters in words
    "unstopped_words": 25,  # a line of so many words without any stop fails
    "min_separators": 3,  # a navigation line has so many separators standing alone, and at least one for each four words
    "max_lost_percent": 50,  # of a document's characters in words, in lines removed
}

_SYMBOL, _PUNCT, _STOP = (np.isin(np.arange(256), list(x)) for x in (SYMBOLS, PUNCTUATION, STOPS))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SEPARATORS = frozenset(x.encode() for x in SEPARATORS)
_BOILERPLATE = tuple(x.encode() for x in BOILERPLATE)
_SEP_HINT = tuple({x[:1] for x in _SEPARATORS})

FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
    ("n_bad_lines", "long"), ("lost_chars", "long"), ("kept", "boolean"), ("clean_text", "string"),
]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _slice_columns(buf: np.ndarray, offsets: np.ndarray, p: dict) -> tuple[dict[str, np.ndarray], dict[int, str]]:
    """The columns of a slice of texts, and the cleaned text where a line went."""
    n = len(offsets) - 1
    starts, ends, counts = word_bounds(buf, offsets)
    out = {k: np.zeros(n, np.int64) for k in ("n_dup_lines", "n_bad_lines", "lost_chars")}
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    lead = _sums(_LEAD[buf] & (np.cumsum(inside[:-1]) > 0))
    symbols, punct, stops = _sums(_SYMBOL[buf]), _sums(_PUNCT[buf]), _sums(_STOP[buf])
    per_doc = lambda x: x[offsets[1:]] - x[offsets[:-1]]
    out |= {"n_words": counts, "word_chars": per_doc(lead), "n_symbols": per_doc(symbols)}

    h, at, windows = window_hashes(span_hashes(buf, starts, ends), counts, WIDTH)
    doc = np.repeat(np.arange(n), windows)
    h = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]] if len(h) else False
    twice = at[order[same[1:] | same[:-1]]] if len(h) else at
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WIDTH, -1)
    repeated = _sums(np.cumsum(covered[:-1]) > 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    out["n_repeat_words"] = repeated[first[1:]] - repeated[first[:-1]]

    breaks = np.flatnonzero(buf == 10)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start <= len(buf)]
    raw = buf.tobytes()
    clean: dict[int, str] = {}
    for d in range(n):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        text = raw[lo:hi]
        lines = text.split(b"\n")
        size = np.array([len(x) for x in lines], np.int64)
        begin = lo + np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        end = begin + size
        words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
        chars, marks, stopped = lead[end] - lead[begin], punct[end] - punct[begin], stops[end] - stops[begin]
        bad = (100 * marks > p["max_punctuation_percent"] * chars) & (words > 0)
        bad |= (words >= p["unstopped_words"]) & (stopped == 0)
        if any(x in text for x in _SEP_HINT):
            for k in np.flatnonzero((words >= p["min_separators"]) & ~bad):
                alone = sum(x in _SEPARATORS for x in lines[k].split())
                bad[k] = alone >= p["min_separators"] and 4 * alone >= words[k]
        low = text.lower()
        if any(x in low for x in _BOILERPLATE):
            for k in np.flatnonzero((words > 0) & ~bad):
                line = lines[k].lower()
                bad[k] = any(x in line for x in _BOILERPLATE)
        if len(lines) > 1:
            full = [x for x, w in zip(lines, words, strict=True) if w]
            out["n_dup_lines"][d] = len(full) - len(set(full))
        if bad.any():
            out["n_bad_lines"][d] = bad.sum()
            out["lost_chars"][d] = chars[bad].sum()
            clean[d] = b"\n".join(x for x, b in zip(lines, bad, strict=True) if not b).decode()
    return out, clean


def _columns(texts: pa.Array, p: dict) -> list:
    parts, clean = [], texts.to_pylist()
    for lo, _, buf, offsets in text_slices(texts):
        got, changed = _slice_columns(buf, offsets, p)
        parts.append(got)
        for d, x in changed.items():
            clean[lo + d] = x
    c = {k: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars")}
    c["base_failed"] = (c["n_words"] < p["min_words"]) | (100 * c["n_repeat_words"] > p["max_repeat_percent"] * c["n_words"])
    c["kept"] = ~c["base_failed"] & (100 * c["lost_chars"] <= p["max_lost_percent"] * c["word_chars"])
    c["clean_text"] = clean
    return [c[name] for name, _ in FIELDS]


def quality_rules(df: DataFrame, text_col: str = "text", **parameters: int) -> DataFrame:
    """Add the counts of FIELDS, the verdict `kept` and the text without failing lines, `clean_text`, to each row.

    Lines (split at \\n) fail by a rule of punctuation (too much of it, or a long line without a stop), navigation (separators standing
    alone among few words) or boilerplate (a fixed phrase). A document fails by the base limits or if failing lines hold more than
    max_lost_percent of its characters in words. One pass without a shuffle: repeated rows and hot sources are met row by row.
    Null and empty texts have no words, so kept is false; clean_text of null stays null. An empty table gives an empty table.
    Columns of df with the names of FIELDS are replaced.
    """
    p = PARAMETERS | parameters
    return with_columns(df, FIELDS, lambda cols: _columns(cols[0], p), [text_col])
