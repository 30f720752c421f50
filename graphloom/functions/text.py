"""Text functions: normalization, lines, chunks, alias tokens, anchors, occurrences."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 262_144
CHUNK_LINES, CHUNK_BYTES = 80, 8192


def normalized(text: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Line feeds for all line ends, cut to max_bytes of UTF-8 at a character; null for texts with NUL."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    raw = F.encode(t, "UTF-8")
    head = F.substring(raw, 1, max_bytes)
    # The longest prefix of whole characters: as many as lead bytes but the last, unless that one is whole.
    cut = F.try_validate_utf8(head.cast("string"))
    for k in (1, 2, 3):
        cut = F.coalesce(cut, F.try_validate_utf8(F.substring(raw, 1, max_bytes - k).cast("string")))
    return F.when(text.contains("\x00"), None).when(F.octet_length(t) <= max_bytes, t).otherwise(cut)


def line_count(text: Column) -> Column:
    """Line feeds, and one more for a last line without one; an empty text has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def alias_tokens(path: Column, text: Column) -> Column:
    """Lower-case parts of identifiers and paths, in order of appearance: pieces between / _ . : -, their camel-case and digit parts, and the pieces joined."""
    raw = F.concat(F.regexp_extract_all(path, F.lit("([A-Za-z0-9_./:-]+)")), F.regexp_extract_all(text, F.lit("([A-Za-z0-9_./:-]+)")))
    lower = lambda x: F.lower(x)
    camel = lambda p: F.split(F.regexp_replace(F.regexp_replace(p, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2"), " ")
    digits = lambda p: F.split(p, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
    expanded = lambda p: F.flatten(F.transform(F.transform(camel(p), lower), lambda s: F.concat(F.array(s), F.filter(digits(s), lambda d: d != s))))

    def tokens(r: Column) -> Column:
        parts = F.filter(F.split(r, "[/_.:-]+"), lambda p: p != "")
        own = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lower(p)), expanded(p))))
        return F.concat(own, F.when(F.size(parts) > 1, F.array(F.lower(F.array_join(parts, "")))).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.filter(F.flatten(F.transform(raw, tokens)), lambda t: t.rlike("^[a-z0-9]{2,64}$")))


_RAW, _SEPARATORS, _CAMEL, _ALIAS = re.compile("[A-Za-z0-9_./:-]+"), re.compile("[/_.:-]+"), (re.compile("([A-Z]+)([A-Z][a-z])"), re.compile("([a-z0-9])([A-Z])")), re.compile("[a-z0-9]{2,64}")
_DIGITS = re.compile("(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")


def alias_words(path: str, text: str) -> list[str]:
    """As alias_tokens, for Python strings. What a worker has read of short names is kept."""
    out: dict[str, None] = {}
    for raw in dict.fromkeys([r.strip("/_.:-") for r in _RAW.findall(path) + _RAW.findall(text)]):
        if raw.isalpha() and (raw[1:].islower() or raw.isupper() or raw.islower()):  # a plain word is its own alias
            if 2 <= len(raw) <= 64:
                out[raw.lower()] = None
        elif raw:
            for alias in _kept_aliases(raw) if len(raw) <= 64 else _aliases(raw):
                out[alias] = None
    return list(out)


def _aliases(raw: str) -> tuple[str, ...]:
    parts, out = [p for p in _SEPARATORS.split(raw) if p], []
    for part in parts:
        out.append(part.lower())
        for piece in _CAMEL[1].sub(r"\1 \2", _CAMEL[0].sub(r"\1 \2", part)).lower().split(" "):
            out += [piece, *_DIGITS.split(piece)]
    if len(parts) > 1:
        out.append("".join(parts).lower())
    return tuple(t for t in dict.fromkeys(out) if _ALIAS.fullmatch(t))


_kept_aliases = lru_cache(1 << 17)(_aliases)


def markdown_anchor(heading: Column) -> Column:
    """A heading's anchor: marks dropped, lower case, blanks to hyphens, other characters dropped, hyphens collapsed; `section` if nothing is left."""
    t = F.lower(F.regexp_replace(heading, r"[`*_\[\]()]", ""))
    t = F.regexp_replace(F.regexp_replace(F.trim(t), r"\s+", "-"), r"[^a-z0-9_-]", "")
    t = F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", "")
    return F.when(t == "", "section").otherwise(t)


def occurrences(docs: DataFrame, needle: str, text_col: str = "text") -> DataFrame:
    """One row per occurrence of needle, overlapping ones too: pos (from 1, characters), start_line and end_line (from 1).

    Lines are counted by line feeds before the occurrence and, for its end, within it but for one that ends it. Each of several equal
    rows has its own occurrences.
    """
    if needle == "":
        raise ValueError("an empty needle")
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    held = docs.where(F.contains(text_col, F.lit(needle))).withColumn("_row", F.monotonically_increasing_id())  # before rows are split
    found = held.select("*", F.startswith(text_col, F.lit(needle)).alias("_head"), F.posexplode(F.split(F.col(text_col), f"(?={quoted})")).alias("_i", "_piece"))
    from pyspark.sql import Window

    keys = [c for c in docs.columns if c != text_col]
    before = Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("_piece") - F.length(F.replace("_piece", F.lit("\n"), F.lit("")))
    found = found.withColumn("_pos", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0))).withColumn("_line", F.coalesce(F.sum(feeds).over(before), F.lit(0)))
    inner = needle[:-1].count("\n") if needle.endswith("\n") else needle.count("\n")
    hits = found.where("_i > 0 or _head")  # pieces begin at occurrences
    return hits.select(*keys, (F.col("_pos") + 1).cast("long").alias("pos"), (F.col("_line") + 1).cast("int").alias("start_line"), (F.col("_line") + 1 + inner).cast("int").alias("end_line"))


def chunk_text(text: str, lines_cap: int = CHUNK_LINES, bytes_cap: int = CHUNK_BYTES) -> list[tuple[int, int, str, bool]]:
    """(first line, last line, text, continues a line) of consecutive chunks within both caps; an empty text has one of no line."""
    if text == "":
        return [(0, 0, "", False)]
    out, held, size, first = [], [], 0, 1
    for number, line in enumerate(_lines(text), 1):
        n = len(line.encode())
        if held and (n > bytes_cap or len(held) == lines_cap or size + n > bytes_cap):
            out.append((first, number - 1, "".join(held), False))
            held, size = [], 0
        if n > bytes_cap:
            raw, at, begin = line.encode(), 0, True
            while at < n:
                end = min(n, at + bytes_cap)
                while end < n and raw[end] & 0xC0 == 0x80:
                    end -= 1
                out.append((number, number, raw[at:end].decode(), not begin))
                at, begin = end, False
            continue
        if not held:
            first = number
        held.append(line)
        size += n
    if held:
        out.append((first, first + len(held) - 1, "".join(held), False))
    return out


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def chunks(docs: DataFrame, key_cols: list[str], text_col: str = "text", lines_cap: int = CHUNK_LINES, bytes_cap: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each text: keys, chunk_ordinal, start_line, end_line, byte_length, continuation, chunk_text."""

    def run(batches):
        for pdf in batches:
            rows = [
                (*[pdf[k].iloc[i] for k in key_cols], o, a, b, len(t.encode()), c, t)
                for i in range(len(pdf)) if pdf["_text"].iloc[i] is not None for o, (a, b, t, c) in enumerate(chunk_text(pdf["_text"].iloc[i], lines_cap, bytes_cap))
            ]
            yield pd.DataFrame(rows, columns=names)

    import pandas as pd

    names = [*key_cols, "chunk_ordinal", "start_line", "end_line", "byte_length", "continuation", "chunk_text"]
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key_cols) + ", chunk_ordinal int, start_line int, end_line int, byte_length int, continuation boolean, chunk_text string"
    return docs.select(*key_cols, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def alias_query_text(query: str) -> str:
    """A query's alias words: pieces between / _ . : - and their camel-case parts, in order, each once."""
    import re

    seen: dict[str, None] = {}
    for raw in re.findall(r"[A-Za-z0-9_./:-]+", query):
        for part in filter(None, re.split(r"[/_.:-]+", raw)):
            split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", part))
            for word in (part.lower(), *split.lower().split(" ")):
                if 2 <= len(word) <= 64:
                    seen.setdefault(word)
    return " ".join(seen)


def jsonb_text(value) -> str:
    """A JSON value as PostgreSQL's jsonb prints it: keys by length, then bytes; a space after : and ,."""
    import json

    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {jsonb_text(v)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(jsonb_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)
