"""Licence scans: sparse TF-IDF cosine of lines and whole files to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A file's licence comes from its own SPDX tag, full licence text or header lines, or else from a licence file in
its directory or the nearest directory above that has one.
"""

from __future__ import annotations

import functools
import importlib.resources
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, packed_rest, unpacked

# Notices by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "This work is licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This work is licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
)
CUE = r"[Ll]icen[cs]e|LICEN[CS]E|[Rr]ights reserved|RIGHTS RESERVED|[Pp]ublic domain|[Pp]ermission is hereby granted|SPDX"
CUE_CC = r"CC BY|CC0"
CUE_CORES = ("icense", "icence", "ICENSE", "ICENCE", "ights reserved", "RIGHTS RESERVED", "ublic domain", "ermission is hereby granted", "SPDX", "CC BY", "CC0")
THRESHOLD = 0.75
# Licences with a full text in license_texts, and terms that stand in each copy of it (other versions and relatives don't have them).
FULL_TEXTS = {
    "Apache-2.0": "apache license version 2.0 january 2004",
    "BSD-2-Clause": "redistribution and use in source and binary forms",
    "BSD-3-Clause": "redistribution and use in source and binary forms",
    "CC0-1.0": "cc0 1.0 universal",
    "GPL-2.0": "gnu general public license version 2 june 1991",
    "GPL-3.0": "gnu general public license version 3 29 june 2007",
    "ISC": "permission to use copy modify and or distribute this software for any purpose",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "MPL-2.0": "mozilla public license version 2.0 1 definitions",
}
FULL_CORES = ("edistribution", "ermission")  # each full text has one of these or a cue
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
WINDOWS = ((0, 1), (0, 2), (-1, 0), (-1, 1))  # lines about a cue line that are scored as one, where it does not pass alone
HOT = 1000
SHARE = 0.5  # a file is a licence file if its licence lines hold at least this share of its words
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", text.translate(str.maketrans(_UPPER, _LOWER)))


@functools.cache
def full_texts() -> tuple[str, ...]:
    folder = importlib.resources.files(__package__) / "license_texts"
    return tuple((folder / f"{name}.txt").read_text("utf-8") for name in FULL_TEXTS)


def _weights(texts: tuple[str, ...]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Squared inverse document frequencies of templates' terms, that of any other term, and for each template term -> idf^2 * tf / norm."""
    bags = [Counter(terms(t)) for t in texts]
    n = len(bags)
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    other = math.log(n + 1) + 1
    out = []
    for b in bags:
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items()))
        out.append({w: c * idf[w] ** 2 / norm for w, c in b.items()})
    return {w: v * v for w, v in idf.items()}, other * other, out


def _map(d: dict[str, float]) -> Column:
    return F.expr("map(" + ", ".join(f"'{w}', {v!r}D" for w, v in sorted(d.items())) + ")")


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _best(words: Column, texts: tuple[str, ...], open_to=lambda k: None) -> Column:
    """struct<score, k>: the highest cosine of a bag of terms to a template, and minus its place (ties go to the first).

    Template k takes part where the column open_to(k) holds, if it gives one; null where none takes part.
    """
    squares, other, templates = _weights(texts)
    idf2 = _map(squares)
    zero = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    weigh = lambda a: a["sum"] + a["n"] * a["n"] * F.coalesce(F.element_at(idf2, a["w"]), F.lit(other))

    def step(a: Column, w: Column) -> Column:
        return F.when(a["w"] == w, F.struct(a["w"].alias("w"), (a["n"] + 1.0).alias("n"), a["sum"].alias("sum"))).otherwise(F.struct(w.alias("w"), F.lit(1.0).alias("n"), weigh(a).alias("sum")))

    def dot(own: Column, t: dict[str, float]) -> Column:
        m = _map(t)
        return F.aggregate(own, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(m, w), F.lit(0.0)))

    def scored(own: Column, norm: Column) -> Column:
        score = lambda k, t: F.struct(F.round(F.when(norm > 0, dot(own, t) / norm).otherwise(F.lit(0.0)), 6).alias("score"), F.lit(-k).alias("k"))
        return F.array_max(F.array(*[score(k, t) if (o := open_to(k)) is None else F.when(o, score(k, t)) for k, t in enumerate(templates)]))

    known = lambda w: F.filter(w, lambda x: F.map_contains_key(idf2, x))  # noqa: E731  terms of any template: others add nothing to a product
    return _with(words, lambda w: _with(F.struct(known(w).alias("own"), F.sqrt(F.aggregate(F.array_sort(w), zero, step, weigh)).alias("norm")), lambda x: scored(x["own"], x["norm"])))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"([a-z0-9]+(?:\.[0-9]+)?)"))


def _about(lines: Column, threshold: float) -> Column:
    """For each cue line struct<best, first, last, spdx>: its score alone; or, if that is too low and theirs is not, that of lines about it as one."""
    notices = tuple(t for _, t in TEMPLATES)
    n = F.size(lines)
    cued = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"{CUE}|{CUE_CC}"), i)), lambda i: i.isNotNull())
    joined = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")
    one = lambda a, b: F.struct(_best(_terms(joined(a, b)), notices).alias("best"), a.alias("first"), b.alias("last"))

    def entry(i: Column) -> Column:
        about = F.array(*[F.struct(F.greatest(F.lit(0), i + a).alias("a"), F.least(n - 1, i + b).alias("b")) for a, b in WINDOWS])
        wide = lambda own: _with(F.array_max(F.transform(about, lambda w: one(w["a"], w["b"]))), lambda x: F.when(x["best"]["score"] >= threshold, x).otherwise(own))
        spdx = F.nullif(F.regexp_extract(F.get(lines, i), SPDX, 1), F.lit(""))
        return _with(_with(one(i, i), lambda own: F.when(own["best"]["score"] >= threshold, own).otherwise(wide(own))), lambda x: F.struct(x["best"].alias("best"), x["first"].alias("first"), x["last"].alias("last"), spdx.alias("spdx")))

    return F.transform(cued, entry)


def _spdx_name(tag: Column) -> Column:
    """A tag's licence by the names of TEMPLATES where it is one of theirs, whatever its case or -only, -or-later and +; other licences and expressions as they stand."""
    known = {n.lower(): n for n, _ in TEMPLATES if n != "proprietary"}
    whole = F.regexp_replace(F.regexp_replace(tag, r"^\(([^()]*)\)$", "$1"), r"[ \t]+", " ")
    plain = F.regexp_replace(F.lower(whole), r"(?:-only|-or-later|\+)$", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), plain), whole)


def scan_licenses(df: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, without text_col, with own_license, own_score, is_license_file, license, origin and origin_dir.

    A header is a line (split at \\n) with a cue; its score is its highest cosine to a template. A cue line that doesn't reach the
    threshold is scored with the lines beside it (WINDOWS) too, and that counts where it reaches it. own_license is that of the first
    SPDX tag but NONE and NOASSERTION (score 1); or else of the full licence text (FULL_TEXTS) that the whole file reaches the
    threshold with; or else of the best header of at least `threshold` (the first template wins a tie). own_score is its score or that
    of the best cue line, 0 where there is none. A licence file is one whose whole text reaches the threshold with a template or a
    full licence text, or whose licence lines hold half of its terms; an SPDX tag alone makes none. license: the file's
    own (origin `header`), or that of the best licence file in its directory or the nearest one above (origin `directory`, in
    origin_dir; ties go to the smaller path), or null (origin `none`). Null and empty texts have no own licence but inherit; null
    paths inherit nothing. Repeated rows each have their result. Columns with these names are replaced. An empty table gives an empty table.

    Texts are read once, in place (verdicts are cut durably); only paths and verdicts are shuffled, once by
    directory (but for directories of very many files, whose verdicts are broadcast), and directories meet their ancestors.
    """
    new = {"own_license", "own_score", "is_license_file", "license", "origin", "origin_dir", text_col.lower()}
    names = [c for c in df.columns if c.lower() not in new]
    text, path = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{path_col}`")
    names_of = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    held = F.lit(False)
    for core in CUE_CORES:  # a cheap test that each text with a cue passes
        held = held | text.contains(core)
    split = F.split(text, "\n")
    lines = F.when(held, _with(split, lambda x: _about(x, threshold)))
    rows = df.select(packed_rest(names).alias("_rest"), path.alias("_path"), text.alias("_text"), lines.alias("_lines"))
    found = F.filter("_lines", lambda x: x["best"]["score"] >= threshold)
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["first"], x["last"]))))
    best = F.array_max(F.transform("_lines", lambda x: x["best"]))
    counted = lambda x: F.aggregate(covered, F.lit(0), lambda a, i: a + F.size(_terms(F.get(x, i))))
    words = F.when(F.size(found) > 0, _with(F.split("_text", "\n"), counted)).otherwise(F.lit(0))
    tags = F.filter(F.transform("_lines", lambda x: x["spdx"]), lambda x: x.isNotNull() & ~x.isin("NONE", "NOASSERTION"))
    legal = functools.reduce(lambda p, q: p | q, [F.col("_text").contains(core) for core in FULL_CORES])
    whole = F.when((F.size("_lines") > 0) | legal, _terms(F.col("_text")))
    rows = rows.select("*", best.alias("_best"), whole.alias("_whole"), words.alias("_n"), _spdx_name(F.get(tags, F.lit(0))).alias("_spdx")).drop("_lines", "_text")

    anchors = list(FULL_TEXTS.values())
    body = F.concat(F.lit(" "), F.array_join("_whole", " "), F.lit(" "))
    stands = lambda x, k: x.contains(f" {anchors[k]} ")
    full = _with(body, lambda x: F.when(functools.reduce(lambda p, q: p | q, [stands(x, k) for k in range(len(anchors))]), _best(F.col("_whole"), full_texts(), lambda k: stands(x, k))))
    rows = rows.withColumn("_full", F.when(F.size("_whole") > 0, full))
    text_of = F.when(F.col("_full.score") >= threshold, F.get(F.array(*[F.lit(n) for n in FULL_TEXTS]), -F.col("_full.k")))
    notice = F.when(F.col("_best.score") >= threshold, F.get(names_of, -F.col("_best.k")))
    own = F.coalesce("_spdx", text_of, notice)
    own_score = F.when(F.col("_spdx").isNotNull(), 1.0).when(text_of.isNotNull(), F.col("_full.score")).otherwise(F.coalesce("_best.score", F.lit(0.0)))
    file_score = F.when(F.col("_whole").isNotNull(), _best(F.col("_whole"), tuple(t for _, t in TEMPLATES))["score"]).otherwise(F.lit(0.0))
    is_file = F.coalesce(text_of.isNotNull() | (notice.isNotNull() & ((file_score >= threshold) | (F.col("_n") >= SHARE * F.size("_whole")))), F.lit(False))
    folder = F.when(F.instr("_path", "/") > 0, F.regexp_extract("_path", "^(.*)/", 1)).when(F.col("_path").isNotNull(), F.lit(""))
    files = rows.select("_rest", "_path", own.alias("own_license"), own_score.alias("own_score"), is_file.alias("is_license_file"), folder.alias("_dir"))

    files = durable(files)  # one pass over the texts

    # Each directory's own licence; then each directory's nearest at or above it.
    rank = F.struct((-F.col("own_score")).alias("s"), F.col("_path").alias("p"), F.col("own_license").alias("l"))
    granted = files.where("is_license_file and _dir is not null").groupBy(F.col("_dir").alias("above")).agg(F.min(rank).alias("r")).select("above", F.col("r.l").alias("given"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = files.where("_dir is not null").select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(granted, "above").groupBy("_dir").agg(F.max(F.struct(F.length("above").alias("n"), F.col("above"), F.col("given"))).alias("r"))
    nearest = nearest.select("_dir", F.col("r.above").alias("_above"), F.col("r.given").alias("_given"))

    # Directories of more than one row in HOT are fewer than HOT: their verdicts are broadcast, so no directory's files gather in one task.
    counts = files.where("_dir is not null").groupBy("_dir").agg(F.count(F.lit(1)).alias("_c"))
    hot = counts.where(F.col("_c") * F.lit(HOT) > F.lit(files.count())).select("_dir").join(nearest, "_dir", "left").withColumn("_hot", F.lit(True))
    marked = files.join(F.broadcast(durable(hot)), "_dir", "left")
    cold = marked.where("_hot is null").drop("_above", "_given").join(nearest, "_dir", "left").select(*marked.columns)
    out = marked.where("_hot").union(cold)
    return out.select(
        *unpacked("_rest", names), "own_license", "own_score", "is_license_file", F.coalesce("own_license", "_given").alias("license"),
        F.when(F.col("own_license").isNotNull(), "header").when(F.col("_given").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.col("own_license").isNull(), F.col("_above")).alias("origin_dir"),
    )
