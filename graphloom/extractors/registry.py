"""Extractors by language, applied to a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical_json
from ..schema import OBS
from . import code, documents
from .common import obs

EXTRACTORS = {
    "python": code.python, "requirements": code.requirements, **{lang: code.by_rules(lang) for lang in code.RULES}, **{d: code.shell(d) for d in ("shell", "bash", "zsh")},
    "markdown": documents.markdown, "html": documents.html, "css": documents.css, "feed": documents.feed, "eml": documents.mail, "mbox": documents.mail, "csv": documents.table, "tsv": documents.table,
    "latex": documents.latex, "text": documents.plain, "xml": documents.xml, "odf": documents.plain, **{k: documents.config(k) for k in ("json", "jsonc", "jsonl", "toml", "yaml", "plist")},
}
#: Languages whose undecodable files give a parse error instead of nothing.
REPORTING = ("eml", "mbox", "csv", "tsv", "latex", "text", "odf")


def extract_file(path: str, language: str, content: bytes, metadata: dict | None = None) -> list[dict]:
    """A file's own observation, then those of its language's extractor, in order."""
    out = [obs("file", path, name=path, language=language, **(metadata or {}))]
    run = EXTRACTORS.get("requirements" if language == "python" and path.endswith(".txt") else language)
    if run is None:
        return out
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return out + ([obs("document.parse_error", path, 1, reason="encoding")] if language in REPORTING else [])
    try:
        return out + run(path, text.replace("\r\n", "\n").replace("\r", "\n"))
    except Exception as e:  # an extractor reports what it can't read, and goes on with other files
        return [*out, obs(f"{'config' if language in ('json', 'jsonc', 'jsonl', 'toml', 'yaml', 'plist', 'xml') else language}.parse_error", path, 1, reason=type(e).__name__)]


def extract(files: DataFrame, run_id: int = 1) -> DataFrame:
    """Observations (schema.OBS) of files (path, language, content, role, content_hash, executable, generated).

    A file's observations come from one task; ordinals number them by path and place in the file, in two steps (counts per path, then
    a running sum), so a repository of any size has no single numbering task but over its paths' counts per directory.
    """
    facts = ("role", "content_hash", "executable", "generated")
    have = [f for f in facts if f in files.columns]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                for k, o in enumerate(extract_file(r["path"], r["language"], bytes(r["content"]), {f: (bool(r[f]) if f in ("executable", "generated") else r[f]) for f in have})):
                    rows.append((r["path"], k, o["kind"], o["source_id"], o["confidence"], o["extractor"], o["extractor_version"], o["start_line"], o["end_line"], o["name"], o["target"], canonical_json(o["metadata"])))
            out = pd.DataFrame(rows, columns=["path", "place", "kind", "source_id", "confidence", "extractor", "extractor_version", "start_line", "end_line", "name", "target", "metadata"])
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    raw = files.select("path", "language", "content", *have).mapInPandas(run, "path string, place int, kind string, source_id string, confidence string, extractor string, extractor_version string, start_line int, end_line int, name string, target string, metadata string")
    return numbered(raw, run_id)


def numbered(raw: DataFrame, run_id: int) -> DataFrame:
    """Ordinals from 0 in the order of path and place."""
    from pyspark.sql import Window

    folder = F.regexp_extract("path", "^(.*)/", 1)
    raw = raw.withColumn("_dir", folder)
    per_path = raw.groupBy("_dir", "path").agg(F.count(F.lit(1)).alias("_n"))
    per_dir = per_path.groupBy("_dir").agg(F.sum("_n").alias("_m"))
    dirs = per_dir.withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_dir").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each directory
    inner = Window.partitionBy("_dir").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_path.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(dirs.select("_dir", "_before"), "_dir").select("path", (F.col("_before") + F.col("_inner")).alias("_start"))
    out = raw.drop("_dir").join(starts, "path").withColumn("ordinal", (F.col("_start") + F.col("place")).cast("bigint")).withColumn("run_id", F.lit(run_id).cast("bigint")).withColumn("schema_version", F.lit(1))
    return out.select(*[c.strip().split()[0] for c in OBS.split(",")])
