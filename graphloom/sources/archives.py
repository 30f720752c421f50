"""Bulk corpora and web archives."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify


def bulk_files(files: DataFrame, max_files: int | None = None, max_total_bytes: int | None = None, max_file_bytes: int | None = None, max_depth: int | None = None, extensions: tuple[str, ...] = (), hidden: bool = False) -> DataFrame:
    """A bulk source's files (path, length) with route, status and reason: `included`, or `skipped` by the first limit that holds.

    The limits on files and total bytes are the policy's own and count included files in order of path; without them nothing is ordered.
    """
    path, out = F.col("path"), files.withColumn("route", classify.bulk_route(F.col("path")))
    reason = F.when(path.rlike(r"(^|/)\.[^/]") & F.lit(not hidden), "hidden").when(F.col("route").isNull(), "unsupported_extension").when(F.col("route") == "archive", "packed_archive")
    if extensions:
        reason = reason.when(~classify.extension(path).isin(*[e.lstrip(".") for e in extensions]), "extension_not_included")
    if max_depth is not None:
        reason = reason.when(F.size(F.split(path, "/")) > max_depth, "max_depth")
    if max_file_bytes is not None:
        reason = reason.when(F.col("length") > max_file_bytes, "max_file_bytes")
    out = out.withColumn("reason", reason)
    if max_files is not None or max_total_bytes is not None:
        ok = F.col("reason").isNull()
        w = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
        n, size = F.sum(ok.cast("long")).over(w), F.sum(F.when(ok, F.col("length"))).over(w)
        over = F.when(ok & F.lit(max_files is not None) & (n > (max_files or 0)), "max_files").when(ok & F.lit(max_total_bytes is not None) & (size > (max_total_bytes or 0)), "max_total_bytes")
        out = out.withColumn("reason", F.coalesce("reason", over))
    return out.withColumn("status", F.when(F.col("reason").isNull(), "included").otherwise("skipped"))


def warc_records(data: bytes):
    """(offset, headers, payload) of each record; a truncated one ends the reading."""
    if data[:2] == b"\x1f\x8b":
        out, rest = b"", data
        while rest:
            z = zlib.decompressobj(31)
            out += z.decompress(rest) + z.flush()
            rest = z.unused_data
        data = out
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            if data[at : at + 1] in (b"\r", b"\n"):
                at += 1
                continue
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length") or 0)
        if end + 4 + size > len(data):
            return
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


# Payload routes by content type.
CONTENT_ROUTES = {
    "text/html": "html", "application/xhtml+xml": "html", "text/css": "css", "application/json": "json", "text/markdown": "markdown", "application/rss+xml": "feed", "application/atom+xml": "feed", "application/feed+json": "feed",
    "text/xml": "xml", "application/xml": "xml", "text/plain": "text", "text/javascript": "javascript", "application/javascript": "javascript", "text/csv": "csv",
}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of web archives: file, offset, type, uri (credentials and query values withheld), content_type, route, status, payload."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for offset, headers, payload in warc_records(bytes(content)):
                    status, kind, body = None, headers.get("content-type", ""), payload
                    if headers.get("warc-type") == "response" and payload.startswith(b"HTTP/"):
                        head, _, body = payload.partition(b"\r\n\r\n")
                        text = head.decode("latin-1")
                        status = int(m[1]) if (m := re.match(r"HTTP/\S+ (\d+)", text)) else None
                        kind = m[1] if (m := re.search(r"(?im)^content-type:\s*(\S+)", text)) else ""
                    uri = re.sub(r"//[^/@]*@", "//", headers.get("warc-target-uri", "").strip("<>"))
                    uri = re.sub(r"([?&][^=&#]+)=[^&#]*", r"\1=", uri)
                    kind = kind.split(";")[0].strip().lower()
                    rows.append((name, offset, headers.get("warc-type"), uri or None, kind or None, CONTENT_ROUTES.get(kind), status, body))
            yield pd.DataFrame(rows, columns=["file", "offset", "type", "uri", "content_type", "route", "http_status", "payload"]).astype({"http_status": "Int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", "content").mapInPandas(run, "file string, offset bigint, type string, uri string, content_type string, route string, http_status int, payload binary")
