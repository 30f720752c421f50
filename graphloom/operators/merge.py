"""Merges, guards and digests of the row families."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.keys import canonical_json, confidence_rank


def first_wins(df: DataFrame, keys: list[str], ordinal: str, last: bool = False) -> DataFrame:
    """One row per key: that with the least ordinal (or the greatest). A map-side minimum of structs, so a hot key doesn't gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(ordinal, *[c for c in rest if c != ordinal])
    best = df.groupBy(*keys).agg((F.max_by if last else F.min_by)(row, F.col(ordinal)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return first_wins(df, keys, ordinal, last=True)


def upsert(current: DataFrame, proposed: DataFrame, keys: list[str], run_id: int | None = None) -> DataFrame:
    """The table after an upsert: proposed rows replace current ones of equal keys; first_seen_run_id of the current row stays, if there is one."""
    c, p = current.alias("c"), proposed.alias("p")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    both = c.withColumn("_c", F.lit(True)).join(p.withColumn("_p", F.lit(True)), on, "full_outer")
    out = []
    for name in current.columns:
        new, old = F.col(f"p.{name}") if name in proposed.columns else F.lit(None), F.col(f"c.{name}")
        if name == "first_seen_run_id":
            out.append(F.coalesce(old, new, F.lit(run_id)).alias(name))
        elif name == "last_seen_run_id" and run_id is not None:
            out.append(F.when(F.col("_p"), F.lit(run_id)).otherwise(old).alias(name))
        else:
            out.append(F.when(F.col("_p"), new).otherwise(old).alias(name))
    return both.select(*out)


def identity_conflicts(df: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """Keys whose rows differ in payload, with the number of different ones."""
    return df.groupBy(*keys).agg(F.countDistinct(payload).alias("n_payloads")).where("n_payloads > 1")


def missing_references(rows: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose column names no parent: the guard that must be empty."""
    return rows.join(parents.select(F.col(parent_column).alias("_parent")), rows[column] == F.col("_parent"), "left_anti")


def integrity_violations(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, node_links: DataFrame, edge_links: DataFrame) -> DataFrame:
    """(guard, key) of every row that names a missing parent, over the families."""
    checks = [
        ("edge_source", edges, "source_canonical_key", nodes, "canonical_key"), ("edge_target", edges, "target_canonical_key", nodes, "canonical_key"),
        ("node_link_node", node_links, "canonical_key", nodes, "canonical_key"), ("node_link_evidence", node_links, "evidence_key", evidence, "evidence_key"),
        ("edge_link_edge", edge_links, "edge_key", edges, "edge_key"), ("edge_link_evidence", edge_links, "evidence_key", evidence, "evidence_key"),
    ]
    out = None
    for guard, rows, column, parents, parent in checks:
        bad = missing_references(rows, column, parents, parent).select(F.lit(guard).alias("guard"), F.col(column).alias("key"))
        out = bad if out is None else out.union(bad)
    return out


def fold_values(values: list[dict]) -> tuple[dict, bool]:
    """Metadata folded in order: equal values stay, lists take in distinct members, true wins for privileged_observed, other conflicts become [old, new]."""
    out: dict = {}
    conflict = False
    for v in values:
        for k, new in v.items():
            if k not in out:
                out[k] = new
            elif k == "privileged_observed":
                out[k] = bool(out[k]) or bool(new)
            elif canonical_json(out[k]) != canonical_json(new):
                if isinstance(out[k], list) and isinstance(new, list):
                    seen = {canonical_json(x) for x in out[k]}
                    out[k] = out[k] + [x for x in new if canonical_json(x) not in seen and not seen.add(canonical_json(x))]
                else:
                    out[k], conflict = [out[k], new], True
    return out, conflict


@F.pandas_udf(StringType())
def folded_metadata(rows):
    """Canonical JSON of metadata texts of a key, folded in the order of the array."""
    return rows.map(lambda texts: canonical_json(fold_values([json.loads(t) if t else {} for t in texts])[0]))


def upsert_nodes(proposals: DataFrame) -> DataFrame:
    """Node rows from proposals (canonical_key, kind, display_name, metadata, confidence, ordinal): the first metadata and name, the strongest confidence."""
    return proposals.groupBy("canonical_key").agg(
        F.min_by("kind", "ordinal").alias("kind"), F.min_by("display_name", "ordinal").alias("display_name"), F.min_by("metadata", F.struct((F.coalesce("metadata", F.lit("{}")) == "{}"), "ordinal")).alias("metadata"),
        F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
    )


def upsert_edges(proposals: DataFrame) -> DataFrame:
    """Edge rows from proposals (edge_key, ..., metadata, confidence, ordinal): metadata folded in order, the strongest confidence.

    Equal metadata are dropped before they are gathered, so an edge with many pieces of evidence gathers its different metadata only.
    """
    keys = ["edge_key", "source_canonical_key", "edge_kind", "target_canonical_key", "identity_metadata"]
    different = proposals.groupBy(*keys, "metadata").agg(F.min("ordinal").alias("o"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"))
    out = different.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("o", "metadata"))).alias("_m"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"))
    return out.select(*keys, folded_metadata(F.transform("_m", lambda x: x["metadata"])).alias("metadata"), "confidence")


def file_nodes(files: DataFrame) -> DataFrame:
    """File nodes from (path, name, value, ordinal) facts: distinct values by first appearance; conflict where a decisive name has two."""
    decisive = ("language", "content_hash", "executable", "generated")
    seen = files.groupBy("path", "name", "value").agg(F.min("ordinal").alias("o"))
    per_name = seen.groupBy("path", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]).alias("values"))
    return per_name.groupBy("path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("facts"), F.max(F.col("name").isin(*decisive) & (F.size("values") > 1)).alias("conflict")
    )


def family_checksum(rows: DataFrame, identity: Column, payload: Column) -> dict[str, object]:
    """An order-independent checksum of a family: sums, modulo 2**256, of row hashes of identity, and of identity and payload, with count and bytes.

    Partial sums of each 32-bit word of the hashes are added by Spark; only one row reaches the driver.
    """
    a, b = F.sha2(identity.cast("binary"), 256), F.sha2(F.concat(identity, F.lit("\x00"), payload).cast("binary"), 256)
    word = lambda h, i: F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(30,0)"))
    sums = [word(h, i).alias(f"{n}{i}") for n, h in (("a", a), ("b", b)) for i in range(8)]
    r = rows.agg(*sums, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(identity) + F.octet_length(payload)), F.lit(0)).alias("size")).first()
    total = lambda n: sum(int(r[f"{n}{i}"] or 0) << (32 * (7 - i)) for i in range(8)) % 2**256
    digest = hashlib.sha256(f"{r['n']}:{r['size']}:{total('a'):064x}:{total('b'):064x}".encode()).hexdigest()
    return {"rows": r["n"], "bytes": r["size"], "digest": digest}


def structural_digest(families: dict[str, tuple[DataFrame, list[str], list[str]]]) -> str:
    """A digest over named families (rows, identity columns, payload columns), independent of row order and partitioning."""
    h = hashlib.sha256()
    for name in sorted(families):
        rows, ids, rest = families[name]
        text = lambda cols: F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}) if cols else F.lit("")
        h.update(canonical_json([name, family_checksum(rows, text(ids), text(rest))]).encode())
    return "structure:" + h.hexdigest()
