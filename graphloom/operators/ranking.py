"""Intent ranking of candidates, and how ambiguous its top is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rank

TIERS = ["exactness_tier", "affinity_tier", "match_class_tier", "evidence_tier", "publication_tier"]


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name` = its place from 1 in the order of (groups, canonical_key, order), without a window over all rows.

    Rows are numbered within (groups, leading part of the key) and these by their counts. The leading part is what stands
    before the key's first colon with the two characters that follow, which sorts as keys do.
    """
    head = F.when(F.contains("canonical_key", F.lit(":")), F.substring("canonical_key", F.lit(1), F.locate(":", F.col("canonical_key")) + 2)).otherwise(F.col("canonical_key"))
    part, before = [*groups, "_head"], Window.orderBy(*groups, "_head").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_head", head)
    ahead = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each part
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy("canonical_key", *order)))
    return placed.join(ahead, part).select(*df.columns, (F.col("_ahead") + F.col("_place")).cast("int").alias(name))


def first_destination(locations: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate's least verified place, by binding, revision, snapshot, path, run, relation, namespace, graph path and lines; missing texts are empty, missing lines come last."""
    texts = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none).cast("long"))
    parts = [
        texts("source_binding_id"), whole("binding_revision", 0), texts("snapshot_id"), texts("source_relative_path"), whole("run_id", 0), texts("publication_relation"), texts("path_namespace"), texts("graph_path"),
        whole("start_line", 2**31 - 1), whole("end_line", 2**31 - 1),
    ]
    return locations.groupBy(*keys).agg(F.min(F.struct(F.lit(0).alias("absent"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])).alias("destination"))


def key_order(candidates: DataFrame) -> DataFrame:
    """The order without an intent: by key alone, each candidate of its kind only, unambiguous."""
    out = numbered(candidates, [], [], "rank").withColumn("match_class", F.lit("kind_only"))
    tiers = {"exactness_tier": F.lit(1), "affinity_tier": F.lit(1), "match_class_tier": F.lit(6), "evidence_tier": F.when(F.col("has_verified_direct_location"), 0).otherwise(2), "publication_tier": F.when(F.col("is_current_publication"), 0).otherwise(1)}
    return out.withColumns(tiers)


def rank_candidates(candidates: DataFrame, query: str, intent: str | None, destination: str = "destination") -> DataFrame:
    """Candidates with their tiers and rank, best first: by the five tiers, then key bytes, then destination.

    Candidates have canonical_key, kind, display_name, subject_family, has_direct_evidence, has_verified_direct_location,
    identity_withheld, is_current_publication and, if there is one, a destination column.
    """
    c = candidates.withColumn("match_class_tier", rank.match_class(query, F.col("canonical_key"), F.col("display_name")))
    c = c.withColumn("exactness_tier", F.when(F.col("match_class_tier") <= 2, 0).otherwise(1)).withColumn("affinity_tier", rank.affinity_tier(intent, F.col("kind"), F.col("subject_family")))
    c = c.withColumn("evidence_tier", rank.evidence_tier(F.col("identity_withheld"), F.col("has_verified_direct_location"), F.col("has_direct_evidence")))
    c = c.withColumn("publication_tier", F.when(F.col("is_current_publication"), 0).otherwise(1))
    c = c.withColumn("match_class", F.get(F.array(*[F.lit(x) for x in rank.MATCH_CLASSES]), F.col("match_class_tier")))
    return numbered(c, TIERS, [destination] if destination in candidates.columns else [], "rank")


def ambiguity(ranked: DataFrame) -> DataFrame:
    """One row: how many candidates tie with the top in the first three tiers, and whether that is ambiguous."""
    top = ranked.agg(F.min(F.struct(*TIERS[:3])).alias("top"))
    tied = ranked.crossJoin(top).where(F.struct(*TIERS[:3]) == F.col("top"))  # with one row
    n = tied.agg(F.count(F.lit(1)).alias("tied_top_count"))
    return n.select(F.when(F.col("tied_top_count") >= 2, "ambiguous").when(F.col("tied_top_count") == 1, "unambiguous").otherwise("empty").alias("status"), "tied_top_count")
