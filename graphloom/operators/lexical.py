"""Full-text search: an index of token positions, ranked terms, phrases, literals, and a publication fence."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_tokens, alias_words, occurrences

MAX_CHUNKS, MAX_FILES, MAX_LITERAL_DOCS, MAX_LITERAL_BYTES, MAX_PER_FILE = 5000, 1000, 4096, 16 << 20, 1024
WEIGHT_ALIAS, WEIGHT_TEXT = 1.0, 0.1
WORD = re.compile(r"\w+")  # letters, numbers and underscores, as tokens() has them


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def postings(chunks: DataFrame, key: list[str], path_col: str = "path", text_col: str = "chunk_text") -> DataFrame:
    """(key, token, position, weight): alias tokens first, with the greater weight, then the text's."""
    aliases, words = alias_tokens(F.col(path_col), F.col(text_col)), tokens(F.col(text_col))
    both = F.concat(F.transform(aliases, lambda t: F.struct(t.alias("t"), F.lit(WEIGHT_ALIAS).alias("w"))), F.transform(words, lambda t: F.struct(t.alias("t"), F.lit(WEIGHT_TEXT).alias("w"))))
    return chunks.select(*key, F.posexplode(both).alias("position", "_e")).select(*key, F.col("_e.t").alias("token"), (F.col("position") + 1).alias("position"), F.col("_e.w").alias("weight"))


@dataclass(frozen=True)
class Query:
    """A disjunction of conjunctions of phrases, each plain or negated."""

    any_of: tuple[tuple[tuple[tuple[str, ...], bool], ...], ...]

    @property
    def words(self) -> list[str]:
        return sorted({w for group in self.any_of for phrase, negated in group if not negated for w in phrase})


def parse_web_query(text: str) -> Query:
    """Words, "quoted phrases", or, and - before a word or phrase, as web search engines have it."""
    groups: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        phrase = m[2] if m[2] is not None else m[4]
        if m[2] is None and phrase.lower() == "or":
            groups.append([])
            continue
        words = tuple(re.findall(r"[^\W]+", phrase.lower()))
        if words:
            groups[-1].append((words, bool(m[1] or m[3])))
    return Query(tuple(tuple(g) for g in groups if g))


def phrase_text(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def satisfies(text: Column, query: Query) -> Column:
    """Whether a text holds the query's words and phrases."""
    body, words = phrase_text(tokens(text)), tokens(text)
    out = F.lit(False)
    for group in query.any_of:
        every = F.lit(True)
        for phrase, negated in group:
            has = F.array_contains(words, phrase[0]) if len(phrase) == 1 else F.contains(body, F.lit(" " + " ".join(phrase) + " "))
            every = every & (~has if negated else has)
        out = out | every
    return out


def cover_density(positions: np.ndarray, weights: np.ndarray, token: np.ndarray, n_tokens: int) -> float:
    """Rank by cover density: each shortest span with all tokens counts its weighted words over the noise within, scaled r / (r + 1)."""
    order = np.argsort(positions, kind="stable")
    pos, w, tok = positions[order], weights[order], token[order]
    last, total, have = {}, 0.0, -1
    for p, q, t in zip(pos.tolist(), w.tolist(), tok.tolist(), strict=True):
        last[t] = (p, q)
        if len(last) == n_tokens:
            begin = min(x[0] for x in last.values())
            if begin > have:  # a cover that no earlier one contains
                have = begin
                inverse = sum(1.0 / x[1] for x in last.values())
                noise = max(0, (p - begin) - (n_tokens - 1))
                total += n_tokens / inverse / (1.0 + noise)
    return round(total / (total + 1.0), 8)


def ranked(chunks: DataFrame, query_text: str, key: list[str], path_col: str = "path", text_col: str = "chunk_text", file_key: list[str] | None = None, max_chunks: int = MAX_CHUNKS, max_files: int = MAX_FILES) -> tuple[str, DataFrame]:
    """("ok", matching chunks with a score, best first) or ("candidate_overflow", no rows) beyond the feature's limits of chunks and files."""
    query = parse_web_query(query_text)
    found = chunks.withColumn("score", chunk_scores(query)(F.col(path_col), F.col(text_col))).where("score is not null")
    n = chunks.count()  # reads no text; only where there are more rows than a limit, texts are searched to see whether it is met
    over = (n > max_chunks and found.limit(max_chunks + 1).count() > max_chunks) or (file_key is not None and n > max_files and found.select(*file_key).distinct().limit(max_files + 1).count() > max_files)
    if over:
        return "candidate_overflow", chunks.limit(0).withColumn("score", F.lit(0.0))
    found = found.repartition(*key)  # a sort samples what it sorts, and would search the texts again for that
    return "ok", found.orderBy(F.desc("score"), *key) if query.words else found.orderBy(*key)


def chunk_score(query: Query):
    """A function of a chunk's path and text: its rank, 0 for a query without plain words, None where the query isn't satisfied.

    Aliases and words are those of postings(), the test is that of satisfies().
    """
    words = {w: i for i, w in enumerate(query.words)}

    def one(path: str | None, text: str | None) -> float | None:
        low = (text or "").lower()
        found = WORD.findall(low)
        held, body, bare = set(found), None, f"{(path or '').lower()} {low}"
        for separator in "/_.:-":
            bare = bare.replace(separator, "")
        # Aliases are parts of names without separators, so most texts that don't satisfy a query are known before theirs are read.
        if not any(all(not (len(p) == 1 and p[0] in held) if negated else all(w in bare or w in held for w in p) for p, negated in group) for group in query.any_of):
            return None
        aliases = alias_words(path, text) if path is not None and text is not None else []
        found = aliases + found
        held.update(aliases)
        for group in query.any_of:
            for phrase, negated in group:
                has = all(w in held for w in phrase)
                if has and len(phrase) > 1:
                    body = body or f" {' '.join(found)} "
                    has = f" {' '.join(phrase)} " in body
                if has == negated:
                    break
            else:
                break
        else:
            return None
        if not words:
            return 0.0
        if path is None or text is None or held.isdisjoint(words):
            return None
        at = [(i, words[w]) for i, w in enumerate(found, 1) if w in words]
        place = np.array([p for p, _ in at])
        return cover_density(place, np.where(place <= len(aliases), WEIGHT_ALIAS, WEIGHT_TEXT), np.array([t for _, t in at]), len({t for _, t in at}))

    return one


def chunk_scores(query: Query):
    """chunk_score as a column's function: each chunk is read once, in its own row."""
    one = chunk_score(query)

    @F.pandas_udf("double")
    def score(paths, texts):
        return pd.Series([one(p, t) for p, t in zip(paths, texts, strict=True)], dtype="float64")

    return score.asNondeterministic()  # else a filter on it would compute it again


def phrase(chunks: DataFrame, query_text: str, key: list[str], text_col: str = "chunk_text") -> DataFrame:
    """Chunks whose text holds the query's words next to each other."""
    words = re.findall(r"[^\W]+", query_text.lower())
    body = phrase_text(tokens(F.col(text_col)))
    return chunks.where(F.contains(body, F.lit(" " + " ".join(words) + " ")) if words else F.lit(False)).orderBy(*key)


def literal(docs: DataFrame, needle: str, key: list[str], text_col: str = "text", max_docs: int = MAX_LITERAL_DOCS, max_bytes: int = MAX_LITERAL_BYTES, per_file: int = MAX_PER_FILE) -> tuple[str, DataFrame]:
    """("ok", occurrences with a flag on capped files) or ("overflow", no rows) beyond the feature's limits of documents and bytes."""
    size = docs.where(F.contains(text_col, F.lit(needle))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    hits = occurrences(docs.select(*key, text_col), needle, text_col)
    if size["n"] > max_docs or size["b"] > max_bytes:
        return "overflow", hits.limit(0).withColumn("capped", F.lit(False))
    from pyspark.sql import Window

    w = Window.partitionBy(*key)
    numbered = hits.withColumn("_n", F.row_number().over(w.orderBy("pos"))).withColumn("capped", F.count(F.lit(1)).over(w) > per_file)
    return "ok", numbered.where(F.col("_n") <= per_file).drop("_n").orderBy(*key, "pos")


# States of a publication fence, in the order in which they are tried.
FENCE = (
    "repository_missing", "run_missing", "run_incomplete", "lexical_missing", "lexical_building", "lexical_revoked", "lexical_invalidated", "policy_mismatch", "run_mismatch", "source_generation_stale", "config_generation_stale",
    "extractor_generation_stale", "canonicalizer_generation_stale", "bundle_mismatch", "privacy_refused",
)


def fence(conditions: dict[str, Column]) -> Column:
    """The first state of FENCE whose condition holds, else ok."""
    out = F.lit("ok")
    for state in reversed(FENCE):
        if state in conditions:
            out = F.when(F.coalesce(conditions[state], F.lit(False)), state).otherwise(out)
    return out


def covering_chunk(occurrences: DataFrame, chunks: DataFrame, keys: list[str], occurrence_id: list[str], bin_lines: int = 64) -> DataFrame:
    """Each occurrence with the chunk of its file that covers its line, the first by ordinal; the file's first chunk where none does; null without chunks.

    occurrences(keys, start_line, ...), chunks(keys, chunk_ordinal, start_line, end_line, chunk_id). A bin of a file's lines holds its chunks in one
    row, so an occurrence meets one row by file and bin, and one by file: it is dealt out twice, never multiplied nor gathered again by its id.
    """
    chunk = F.struct("chunk_ordinal", "chunk_id")
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines)))
    spans = chunks.select(*keys, bins.alias("_bin"), F.struct(chunk.alias("chunk"), F.col("start_line").alias("a"), F.col("end_line").alias("z")).alias("_span")).groupBy(*keys, "_bin").agg(F.collect_list("_span").alias("_spans"))
    first = chunks.groupBy(*keys).agg(F.min(chunk).alias("_first"))
    at = occurrences.withColumn("_bin", F.floor(F.col("start_line") / bin_lines)).join(spans, [*keys, "_bin"], "left")
    covers = F.array_min(F.transform(F.filter("_spans", lambda s: F.col("start_line").between(s["a"], s["z"])), lambda s: s["chunk"]))
    out = at.select(*occurrences.columns, covers.alias("_covers")).join(first, keys, "left")
    return out.select(*occurrences.columns, F.coalesce(F.col("_covers.chunk_id"), F.col("_first.chunk_id")).alias("chunk_id"), F.col("_covers").isNotNull().alias("covered"))


#: What a lexical generation must have in common with the authority that names it and with the run behind it.
AUTHORITY_FIELDS = ("run_id", "publication_bundle_id", "snapshot_manifest_id", "policy_digest")


def active_authority(authority: DataFrame, generations: DataFrame, runs: DataFrame) -> DataFrame:
    """Each repository's authority with the generation that it names and the run behind it, and the status of the fence: current, or the first field that disagrees."""
    ids = ["repository_id", "lexical_generation_id"]
    gen = generations.select(*ids, *[F.col(c).alias(f"gen_{c}") for c in AUTHORITY_FIELDS], F.col("state").alias("gen_state"))
    run = runs.select("repository_id", "run_id", *[F.col(c).alias(f"run_{c}") for c in AUTHORITY_FIELDS[1:3]], F.col("status").alias("run_status"))
    out = authority.select(*ids, *AUTHORITY_FIELDS).join(gen, ids).join(run, ["repository_id", "run_id"])
    status = F.when(F.col("gen_state") != "published", "state").when(F.col("run_status") != "complete", "run_status")
    for c in AUTHORITY_FIELDS:
        status = status.when(~F.col(c).eqNullSafe(F.col(f"gen_{c}")), c)
    for c in AUTHORITY_FIELDS[1:3]:
        status = status.when(~F.col(c).eqNullSafe(F.col(f"run_{c}")), f"run_{c}")
    return out.withColumn("fence", status.otherwise("current"))
