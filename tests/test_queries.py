"""Registered queries give the rows of their SQL."""

import duckdb
import pytest

from graphloom.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, db, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(db.execute(SQL[name]).df())


def test_whole_inputs(spark, sf, db):
    """Anchors come of whole texts, and all customers enter the merge."""
    anchors = [r["anchor"] for r in QUERIES["markdown_anchors"](spark, sf).collect()]
    assert max(map(len, anchors)) > 72 and len(anchors) == db.execute("SELECT count(*) FROM benchmark").fetchone()[0]
    out = QUERIES["upsert"](spark, sf).collect()
    assert {r["k"] for r in out if r["k"] >= 0} == {k for (k,) in db.execute("SELECT c_custkey FROM customer").fetchall()}
    assert {(r["first_seen_run_id"], r["last_seen_run_id"]) for r in out} == {(1, 1), (1, 2), (2, 2)}


def test_every_seed(spark, sf, db):
    """Each vec_id divisible by 50 is a seed with its own 25 rows."""
    seeds = [r["seed"] for r in QUERIES["nearest_vectors_each"](spark, sf).collect()]
    assert {s: seeds.count(s) for s in seeds} == {k: 25 for (k,) in db.execute("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()}


def test_nearest_each_blocks(spark, monkeypatch):
    """Small blocks and tiles, copies, ties, ids given twice, vectors without direction, missing ones and other lengths: the rows of plain SQL, without a join of all pairs."""
    import random

    from pyspark.sql import functions as F

    from graphloom.operators import similar

    monkeypatch.setattr(similar, "TILE_ROWS", 16)
    monkeypatch.setattr(similar, "TILE_SEEDS", 3)
    r = random.Random(3)
    data = [(i, [r.choice((-1.0, 0.5, 1.0)) for _ in range(4)] if i % 3 else [r.random() for _ in range(4)]) for i in range(160)] + [(1000 + i, [0.5, 1.0, 0.5, 1.0]) for i in range(40)] + [(7, [1.0, 2.0, 3.0, 5.0])]
    odd = [(2000, [0.0] * 4), (2001, None), (2002, [1.0, 2.0]), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0, 1.0])]
    for rows, k in ((data, 5), (data[:9] + odd, 12)):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        seeds = df.where("vec_id % 4 = 0 or vec_id = 7 or vec_id > 2000")
        out = similar.nearest_each(df, seeds, k, block_rows=50, seed_rows=20)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = sorted((x["seed"], x["vec_id"], repr(x["distance"])) for x in out.collect())
        cos = F.try_divide(similar.dot(F.col("embedding"), F.col("q")), similar.norm(F.col("embedding")) * similar.norm(F.col("q")))
        none = similar.dot(F.col("embedding"), F.col("q")).isNotNull() & cos.isNull()
        pairs = df.crossJoin(seeds.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("q"))).where("vec_id <> seed").withColumn("distance", F.when(none, float("nan")).otherwise(F.round(1 - cos, 8)))
        want = sorted((x["seed"], x["vec_id"], x["distance"]) for x in pairs.select("seed", "vec_id", "distance").collect() if x["distance"] == x["distance"] and x["distance"] is not None)
        want += [(x["seed"], x["vec_id"], float("nan")) for x in pairs.collect() if x["distance"] is not None and x["distance"] != x["distance"]] + [(x["seed"], x["vec_id"], None) for x in pairs.collect() if x["distance"] is None]
        order = lambda x: (x[2] is None, x[2] is not None and x[2] != x[2], x[2] if x[2] is not None and x[2] == x[2] else 0, x[1])
        best = [(s, v, repr(d)) for one in {x[0] for x in want} for s, v, d in sorted((x for x in want if x[0] == one), key=order)[:k]]
        assert got == sorted(best)


def test_ranked_in_one_pass(spark):
    """Ranks are those of postings and satisfies over odd texts; each text is read once, without rows for its tokens or a join."""
    import numpy as np
    from pyspark.sql import functions as F

    from graphloom.operators import lexical

    texts = ["of the", "of  THE, shall", "ofThe x of_the", "OF-the/of.the", "ΣΑΣ of İthe the of²", "a1b2 the of the of", "", "of\nthe of Éthe", "XMLHttp2Of the", "o-f the", "the of " * 50, "é_of the_é of the", None, "of Ⅷ the ½", "s-hall of the", "of é the"]
    rows = [(i, p, t) for i, t in enumerate(texts * 2) for p in (["d", "src/of_the.py"][i // len(texts)],)] + [(99, None, "of the")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, chunk_text string")
    for text in ('"of the" -shall', "of or the", '-"of the"', "of2 or xml the", "²", "shall -of"):
        query = lexical.parse_web_query(text)
        status, out = lexical.ranked(df, text, ["doc_id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert status == "ok" and "Generate" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") <= 1
        hit = df.where(lexical.satisfies(F.concat_ws(" ", F.array_join(lexical.alias_tokens(F.col("path"), F.col("chunk_text")), " "), F.col("chunk_text")), query))
        want = {r["doc_id"]: 0.0 for r in hit.collect()} if not query.words else {}
        places = {}
        for r in lexical.postings(hit, ["doc_id"]).where(F.col("token").isin(*query.words)).collect() if query.words else ():
            places.setdefault(r["doc_id"], []).append((r["position"], r["weight"], query.words.index(r["token"])))
        want |= {k: lexical.cover_density(*(np.array(c) for c in zip(*v, strict=True)), len({x[2] for x in v})) for k, v in places.items()}
        assert {r["doc_id"]: r["score"] for r in out.collect()} == want
    assert lexical.ranked(df, "of", ["doc_id"], max_chunks=3)[0] == "candidate_overflow" and lexical.ranked(df, "shall", ["doc_id"], max_chunks=10)[0] == "ok"
