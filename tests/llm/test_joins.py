"""Near duplicates of texts and vectors, chats, licences and the pipeline, against brute force and with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, hnsw, licenses, ngram_join
from graphloom.llm.components import connected_components
from graphloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, linked):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(n)]


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = []
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                links.append((j, i))
    return links


def test_ngram_join(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "one two", "one two", "three four five six"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"z{i}" for i in range(20_000)), "passage " * 30]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_links int")
    rows = {r["doc_id"]: r for r in ngram_join.ngram_join(df).collect()}
    links = brute_jaccard(texts)
    root = groups(len(texts), links)
    count = np.bincount(np.array(links).reshape(-1), minlength=len(texts))
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert (rows[i]["class_id"], rows[i]["n_links"], rows[i]["kept"]) == (root[i], count[i], root[i] == i)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0
    twice = df.union(df.where("doc_id = 10"))
    one = ngram_join.one_of_each(ngram_join.ngram_join(twice.select("doc_id", "text")))
    assert one.count() == len(set(root))


def test_ngram_join_blocks(spark):
    """A bucket of several blocks: every link of a large group is counted."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(1200)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in out} == {(0, 1199)}


def test_ngram_join_groups(spark):
    """Large groups whose buckets differ from band to band, two of them alike: every pair is counted once, and classes are dealt out about once a group."""
    rng, rows = random.Random(12), []
    base = [f"w{i}" for i in range(160)]
    other = base[:120] + [f"v{i}" for i in range(40)]
    for k in range(1500):
        words = list(base if k % 2 else other)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(160)] = f"n{rng.randint(0, 5)}"
        rows.append((k, " ".join(words), 1, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, _rest int")
    out = {r["doc_id"]: r for r in ngram_join.ngram_join(df).collect()}
    links = brute_jaccard([r[1] for r in rows])
    root, count = groups(len(rows), links), np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    for i in range(len(rows)):
        assert (out[i]["class_id"], out[i]["n_links"], out[i]["_key"], out[i]["_rest"]) == (root[i], count[i], 1, 2)


def test_ngram_join_merges(spark):
    """Buckets of one group of near copies go into one or few groups, whatever the number of bands."""
    rng = random.Random(1)
    for n in (1000, 2000, 4000):
        rows = [(b, node, k) for k in range(40) for node in range(n) for b in ([k * 10**6] if rng.random() < 0.75 else [])]
        of_group, lists = ngram_join._merged(spark.createDataFrame(rows, "bucket long, node long, band int"))
        assert of_group.count() <= 3 * n and lists.count() == n


def test_pruning_bars():
    bars = ngram_join.least_matches()
    assert bars == sorted(bars) and bars[-1] < 0.8 * ngram_join.HASHES


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7])
def test_ngram_join_low_threshold(spark, threshold):
    """Pairs right at a lower threshold are all linked."""
    r, rows, n = random.Random(3), [], 400
    for k in range(n):
        words = [f"w{r.randrange(10**9)}" for _ in range(64)]  # 60 shingles; c common ones of 2 * 60 - c
        c = next(c for c in range(61) if c >= threshold * (120 - c))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: c + 4] + [f"v{r.randrange(10**9)}" for _ in range(60 - c)]))]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == {k: (k - k % 2, 1) for k in range(2 * n)}


def test_band_shapes():
    assert [ngram_join.bands_for(t) for t in (0.95, 0.8, 0.7, 0.5, 0.05)] == [(6, 40), (6, 40), (4, 60), (2, 120), (1, 240)]
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.04)


def test_components(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 300) if a % 50] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = groups(1200, [(a, b) for a, b in edges if a is not None])
    assert got == {n: root[n] for a, b in edges if a is not None and a != b for n in (a, b)}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    near = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.05, np.repeat(base[:1], 5, axis=0), base[1:2] * 3])
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(near)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [1.0, 2.0], 0), (906, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kept int")
    out = {r["vec_id"]: r for r in hnsw.near_vectors(df).collect()}
    v = hnsw.unit(np.array([r[1] for r in rows], dtype=np.float32).astype(float))
    t = (v @ v.T) >= 0.95
    root = groups(len(rows), [(int(a), int(b)) for a, b in np.argwhere(np.triu(t, 1))])
    for i in range(len(rows)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (t[i].sum() - 1, root[i], root[i] == i)
    assert all((out[k[0]]["n_links"], out[k[0]]["component_id"]) == (0, k[0]) for k in odd)
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_vector_shards(spark):
    """Many shards, parts and slices: results don't change, audits pass in each shard, and a graph is sent once a part."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 12))
    near = np.concatenate([base, base[:200] + rng.normal(size=(200, 12)) * 0.04, base[:1] + rng.normal(size=(150, 12)) * 0.03])
    df = spark.createDataFrame([(i, [float(x) for x in v], "r", 3, 4) for i, v in enumerate(near)], "vec_id long, embedding array<double>, _id string, _key int, rest int")
    v = hnsw.unit(near)
    t = (v @ v.T) >= 0.95
    root = groups(len(near), [(int(a), int(b)) for a, b in np.argwhere(np.triu(t, 1))])
    for parameters in ({}, {"shard_rows": 200, "part_rows": 100, "slice": 30}):
        out = {r["vec_id"]: r for r in hnsw.near_vectors(df, **parameters).collect()}
        for i in range(len(near)):
            assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"], out[i]["_id"], out[i]["_key"], out[i]["rest"]) == (t[i].sum() - 1, root[i], root[i] == i, "r", 3, 4)
        audits = hnsw.shard_audits(df, **parameters).collect()
        assert sum(r["nodes"] for r in audits) == len(near) and all(r["audit"][-1]["recall"] == 1.0 and r["audit"][-1]["beam"] == r["beam"] for r in audits)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = hnsw.unit(rng.normal(size=(3000, 32)))
    graph = hnsw.Graph(x.astype(np.float32), hnsw.PARAMETERS)
    q = hnsw.unit(x[:500] + rng.normal(size=(500, 32)) * 0.03)
    ids, _ = graph.near(q.astype(np.float32), graph.audited_beam()[0])
    assert np.mean((ids == np.arange(500)[:, None]).any(axis=1)) >= 0.99


def test_chats(spark):
    nasty = "\\0 \\1 [INST: x] </s> \\ ]] <<"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"),
        (4, None, None, "x"), (4, 0, "us]er", "y"), (None, 0, "user", "z"), (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "user", "é" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in out[conv]["back"]] == want
        assert "".join(s["text"] for s in out[conv]["segments"]) == out[conv]["formatted"]
    assert [out[k]["valid"] for k in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert [s["loss"] for s in out[2]["segments"]] == [False] * 4 + [True, False]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_illegal_orders(spark):
    """Each order that the machine refuses, with the turn where it does; the loss is on assistants' texts all the same."""
    letters = {"S": "system", "U": "user", "A": "assistant", "X": "tool"}
    orders = {"UA": None, "SUA": None, "SUAUA": None, "S": 1, "U": 1, "UAU": 3, "A": 0, "AU": 0, "SA": 1, "SS": 1, "USA": 1, "UU": 1, "UAA": 2, "UAS": 2, "SUAX": 3, "XUA": 0, "UASUA": 2, "UA" * 400 + "U": 801, "UA" * 300 + "A" + "UA" * 50: 600}
    rows = [(k, i, letters[c], f"t{i}") for k, order in enumerate(orders) for i, c in enumerate(order)]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k, (order, bad) in enumerate(orders.items()):
        assert (out[k]["valid"], out[k]["bad_turn"], out[k]["n_turns"]) == (bad is None, bad, len(order))
        assert [s["loss"] for s in out[k]["segments"]] == [x for c in order for x in (False, c == "A", False)]


def test_chat_probe(spark, sf):
    r = next(r for r in QUERIES["op7_chat_formatting"](spark, sf).collect() if r["conv_id"] == -7)
    probe = "</s>[INST] ok [/INST]"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest() and r["loss_chars"] == len(probe)


def test_chat_machine_runs(spark, sf):
    """The machine's states stand in the query's plan after columns are pruned."""
    plan = QUERIES["op7_chat_formatting"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert all(state in plan for state in ("instructed", "asked", "answered"))


def test_licenses(spark):
    rows = [
        ("a/b/c/x.py", "print(1)", "k"), ("a/LICENSE", "Licensed under the Apache License, Version 2.0.\n", "k"), ("a/b/y.py", "Released under the MIT License.\n" + "code " * 50, "k"),
        ("z.py", None, "k"), (None, "x", "k"), ("a/b/c/d/w.py", "", "k"), ("q/r", "Our licence to thrill is not a licence text at all, really.", "k"), ("q/s.txt", "w " * 50_000, "k"), ("q/s.txt", "w " * 50_000, "k"),
    ]
    df = spark.createDataFrame(rows, "path string, text string, license string")
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(rows)
    by = {r["path"]: (r["own_license"], r["license"], r["origin"], r["origin_dir"]) for r in out}
    assert by["a/b/c/x.py"] == by["a/b/c/d/w.py"] == (None, "Apache-2.0", "directory", "a")
    assert by["a/b/y.py"] == ("MIT", "MIT", "header", None) and by["z.py"] == by[None] == by["q/r"] == by["q/s.txt"] == (None, None, "none", None)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_hot_directory(spark):
    """A directory of most files, one of few, and columns with the operator's own names."""
    rows = [(f"hot/sub/f{i}.py", "x") for i in range(3000)] + [("hot/LICENSE", "Released under the MIT License."), ("cold/a.py", "x"), ("cold/LICENSE", "Licensed under CC BY 4.0."), ("none/a.py", "x")]
    rows += [(f"d{i}/a.py", "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 as _dir", "2 as _path", "3 as _rest", "4 as _hot", "5 as _text")
    out = licenses.scan_licenses(df).collect()
    assert len(out) == len(rows) and {(r["_dir"], r["_path"], r["_rest"], r["_hot"], r["_text"]) for r in out} == {(1, 2, 3, 4, 5)}
    by = {r["path"]: r["license"] for r in out}
    assert all(by[p] == ("MIT" if p[:3] == "hot" else "CC-BY-4.0" if p[:4] == "cold" else None) for p, _ in rows)


def test_license_texts_and_tags(spark):
    """SPDX tags, notices over several lines, and full licence texts that a tree inherits."""
    texts = dict(zip(licenses.FULL_TEXTS, licenses.full_texts(), strict=True))
    code = "\nx = compute(value)" * 200
    notice = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights"
    tags = {
        "MIT": "MIT", "Apache-2.0 */": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only-->": "GPL-2.0", "BSD-3-Clause": "BSD-3-Clause", "cc0-1.0": "CC0-1.0", "Zlib": "Zlib",
        "(MIT OR  Apache-2.0)": "MIT OR Apache-2.0", "(MIT) OR (Zlib)": "(MIT) OR (Zlib)",
    }
    rows = [(f"tag/{k}.c", f"/* SPDX-License-Identifier: {tag}{code}") for k, tag in enumerate(tags)]
    rows += [("tag/none.c", f"// SPDX-License-Identifier: NONE{code}"), ("tag/plain.c", code), ("notice/a.py", notice + code), ("notice/b.py", code)]
    rows += [x for n, t in texts.items() for x in ((f"{n}/LICENSE", t.replace("<copyright holders>", "Ann Other").replace("<year>", "2020")), (f"{n}/src/deep/x.py", code))]
    rows += [("untitled/LICENSE", texts["BSD-2-Clause"].replace("BSD 2-Clause License", ""))]
    rows += [("agpl/LICENSE", texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC"))]
    out = {r["path"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k, name in enumerate(tags.values()):
        r = out[f"tag/{k}.c"]
        assert (r["own_license"], r["own_score"], r["is_license_file"], r["origin"]) == (name, 1.0, False, "header")
    assert out["tag/none.c"]["license"] is None and out["tag/plain.c"]["origin"] == "none"
    assert (out["notice/a.py"]["license"], out["notice/a.py"]["is_license_file"], out["notice/b.py"]["license"]) == ("MIT", False, None)
    for n in texts:
        top, deep = out[f"{n}/LICENSE"], out[f"{n}/src/deep/x.py"]
        assert (top["own_license"], top["is_license_file"]) == (n, True) and top["own_score"] >= 0.95
        assert (deep["license"], deep["origin"], deep["origin_dir"]) == (n, "directory", n)
    assert (out["untitled/LICENSE"]["own_license"], out["untitled/LICENSE"]["is_license_file"]) == ("BSD-2-Clause", True)
    assert out["agpl/LICENSE"]["own_license"] != "GPL-3.0"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    good = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randint(0, 99)}{'.' if k % 9 == 8 else ''}" for k in range(120)) for _ in range(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(10, good[0], "en", "s", 1), (11, good[1] + " End.", "en", "s", 1), (12, "%%% ### " * 30, "en", "s", 1), (13, "short", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted({r["doc_id"] for r in docs.collect()}))
        assert k == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    assert kept[0] == kept[1] == [0, 1, 2, 3, 4, 10, 11] and kept[2] == kept[3] == kept[4] == [0, 1, 2, 3, 4]
