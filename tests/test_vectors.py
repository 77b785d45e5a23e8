"""Vectors: the stand-in embedder, exact neighbours of ids of any type, the order of searches."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import _vectors
from loomgraph.operators import retrieval as r
from loomgraph.operators.models import hashed_vector

ENT = "doc_id string, name string, roles array<struct<role:string,states:array<string>,chunk_id:string>>"


def test_hashed_vector(spark):
    rows = [("Ann met ann",), ("",), (None,), ("x " * 20_000,)]
    got = [x[0] for x in spark.createDataFrame(rows, "t string").select(hashed_vector(F.col("t"))).collect()]
    ann = md5(b"ann").digest()[0] % 64
    assert got[0][ann] >= 2 and sum(got[0]) == 3 and got[1] == [0.0] * 64 and got[2] is None and sum(got[3]) == 20_000
    assert spark.createDataFrame([], "t string").select(hashed_vector(F.col("t"))).count() == 0


def test_neighbours_by_text_ids(spark):
    rnd = np.random.default_rng(1)
    vecs = [[float(x) for x in v] for v in rnd.integers(-2, 3, (300, 3))]  # many ties
    rows = [(f"{(i * 7) % 300}é" if i % 9 else f"{i}", v, i % 4) for i, v in enumerate(vecs)] + [("null", None, 0), ("short", [1.0], 1), ("hole", [1.0, None, 2.0], 2)]
    df = spark.createDataFrame(rows, "doc_id string, vec array<double>, g int").dropDuplicates(["doc_id"])
    rows = [tuple(x) for x in df.collect()]
    got = {(x.query_id, x.rank): (x.doc_id, x.score) for x in r.knn(df, df.where("g = 1").withColumnRenamed("doc_id", "query_id"), 6, block=20, apart="g").collect()}
    want = {}
    good = [(i, np.array(v), g) for i, v, g in rows if v and len(v) == 3 and None not in v and any(v)]
    for i, v, g in good:
        if g == 1:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w, h in good if h != g)
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate([x for x in near if x[0] < 0][:6])}
    assert got == want


def test_entity_search_falls_back(spark):
    ents = spark.createDataFrame([("a", "Ann Lee", [("poet", ["old"], None)]), ("b", "Bob", None), ("c", None, [])], ENT)
    asked = spark.createDataFrame([(1, "ann poet"), (2, "?!"), (3, None)], "query_id long, text string")
    none = lambda t: F.when(t == "never", hashed_vector(t))
    for kind in ({}, {"use_bm25": False}, {"use_bm25": False, "embed": hashed_vector}, {"use_bm25": False, "embed": none}):
        out = r.entity_search(ents, asked, 2, **kind).collect()
        assert out[0].doc_id == "a" and {x.query_id for x in out} == {1}, kind
        assert r.entity_search(ents.limit(0), asked, 2, **kind).count() == 0 and r.entity_search(ents, asked.limit(0), 2, **kind).count() == 0


def test_cosine_scores(spark):
    rows = spark.createDataFrame([(1, "ann lee", "lee ann", "x"), (2, "ann", None, "y"), (3, "", "ann", None), (1, "ann lee", "lee ann", "x")], "id long, q string, s string, v string")
    assert sorted((x.id, x.score) for x in r.cosine_scores(rows, "q", "s", hashed_vector).collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)]


def test_matches_ranked_in_blocks(spark, monkeypatch):
    """As by all pairs; and only the best of each meeting leave it, however many names share a word."""
    monkeypatch.setattr(_vectors, "NAME_BLOCK", 40)
    monkeypatch.setattr(_vectors, "MENTION_BLOCK", 7)
    rnd = np.random.default_rng(3)
    parts, said = ["the", "ann", "lee", "annlee", "hall", "e", "\"mill", "of", "x\u00e9"], ["red", "boat", "ann", "lee", "hid", "it"]
    text = lambda of, n: " ".join(of[i] for i in rnd.integers(0, len(of), n))
    names = [(f"d{i}", text(parts, rnd.integers(1, 4)), text(said, 4) if i % 11 else "?!") for i in range(150)] + [("blank", " ", "red"), ("none", None, "red"), ("zz", "ann", None)]
    asked = [(i, text(parts, rnd.integers(1, 3))) for i in range(30)] + [(98, ""), (99, None)]
    names, asked = spark.createDataFrame(names, "doc_id string, name string, text string"), spark.createDataFrame(asked, "query_id long, mention string")
    pairs = r.approximate_matches(asked.withColumnRenamed("query_id", "mention_id"), names.select("doc_id", "name")).withColumnRenamed("mention_id", "query_id").join(asked, "query_id").join(names, "doc_id")
    want = r.top_k(r.cosine_scores(pairs, "mention", "text", hashed_vector), "query_id", "score", "doc_id", 5)
    key = lambda x: (x.query_id, x.rank, x.doc_id, x.score)
    assert sorted(map(key, r.matches_ranked(asked, names, 5, hashed_vector).collect())) == sorted(map(key, want.collect()))
    same = spark.range(500).select(F.concat(F.lit("n"), "id").alias("doc_id"), F.concat(F.lit("the hall "), "id").alias("name"), F.lit("a boat").alias("text"))
    monkeypatch.setattr(_vectors, "NAME_BLOCK", 1_000)
    left = []
    monkeypatch.setattr(r, "top_k", lambda df, *_: left.append(df) or df)
    r.matches_ranked(spark.range(60).select(F.col("id").alias("query_id"), F.lit("the boat").alias("mention")), same, 5, hashed_vector)
    assert left[0].count() == 60 * 5
