import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import strip, words
from loomgraph.operators import _vectors
from loomgraph.operators import chunking as c
from loomgraph.operators import retrieval as r


def chunks(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [(x.chunk_idx, x.start_sentence, x.end_sentence, x.chunk_text) for x in c.chunk_sentences(df, "id", "text", size, overlap).orderBy("chunk_idx").collect()]


def test_chunk_windows(spark):
    got = chunks(spark, "a. b! c? d. e. f. g", 3, 1)
    assert [(x[1], x[2]) for x in got] == [(0, 3), (2, 5), (4, 7), (6, 7)] and got[0][3] == "a. b. c." and got[-1][3] == "g."
    assert chunks(spark, "", 3, 1) == chunks(spark, "...", 3, 1) == chunks(spark, None, 3, 1) == chunks(spark, " \n . ", 3, 1) == []
    with pytest.raises(ValueError):
        chunks(spark, "a", 1, 1)


def test_strip_and_words_know_unicode_space(spark):
    row = spark.createDataFrame([("\n  A b \t",)], "t string").select(strip("t"), words("t")).first()
    assert row[0] == "A b" and row[1] == ["a", "b"]


def test_parse_output(spark):
    good = '{"entity_nodes": [{"id": "e0", "name": "A"}], "verb_phrase_nodes": []}'
    rows = [(1, good), (2, f"Sure\n```json\n{good}\n```"), (3, f"```\n{good}\n```"), (4, good + "</semantic_construction> bye"), (5, "nothing"), (6, ""), (7, None), (8, '{"entity_nodes": [{"id": "e0"}]}'), (9, good + " trailing words")]
    out = {x.id: (x.error, x.n) for x in c.parse_output(spark.createDataFrame(rows, "id long, raw string"), "id", "raw").select("id", "error", F.size("graph.entity_nodes").alias("n")).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: None, 2: None, 3: None, 4: None, 5: "unreadable", 6: "empty", 7: "empty", 8: "incomplete", 9: None}
    assert out[2][1] == 1


def brute_bm25(docs, queries, k1=1.5, b=0.75, eps=0.25):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {t: eps * avg if v < 0 else v for t, v in idf.items()}
    out = {}
    for q, ts in queries.items():
        for d, words_ in docs.items():
            tf = Counter(words_)
            s = sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words_) / mean)) for t in ts)
            if round(s, 6) > 0:
                out[q, d] = round(s, 6)
    return out


def test_bm25_against_brute_force(spark):
    docs = {1: ["a", "b", "a"], 2: ["b", "c"], 3: ["d"], 4: ["a", "x", "y", "z"], 5: []}
    queries = {1: ["a", "a", "c"], 2: ["nope"], 3: ["b", "d"], 4: []}
    got = r.bm25(spark.createDataFrame(list(docs.items()) + [(6, None)], "doc_id long, tokens array<string>"), spark.createDataFrame(list(queries.items()) + [(9, None)], "query_id long, tokens array<string>"), 10)
    assert {(x.query_id, x.doc_id): x.score for x in got.collect()} == pytest.approx(brute_bm25(docs, queries))


def test_bm25_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    assert r.bm25(none, some, 3).count() == 0
    assert r.bm25(spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>"), some.limit(0), 3).count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype("float32")
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "doc_id long, vec array<float>")
    queries = corpus.where("doc_id % 20 = 0 or doc_id > 899").withColumnRenamed("doc_id", "query_id")
    got = {}
    for x in r.knn(corpus, queries, 5, block=7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.doc_id))
    u = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for q in range(0, 300, 20):
        order = sorted(range(300), key=lambda d: (-s[q, d], d))[:5]
        assert [d for _, d in sorted(got[q])] == order
    assert 902 not in got and 901 not in got and 900 not in got
    assert r.knn(corpus.limit(0), queries, 5).count() == 0 and r.knn(corpus, queries.limit(0), 5).count() == 0


def test_approximate_matches(spark):
    names = spark.createDataFrame([(1, '"Main Street"'), (2, "Street Art"), (3, "Oak"), (4, "art"), (5, ""), (6, None), (7, "50% off_x")], "doc_id long, name string")
    asked = spark.createDataFrame([(1, "Main Street"), (2, "cartel"), (3, ""), (4, "0% of")], "mention_id long, mention string")
    got = {(x.mention_id, x.doc_id) for x in r.approximate_matches(asked, names).collect()}
    assert got == {(1, 1), (1, 2), (2, 4), (4, 7)}


def test_token_search_counts_words_inside_names(spark):
    names = spark.createDataFrame([(1, "cartel art"), (2, "Oak"), (3, None)], "doc_id long, name string")
    asked = spark.createDataFrame([(1, ["art", "art", "o", "zz"])], "query_id long, tokens array<string>")
    assert [(x.doc_id, x.score) for x in r.token_search(names, asked, 5).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_holders_against_all_pairs(spark):
    words_ = ["cartel", "art", "arty", "con", "concert", "co", "é", "caféart", "xxxx", "a"]
    tokens = ["art", "con", "xxx", "zzz", "concert", "é", "co", "t", "tel", "nce"]
    v = spark.createDataFrame([(w,) for w in words_], "word string")
    t = spark.createDataFrame([(w,) for w in tokens], "token string")
    from loomgraph.operators.retrieval import holders

    assert {tuple(x) for x in holders(v, t).collect()} == {(x, w) for x in tokens for w in words_ if x in w}
    assert holders(v.limit(0), t).count() == 0 and holders(v, t.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [7, 200_000])
def test_field_searches_in_blocks_against_brute_force(spark, monkeypatch, block):
    """Common tokens, also inside words, roles without text and ties; no row stands for a query and a text, so nothing is joined."""
    from loomgraph.operators import _vectors

    monkeypatch.setattr(_vectors, "FIELD_BLOCK", block)
    rng = np.random.default_rng(3)
    said = lambda n: " ".join(rng.choice(["the", "other", "of", "old", "man", "manor", "x1", "role", "specific"], n))
    rows = [(f"d{i:03}", None if i % 9 == 0 else said(rng.integers(0, 4)), None if i % 7 == 0 else [(None if j == 2 else said(2), None if j == 1 else [said(1), None, said(2)]) for j in range(i % 4)]) for i in range(60)]
    asked = [(i, [str(x) for x in rng.choice(["the", "o", "man", "roles", "no", "old", "zz", "x1"], 4)]) for i in range(20)] + [(90, []), (91, None), (92, ["man:", "-", "the"])]
    docs = spark.createDataFrame(rows, "doc_id string, name string, roles array<struct<role:string,states:array<string>>>")
    queries = spark.createDataFrame(asked, "query_id long, tokens array<string>")
    texts = {x.doc_id: x.t for x in docs.select("doc_id", r.entity_search_text().alias("t")).collect()}

    def best(score):
        return {(q, d, s) for q, ts in asked for s, d in sorted(((score(ts or [], row), row[0]) for row in rows), key=lambda x: (-x[0], x[1]))[:5] if s > 0}

    def weighted(ts, row):
        fields = [(1, texts[row[0]]), (2, row[1]), *((1.5, x[0]) for x in row[2] or []), *((1, s) for x in row[2] or [] for s in x[1] or [])]
        return sum(w for t in set(ts) for w, x in fields if x is not None and t in x.lower())

    for found, score in ((r.token_search(docs, queries, 5), lambda ts, row: sum(t in (row[1] or "") for t in ts)), (r.weighted_search(docs, queries, 5), weighted)):
        assert {(x.query_id, x.doc_id, x.score) for x in found.collect()} == best(score)
        assert "Join" not in plan_of(found)


def test_bm25_by_rare_words(spark, monkeypatch):
    """Texts that come to queries by their rarest words are the best of all, with common, less rare, rare and unknown words, many ties and repeated words."""
    rnd = random.Random(5)
    common, less, rare = [f"c{i}" for i in range(6)], [f"m{i}" for i in range(25)], [f"r{i}" for i in range(400)]
    words = lambda a, b, c: [rnd.choice(common) for _ in range(a)] + [rnd.choice(less) for _ in range(b)] + [rnd.choice(rare) for _ in range(c)]
    docs = {f"d{i}": words(rnd.randint(0, 5), rnd.randint(0, 2), rnd.randint(0, 2)) for i in range(700)} | {"empty": []}
    queries = {i: words(rnd.randint(0, 4), rnd.randint(0, 3), rnd.randint(0, 2)) + ["unknown"] * (i % 2) for i in range(150)}
    both = spark.createDataFrame(list(docs.items()), "doc_id string, tokens array<string>"), spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    key = lambda x: (x.query_id, x.rank, x.doc_id, x.score)
    want = sorted(map(key, r.bm25(*both, 5).collect()))
    found = brute_bm25(docs, queries)
    assert [x[:3] for x in want] == [(q, n + 1, d) for q in queries for n, (_, d) in enumerate(sorted((-s, d) for (a, d), s in found.items() if a == q)[:5])]
    for name, value in {"CORPUS_WORDS": 100, "QUERY_WORDS": 60, "RARE": 15, "COMMON": 6, "RARE_ROWS": 150, "WORD_BLOCK": 50, "PAIRS": 40}.items():
        monkeypatch.setattr(_vectors, name, value)
    monkeypatch.setattr(_vectors, "block_scores", lambda texts, *x, own=_vectors.block_scores: met.append(texts.count()) or own(texts, *x))
    met = []
    got = sorted(map(key, r.bm25(*both, 5).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
    assert met and met[0] < 500, "texts alike in common words are one"
