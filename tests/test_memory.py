import random

from pyspark.sql import functions as F

from loomgraph.operators import memory as m
from loomgraph.operators import reconcile as r

ENT = "id string, chunk_id string, doc_id long, chunk_idx int, pos int, name string"


def sequential(rows, per_document):
    """Chunk by chunk: a name becomes the first of its name from another chunk; merged ones aren't indexed."""
    index, out = {}, {}
    chunks = sorted({(d, c) for _, _, d, c, _, _ in rows})
    for d, c in chunks:
        new = []
        for i, _, dd, cc, pos, name in sorted(rows, key=lambda x: x[4]):
            if (dd, cc) != (d, c):
                continue
            key = "".join(ch for ch in name.lower() if ch.isascii() and (ch.isalnum() or ch.isspace())) if name is not None else ""
            scope = d if per_document else 0
            if key and (scope, key) in index:
                out[i] = index[scope, key]
            else:
                out[i] = i
                new.append((scope, key, i))
        for scope, key, i in new:
            if key:
                index.setdefault((scope, key), i)
    return out


def test_canonical_equals_the_sequential_rules(spark):
    rnd = random.Random(1)
    for per_document in (False, True):
        rows = []
        for d in range(4):
            for c in range(4):
                for p in range(5):
                    rows.append((f"{d}_{c}::e{p}", f"{d}_{c}", d, c, p, rnd.choice(["Sam", "sam!", "Ann B", "é", "ü", "", None, "Bo"])))
        got = {x.id: x.canonical_id for x in r.canonical_entities(spark.createDataFrame(rows, ENT), per_document).collect()}
        assert got == sequential(rows, per_document)


def test_non_ascii_names_merge_only_on_request(spark):
    rows = [("0_0::e0", "0_0", 0, 0, 0, "é"), ("0_1::e0", "0_1", 0, 1, 0, "ü")]
    df = spark.createDataFrame(rows, ENT)
    assert {x.canonical_id for x in r.canonical_entities(df).collect()} == {"0_0::e0", "0_1::e0"}
    assert {x.canonical_id for x in r.canonical_entities(df, empty_keys=True).collect()} == {"0_0::e0"}


def test_same_chunk_namesakes_stay(spark):
    rows = [("0_0::e0", "0_0", 0, 0, 0, "Sam"), ("0_0::e1", "0_0", 0, 0, 1, "Sam"), ("0_1::e0", "0_1", 0, 1, 0, "Sam")]
    got = {x.id: x.canonical_id for x in r.canonical_entities(spark.createDataFrame(rows, ENT)).collect()}
    assert got == {"0_0::e0": "0_0::e0", "0_0::e1": "0_0::e1", "0_1::e0": "0_0::e0"}


def test_fold_fills_the_open_question():
    rows = [(0, "a", [["q0", "Who sold?", ["e1"]], ["q1", "What was sold?", ["None"]]]), (1, "b", [["q0", "Who sold?", ["e1"]], ["q2", "What was sold?", ["e9"]], ["q3", "When was it?", ["TEXT:May"]]])]
    out, merged = r.fold_phrases(rows)
    kept = {(x[1], tuple(x[3])) for x in out if x[0] == "a"}
    assert kept == {("q0", ("e1",)), ("q1", ("e9",)), ("q3", ("TEXT:May",))}
    assert merged == [("b", "a")]


def test_fold_keeps_phrases_without_a_shared_answer():
    rows = [(0, "a", [["q0", "Who sold?", ["None"]]]), (1, "b", [["q0", "Who sold?", ["None"]]]), (1, "c", [["q0", "", ["e1"]]])]
    assert {x[0] for x in r.fold_phrases(rows)[0]} == {"a", "b", "c"}


def test_phrases_reconcile_within_documents(spark):
    vps = spark.createDataFrame([("0_0::v0", "sold", 0, 0, 0), ("0_1::v0", "sold", 0, 1, 0), ("1_0::v0", "sold", 1, 0, 0), ("1_1::v0", None, 1, 1, 0)], "id string, phrase string, doc_id long, chunk_idx int, pos int")
    qs = spark.createDataFrame([(f"{v}q", v, "Who sold?", ["e1"]) for v in ("0_0::v0", "0_1::v0", "1_0::v0")] + [("x", "0_0::v0", "Null?", None)], "id string, vp_id string, text string, answers array<string>")
    out = [tuple(x)[:3] for x in r.reconcile_verb_phrases(vps, qs).where("q_id is null").collect()]
    assert out == [(0, "0_1::v0", "0_0::v0")]


def test_merge_context_nodes(spark):
    nodes = spark.createDataFrame([("a", "1", {"1": "x"}, "x"), ("b", "2", {"1": "no", "2": "y"}, "y"), ("c", "0", {"0": "z"}, "z")], "node_id string, chunk_id string, name_history map<string,string>, current_name string")
    merges = spark.createDataFrame([("b", "a"), ("gone", "c")], "source_id string, target_id string")
    out = {x.node_id: (x.chunk_id, x.h, x.current_name) for x in m.merge_context_nodes(nodes, merges).withColumn("h", m.history_text(F.col("name_history"))).collect()}
    assert out == {"a": ("2", "Chunk1:x, Chunk2:y", "y"), "c": ("0", "Chunk0:z", "z")}


def test_similarity_edges_need_both_ends(spark):
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), ("a", None), ("a", "zz")], "left_id string, right_id string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(x) for x in m.similarity_edges(pairs, ids).collect()] == [("a", "b")]


def test_chunk_key(spark):
    rows = [("chunk_2_10",), ("chunk_chunk_1_2",), ("7",), ("3_4",), ("a_b",)]
    got = [x[0] for x in spark.createDataFrame(rows, "c string").select(m.chunk_key(F.col("c"))).collect()]
    assert got == [[2, 10], [1, 2], [-1], [4], [-1]]


def test_most_connected_keeps_entities_without_edges(spark, sf):
    mem = m.load(spark, sf)
    none = spark.createDataFrame([], "src string, dst string")
    out = m.most_connected(mem, none)
    assert out.count() == mem.entities.count() and out.where("degree = 0").count() > 0
    top = [x.degree for x in m.most_connected(mem, none, 5).collect()]
    assert len(top) == 5 and top == sorted(top, reverse=True)
