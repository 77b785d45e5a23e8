"""The fold of verb phrases against one that compares every pair; verdicts, written answers, merges of nodes."""

import random

from loomgraph.operators import reconcile as r

ENT = "id string, name string, roles array<struct<role:string,states:array<string>,chunk_id:string>>, chunk_id string, doc_id long, chunk_idx int, pos int"


def every_pair(rows):
    """The rule as it is said: all old phrases looked through in order, all questions compared."""
    first = lambda q: (q[1] or "").split()[:1]
    said = lambda q: set(q[2]) - {"None"}
    memory, merged = [], {}
    for chunk in sorted({c for c, _, _ in rows}):
        mine = [(vp, qs) for c, vp, qs in rows if c == chunk]
        hits = {}
        for vp, qs in mine:
            for old, old_qs in memory:
                if any(first(q) and first(q) == first(o) and said(q) & said(o) for q in qs for o in old_qs):
                    hits[vp] = (old, old_qs)
                    break
        for vp, qs in mine:
            if vp not in hits:
                continue
            merged[vp], old_qs = hits[vp]
            new = []
            for q in qs:
                same = [o for o in old_qs if o[1] == q[1]]
                if same and q[2] == ["None"]:
                    continue
                opened = [o for o in same if o[2] == ["None"]]
                if opened:
                    opened[0][2:] = q[2:]
                elif all(o[1] != q[1] or sorted(o[2]) != sorted(q[2]) for o in old_qs + new):
                    new.append(list(q))
            old_qs += new
        memory += [(vp, [list(q) for q in qs]) for vp, qs in mine if vp not in hits]
    return [(vp, *q) for vp, qs in memory for q in qs], list(merged.items())


def test_fold_against_every_pair():
    for seed in range(400):
        rnd = random.Random(seed)
        rows = []
        for c in range(rnd.randint(1, 5)):
            for v in range(rnd.randint(0, 4)):
                qs = [[f"{c}{v}{n}", rnd.choice(["Who ran?", "Who sat?", "What ran?", "", None]), rnd.choice([["None"], [], ["a"], ["b", "a"], ["a", "b"], ["c"], ["a", "None"]]), f"{c}"] for n in range(rnd.randint(0, 4))]
                rows.append((c, f"{c}::{v}", qs))
        got, want = r.fold_phrases(rows), every_pair(rows)
        assert got[0] == want[0] and sorted(got[1]) == sorted(want[1]), rows


def test_fold_takes_linear_time():
    rows = [(c, f"{c}", [[f"{c}q", "Who ran?", [f"e{c}"], "x"]]) for c in range(60_000)]
    kept, merged = r.fold_phrases(rows)
    assert len(kept) == 60_000 and not merged


def test_filled_questions_take_the_chunk_and_unknown_documents_stand_alone(spark):
    vps = spark.createDataFrame([("0_0::v0", "sold", 0, 0, 0), ("0_1::v0", "sold", 0, 1, 0), ("x::v0", "sold", None, None, 0), ("y::v0", "sold", None, None, 0)], "id string, phrase string, doc_id long, chunk_idx int, pos int")
    rows = [("0_0::q0", "0_0::v0", "Who?", ["e1"], "0_0"), ("0_0::q1", "0_0::v0", "What?", ["None"], "0_0"), ("0_1::q0", "0_1::v0", "Who?", ["e1"], "0_1"), ("0_1::q1", "0_1::v0", "What?", ["e2"], "0_1"), ("x::q", "x::v0", "Who?", ["e1", None], "x"), ("y::q", "y::v0", "Who?", ["e1"], None)]
    qs = spark.createDataFrame(rows, "id string, vp_id string, text string, answers array<string>, chunk_id string")
    out = r.reconcile_verb_phrases(vps, qs).collect()
    assert {(x.q_id, x.kept_id, x.chunk_id) for x in out if x.q_id} == {("0_0::q0", "0_0::v0", "0_0"), ("0_0::q1", "0_0::v0", "0_1"), ("x::q", "x::v0", "x"), ("y::q", "y::v0", None)}
    assert [(x.vp_id, x.kept_id) for x in out if not x.q_id] == [("0_1::v0", "0_0::v0")]


def test_written_answers(spark):
    qs = spark.createDataFrame([(i, "v", "t", ["None"], "c") for i in "abcdef"], "id string, vp_id string, text string, answers array<string>, chunk_id string")
    said = [("a", "e1", "x", "n"), ("b", "gone", "x", None), ("c", None, "y", "n"), ("d", None, None, "n"), ("e", "", "", ""), ("zz", "e1", None, None), (None, "e1", None, None), ("a", "e1", "x", "n")]
    replies = spark.createDataFrame(said, "q_id string, entity_id string, answer_text string, chunk_id string")
    ents = spark.createDataFrame([("e1",), ("e1",)], "id string")
    got = {x.id: (x.answers, x.chunk_id) for x in r.write_answers(qs, replies, ents).collect()}
    assert got == {"a": (["e1"], "n"), "b": (["TEXT:x"], "c"), "c": (["TEXT:y"], "n"), "d": (["None"], "n"), "e": (["None"], "c"), "f": (["None"], "c")}
    assert r.write_answers(qs, replies.limit(0), ents).count() == 6 and r.write_answers(qs.limit(0), replies, ents).count() == 0


def test_nodes_of_merged_entities(spark):
    edges = spark.createDataFrame([("a", "n1", 1), ("a", "n2", 2), ("b", "n3", 3), ("c", "n3", 4), ("d", "n4", 5), (None, "n9", 6), ("e", "n1", 0)], "entity_id string, node_id string, place int")
    to = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "e"), ("d", "f"), ("e", "e")], "id string, canonical_id string")
    assert [tuple(x) for x in r.context_merges(edges, to).collect()] == [("n3", "n1")]
    assert r.context_merges(edges.limit(0), to).count() == 0


def test_pairs_and_verdicts(spark):
    ents = spark.createDataFrame([("a", "Ann", [("poet", ["old"], None)], "1_0", 1, 0, 0), ("b", None, None, "1_0", 1, 0, 1), ("c", "Anne", [], "1_1", 1, 1, 0)], ENT)
    pairs = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("a", "b", 1), ("c", "zz", 3), ("b", "c", 1)], "new_id string, old_id string, rank int")
    got = r.pair_descriptions(pairs, ents)
    rows = {(x.new_id, x.old_id): (x.chunk_id, x.description) for x in got.collect()}
    assert rows[("c", "a")] == ("1_1", "pair_0: New entity 'Entity: Anne ' and old entity 'Entity: Ann Role: poet States: old'") and rows[("c", "b")][1].startswith("pair_1:") and set(rows) == {("c", "a"), ("c", "b"), ("b", "c")}
    verdicts = spark.createDataFrame([("1_1", "pair_0", True), ("1_1", "pair_1", None), ("1_1", "pair_7", True)], "chunk_id string, pair string, verdict boolean")
    assert [tuple(x) for x in r.verified_pairs(got, verdicts).collect()] == [("c", "a")]
