import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.operators.nested import find_structure, flatten_records

GRAPH = {
    "entity_nodes": [{"id": "e0", "name": "A", "roles": {"role": "r", "states": "s"}}, None, {"id": "e2", "roles": [{"role": "x", "states": ["a", None, "b"]}, "bare"], "extra": {"a": [1]}}],
    "verb_phrase_nodes": {"id": "v0", "phrase": "p", "questions": [{"id": "q", "text": "t?", "answers": ["None", "", "e0"]}, {"answers": None}]},
}


def paths(found):
    return {(p, n) for _, p, n, *_ in found or ()}


EXPECTED = {
    ("root", "e0"), ("e0", "e0.r0"), ("e0.r0", "e0.r0.s0"), ("root", "e2"), ("e2", "e2.r0"), ("e2.r0", "e2.r0.s0"), ("e2.r0", "e2.r0.s2"), ("e2", "e2.r1"),
    ("root", "v0"), ("v0", "v0.q0"), ("v0.q0", "v0.q0.a0"), ("v0.q0", "v0.q0.a1"), ("v0.q0", "v0.q0.a2"), ("v0", "v0.q1"),
}
TEXT = json.dumps(GRAPH)
PACKED = {
    "bare": TEXT, "indented": json.dumps(GRAPH, indent=2), "list": f" \n[{TEXT}]\n", "bom": "﻿" + TEXT, "string": json.dumps(TEXT), "chunk": json.dumps({"text": "x {", "gsw": GRAPH}),
    "run": json.dumps({"metadata": {}, "documents": {"doc_0": {"1_0": {"gsw": GRAPH}}}}), "fence": f"Sure [1] {{.\n```json\n{TEXT}\n```\nAll done.", "string in field": json.dumps({"gsw": json.dumps(GRAPH)}),
}


@pytest.mark.parametrize("kind", PACKED)
def test_packings(kind):
    assert paths(find_structure(PACKED[kind])) == EXPECTED


@pytest.mark.parametrize("text", [None, "", "  ", "null", "{}", "no structure found", TEXT[:-9], "```json\n" + TEXT[:-20], '{"gsw": ' + TEXT, '{"text": "", "gsw": null}', '{"entity_nodes": null}'])
def test_nothing_readable(text):
    assert paths(find_structure(text)) == set()


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["entity_nodes", "roles", "states", "questions", "answers", "z"]), x, max_size=3), max_leaves=12))
def test_never_fails(value):
    find_structure(json.dumps(value))


def test_tables_name_their_parents(spark):
    rows = [(i, v, "x", 1) for i, v in enumerate([*PACKED.values(), None, ""])]
    t = flatten_records(spark.createDataFrame(rows, "gsw_id long, payload string, path string, ordinal int").select("gsw_id", "payload"))
    n = len(PACKED)
    assert {k: v.count() for k, v in t.items()} == {"entities": 2 * n, "roles": 3 * n, "states": 3 * n, "verb_phrases": n, "questions": 2 * n, "answers": 3 * n}
    for child, parent in (("roles", "entities"), ("states", "roles"), ("questions", "verb_phrases"), ("answers", "questions")):
        parents = t[parent].selectExpr("gsw_id", "path as parent_path")
        assert t[child].join(parents, ["gsw_id", "parent_path"], "left_anti").count() == 0
    assert {r.value for r in t["answers"].collect()} == {"None", "", "e0"}
    assert {r.role for r in t["roles"].collect()} == {"r", "x", "bare"}


def test_empty_table(spark):
    assert all(t.count() == 0 for t in flatten_records(spark.createDataFrame([], "gsw_id long, payload string")).values())


@pytest.mark.parametrize("deep", ["[" * 100_000 + "]" * 100_000, '{"a":' * 100_000 + "1" + "}" * 100_000])
@pytest.mark.parametrize("where", ["outside", "extra field", "field"])
def test_deep_records_stay(deep, where):
    node = {"outside": '{"id": "e0"}', "extra field": f'{{"id": "e0", "x": {deep}}}', "field": f'{{"id": "e0", "summary": {deep}}}'}[where]
    text = f'{{"x": {deep if where == "outside" else 1}, "gsw": {{"entity_nodes": [{node}]}}}}'
    began = time.perf_counter()
    found = find_structure(text)
    assert ("entity_nodes", "root", "e0", 0, "id", "e0") in found and time.perf_counter() - began < 5
    assert where != "field" or ("entity_nodes", "root", "e0", 0, "summary", deep) in found


@pytest.mark.parametrize("text", ["[" * 200_000, '{"a":' * 200_000, "[1, " * 200_000 + "x", '{"' * 200_000, "[[1] x " * 100_000, '"' * 200_001, "``` " * 100_000, '{"a": "' + "{" * 200_000 + '" x'])
def test_linear_time(text):
    began = time.perf_counter()
    find_structure(text + ' {"entity_nodes": [')
    assert time.perf_counter() - began < 10


def test_repeated_keys_and_odd_values():
    last = find_structure('{"entity_nodes": [{"id": 1}], "gsw": 0, "entity_nodes": [{"id": "b", "name": 1, "name": null, "roles": ["x", "y"], "roles": "z"}, ["c"], 5]}')
    assert [t[2:] for t in last] == [("e0", 0, None, None), ("e0", 0, "id", "b"), ("e0.r0", 0, "role", "z"), ("e1", 1, "name", '["c"]'), ("e2", 2, "name", "5")]
    assert find_structure('{"a": {"entity_nodes": ["x"]}, "a": null}') is None
    assert find_structure('{"a": {"entity_nodes": ["inner"]}, "entity_nodes": ["outer"]}')[0][-1] == "outer"
    assert find_structure('{"entity_nodes": ["\\ud83d", "\\ud83d\\ude00"]}')[0][-1] == "\ufffd"
    assert find_structure('see {note} and {"verb_phrase_nodes": {"phrase": true}} there')[1][-2:] == ("phrase", "true")
    assert find_structure('he said {"quote} and {"entity_nodes": ["x"]}')[0][-1] == "x"
