import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import memory as m
from loomgraph.operators import models as mo
from loomgraph.sources import files as f
from loomgraph.sources import sinks as k
from loomgraph.streaming import incremental as inc


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_corpus(spark, tmp_path):
    docs = [{"title": f"t{i}", "text": f"x{i}"} for i in range(5)]
    array = f.read_corpus(spark, put(tmp_path / "c.json", docs), start=1, end=4)
    assert [(r.id, r.combined) for r in array.orderBy("id").collect()] == [(1, "t1 x1"), (2, "t2 x2"), (3, "t3 x3")]
    lines = f.read_corpus(spark, put(tmp_path / "c.jsonl", "\n".join(map(json.dumps, docs))), lines=True)
    assert [(r.id, r.title) for r in lines.orderBy("id").collect()] == [(i, f"t{i}") for i in range(5)]


def test_graph_files(spark, tmp_path):
    for n in (2, 10):
        put(tmp_path / f"doc_{n}/gsw_{n}_0.json", {"entity_nodes": [{"id": "e0", "name": "A"}], "verb_phrase_nodes": []})
    put(tmp_path / "doc_3/gsw_3_1.json", "{broken")
    rows = f.read_graphs(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.chunk_idx) for r in rows] == [(2, 0), (10, 0)]
    assert [r.doc_id for r in f.read_graphs(spark, str(tmp_path), first=1).collect()] == [2]


def test_results_and_summaries(spark, tmp_path):
    chunk = {"text": "x", "doc_idx": 7, "chunk_idx": 0, "global_id": "7_0", "gsw": {"entity_nodes": [{"id": "e"}]}}
    p = put(tmp_path / "r.json", {"metadata": {}, "documents": {"doc_7": {"7_0": chunk, "7_1": {"text": "y", "gsw": None}}}})
    rows = f.read_results(spark, p).orderBy("chunk_id").collect()
    assert [(r.doc_id, r.chunk_id, r.gsw is None) for r in rows] == [(7, "7_0", False), (7, "7_1", True)]
    s = f.read_summaries(spark, put(tmp_path / "s.json", {"a": {"entity_name": "A", "summary": "of A"}, "b": "of B"}))
    assert {(r.entity_id, r.summary) for r in s.collect()} == {("a", "of A"), ("b", "of B")}


def test_question_sets(spark, tmp_path):
    p = put(tmp_path / "q.json", [{"_id": "1", "question": "Q?", "answer": "x", "answer_aliases": ["y"], "possible_answers": '["u", "v"]'}, {"question": "R?", "answer": ["a", "b"]}])
    got = {r.question: r.golds for r in f.read_questions(spark, p, "2wiki").collect()}
    assert got == {"Q?": ["x", "y"], "R?": ["a", "b"]}
    assert {r.question: r.golds for r in f.read_questions(spark, p, "popqa", aliases_with_any_field=False).collect()}["Q?"] == ["u", "v"]
    with pytest.raises(ValueError):
        f.read_questions(spark, p, "other")


def test_titles_and_supporting_texts(spark):
    corpus = spark.createDataFrame([(0, "T", "old"), (1, "T", "new"), (2, "U", "u")], "id long, title string, text string")
    hit, miss = f.titles_needed(spark.createDataFrame([(1, ["T", "V"])], "question_id long, titles array<string>"), corpus)
    assert [(r.title, r.text) for r in hit.collect()] == [("T", "new")] and [r.title for r in miss.collect()] == ["V"]
    facts = spark.createDataFrame([(1, 0, "T", 1), (1, 1, "T", 9), (1, 2, "T", -1)], "question_id long, pos int, title string, sent int")
    texts = f.supporting_texts(facts, spark.createDataFrame([("T", ["a", "b"])], "title string, sentences array<string>"))
    assert [r.text for r in texts.orderBy("pos").collect()] == ["b", "a b", "a b"]


def test_book_runs_and_stages(spark, tmp_path):
    assert [r.chapter for r in f.read_book(spark, put(tmp_path / "b.json", {"10": "x", "2": "y", "1": "z"})).orderBy("pos").collect()] == ["1", "10", "2"]
    put(tmp_path / "runs/eval_1/a.json", "12"), put(tmp_path / "runs/eval_2/a.json", "1234"), put(tmp_path / "runs/other/a.json", "1")
    root = f"file://{tmp_path}/runs"
    assert f.list_runs(spark, root) == [("eval_2", 4), ("eval_1", 2)] and f.list_runs(spark, root + "/none") == []
    assert f.stages_present(spark, root + "/eval_1", {"a": "a.json", "b": "b.json"}) == {"a": True, "b": False}
    with pytest.raises(FileNotFoundError):
        f.stages_present(spark, root, {"x": "x"})


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 0, "g"), (0, 1, None), (1, 0, "h")], "doc_id long, chunk_idx int, gsw string")
    assert tuple(k.write_chunks(chunks, str(tmp_path / "w"), doc_offset=100).first()) == (2, 3, 2)
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "w/chunks")).collect()} == {100, 101}
    cache = spark.createDataFrame([("x",)], "t string").select(F.md5("t").alias("key"))
    rows = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "t string")
    assert [r.text for r in k.uncached(rows, "t", cache).collect()] == ["y"] and k.uncached(rows, "t", None).count() == 2
    both = k.merge_recovered(chunks, spark.createDataFrame([(1, 9, "n"), (2, 0, "n")], "doc_id long, chunk_idx int, gsw string"), "doc_id")
    assert sorted((r.doc_id, r.chunk_idx) for r in both.collect()) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    k.write_results(spark.createDataFrame([(1, "x" * 300)], "id long, t string"), str(tmp_path / "res"), "t")
    assert len(spark.read.json(str(tmp_path / "res")).first().t) == 203


def test_memory_is_written_and_exported(spark, sf, tmp_path):
    mem = m.load(spark, sf)
    k.write_memory(mem, m.corpus_statistics(mem), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/entities")).count() == mem.entities.count()
    elements = k.cytoscape(m.graph_nodes(mem), m.graph_edges(mem))
    assert "data" in json.loads(elements.first().element)


def test_models_fail_row_by_row(spark):
    def make():
        def model(rows):
            if any(r["x"] == 3 for r in rows):
                raise ValueError("three")
            return [{"y": r["x"] * 2} for r in rows]

        return model

    out = {r.x: (r.y, r.error) for r in mo.call_model(spark.range(6).withColumnRenamed("id", "x"), make, "y long", batch=3).collect()}
    assert out == {0: (0, None), 1: (2, None), 2: (4, None), 3: (None, "ValueError: three"), 4: (8, None), 5: (10, None)}


def test_replies(spark):
    rows = [('```json\n{"answer": ["a", "b"]}\n```', "a, b"), ('{"answer": "x"}', "x"), ("plain", "plain"), ('see {"answer": "y"} ok', "y"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select(mo.read_reply(F.col("t")).alias("got"), "want").collect() if r.got != r.want] == []
    assert spark.createDataFrame([(" a | b||\n",)], "t string").select(mo.split_mentions(F.col("t"))).first()[0] == ["a", "b"]


def test_agent_loop(spark):
    def plan(calls):
        return {"answer": calls[0]["result"][0]["id"]} if len(calls) > 1 else {"tool": ["count", "unknown"][len(calls)], "arguments": {}}

    out = mo.run_agent(plan, {"count": lambda: spark.range(7, 9)})
    assert out["answer"] == 7 and "error" in out["tool_calls_made"][1]["result"]
    assert mo.run_agent(lambda calls: {"tool": "x"}, {}, most=2)["answer"] is None


def test_stream_in_several_batches(spark, tmp_path):
    ddl = "id string, name string, chunk_id string"
    for i, rows in enumerate([[("5_0::e0", "Sam", "5_0")], [("3_0::e0", "sam!", "3_0"), ("3_0::e1", None, "3_0")], [("4_0::e0", "", "4_0")]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"entity_nodes.parquet/p{i}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "entity_nodes.parquet/*"))
    assert [tuple(r) for r in inc.first_of_name(spark, stream).collect()] == [("sam", "3_0::e0", 2)]
