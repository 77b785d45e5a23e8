import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomgraph.operators import chains, evaluate
from loomgraph.operators import pipeline as p
from loomgraph.operators.memory import load
from loomgraph.operators.retrieval import names_in_queries
from loomgraph.session import shared_dir

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_extractor():
    def extractor():
        return lambda rows: [{"raw": json.dumps({"entity_nodes": [{"id": "e0", "name": r["chunk_text"].split()[0]}]}) if "bad" not in r["chunk_text"] else "no graph"} for r in rows]

    return extractor


def test_documents_to_graphs(spark):
    extractor = make_extractor()
    docs = spark.createDataFrame([(1, "Ann met Bob. They ran. It rained. All slept. Day came.", "T"), (2, "bad text", None), (3, None, None)], "doc_id long, text string, title string")
    out = p.process_documents(docs, {"episodic": extractor}, context=lambda: lambda rows: [{"context": f"of {len(r['text'])}"} for r in rows], size=3, overlap=1)
    rows = {(r["doc_id"], r["chunk_idx"]): r for r in out.collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert rows[1, 0]["graph"]["entity_nodes"][0]["name"] == "Ann" and rows[1, 0]["context"] == "of 54" and rows[2, 0]["error"] == "unreadable"
    assert p.process_documents(docs, {"episodic": extractor}, size=None).where("context is not null").count() == 0
    with pytest.raises(ValueError):
        p.process_documents(docs, {"episodic": extractor}, kind="other")


def test_reconcile_and_ask(spark, sf):
    mem = load(spark, sf)
    out, to = p.reconcile(mem)
    assert out.entities.count() == to.where("id = canonical_id").count() < mem.entities.count()
    gone = to.where("id <> canonical_id").select(F.col("id").alias("answer"))
    assert out.answers.join(gone, "answer", "left_semi").count() == 0
    assert out.answers.join(out.verb_phrases.select(F.col("id").alias("vp_id")), "vp_id", "left_anti").count() == 0
    summaries = p.entity_summaries(out)
    names = [r[0] for r in out.entities.where("name is not null").select("name").orderBy("id").limit(3).collect()]
    asked = spark.createDataFrame([(i, f"Who is {n}?", n) for i, n in enumerate(names)] + [(9, "nothing?", "zzzqqq")], "question_id long, question string, m string")
    got = p.ask(asked.select("question_id", "question"), summaries, lambda q: q.join(asked.drop("question"), "question_id").withColumnRenamed("m", "mention"), lambda x: x.withColumn("score", F.length("summary").cast("double")), lambda: lambda rows: [{"reply": json.dumps({"answer": str(len(r["context"]))})} for r in rows])
    rows = {r["question_id"]: r for r in got.collect()}
    assert len(rows) == len(names) + 1 and rows[9]["used"] == 0 and rows[9]["answer"] == "0"


def test_names_in_queries(spark):
    names = spark.createDataFrame([("a", "Ann Lee"), ("b", "ee B"), ("c", "Lee Ann"), ("d", " "), ("e", None), ("f", "O'Neil")], "doc_id string, name string")
    queries = spark.createDataFrame([(1, "is ann lee by?"), (2, "Lee, and then Ann"), (3, None), (4, "o'neil's")], "query_id long, text string")
    assert {tuple(r) for r in names_in_queries(queries, names).collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (4, "f")}


def test_prompts_and_reports(spark):
    rows = [("x Available Evidence (Q&A pairs from knowledge base):\n Q: a A: b \n\nInstructions: y", "Q: a A: b"), ("t\nQ: a\nz\n A: b", "Q: a\n A: b"), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame(rows, "prompt string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", chains.evidence_of_prompt(F.col("prompt"))).collect())
    assert chains.replayable(df.withColumn("error", F.lit(None).cast("string")), "prompt", 2).count() == 2
    scores = spark.createDataFrame([("b", 1.0, 1.0), ("a", 0.0, 0.5), (None, 1.0, 0.0)], "g string, em double, f1 double")
    assert evaluate.report_text(scores, "g").first()[0].splitlines() == ["all: n=3 EM=0.6667 F1=0.5000", "a: n=1 EM=0.0000 F1=0.5000", "b: n=1 EM=1.0000 F1=1.0000", "unknown: n=1 EM=1.0000 F1=0.0000"]
    assert evaluate.truth_format(["correct_answer"]) == "answers"
    with pytest.raises(ValueError):
        evaluate.truth_format(["x"])


def test_clusters_need_a_shared_folder():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_dir(Session()) == "hdfs://x/y"


def test_judge(spark):
    replies = {
        "whole": '{"identified_items_in_AI_answer": ["x", "y"], "matching_score": [{"a": 1}, {"b": "0.5"}, {"c": 1, "d": 1}, 7, {"e": "?"}], "explanation": "so"}',
        "prose": 'Well: {"identified_items_in_AI_answer": [], "matching_score": []} ok', "broken": "{no", "bad": "{no}", "odd": '{"identified_items_in_AI_answer": "x", "matching_score": null}',
    }

    def make():
        return lambda rows: [{"reply": replies[r["answer"]]} for r in rows]

    rows = spark.createDataFrame([(k, ["a", "b"]) for k in [*replies, "raises"]] + [("prose", []), ("prose", None)], "answer string, correct_answer array<string>")
    out = p.judge(rows, make).collect()
    got = {(r["answer"], len(r["correct_answer"] or ())): (r["n_found"], r["total"], r["precision"], r["recall"], r["f1"], r["error"]) for r in out}
    assert got["whole", 2] == (2, 1.5, 0.75, 0.75, 0.75, None) and got["prose", 2] == got["odd", 2] == (0, 0.0, None, 0.0, 0.0, None) and got["prose", 0][2:5] == (1.0, 1.0, 1.0)
    assert got["broken", 2][5] == "No JSON found in response" and got["bad", 2][5] == "Could not parse JSON" and got["raises", 2][5].startswith("KeyError")
    means = evaluate.judged_means(p.judge(rows, make)).first()
    assert (means["n"], means["errors"]) == (8, 3) and means["recall"] == round(2.75 / 8, 4)


def test_evaluate_run(spark):
    def decompose():
        def run(rows):
            return [{"steps": [{"template": w, "requires_retrieval": True} for w in r["question"].split()] if r["question"] != "none" else []} for r in rows]

        return run

    def answer():
        return lambda rows: [{"reply": f"Thought. Answer: {r['evidence']}"} for r in rows]

    gather = lambda s: s.groupBy("question_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("template"))).alias("evidence"))
    asked = spark.createDataFrame([(1, "big blue dog"), (2, "none"), (3, None)], "question_id long, question string")
    golds = spark.createDataFrame([(1, ["dog"]), (1, ["the Big, blue dog"]), (2, ["some"])], "question_id long, golds array<string>")
    got = {r["question_id"]: r for r in p.evaluate_run(asked, golds, decompose, gather, answer).collect()}
    assert (got[1]["em"], got[1]["f1"], got[1]["n_steps"], got[1]["evidence"]) == (1.0, 1.0, 3, "big blue dog")
    assert (got[2]["n_steps"], got[2]["em"], got[2]["prediction"]) == (1, 0.0, "none") and got[3]["error"] and got[3]["em"] == 0.0
    assert p.evaluate_run(asked.limit(0), golds, decompose, gather, answer).count() == 0
