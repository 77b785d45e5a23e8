"""Whole runs composed of the operators: documents to graphs, a memory reconciled, questions answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .chains import extract_answer
from .chunking import chunk_sentences, parse_output, whole_chunks, with_title
from .evaluate import exact_match, judged, read_judgement, token_f1
from .memory import Memory, merge_roles, resolved_answers, rewrite_answers
from .models import Model, call_model, read_reply
from .reconcile import canonical_entities, reconcile_verb_phrases
from .retrieval import approximate_matches, summary_context

Maker = Callable[[], Model]
#: Kinds of extraction (fixed values).
KINDS = ("episodic", "factual")


def process_documents(
    docs: DataFrame, extract: dict[str, Maker], kind: str = "episodic", title: bool = False, coreference: Maker | None = None, context: Maker | None = None, size: int | None = 3, overlap: int = 1
) -> DataFrame:
    """Documents (doc_id, text, title) to chunks with their graphs: doc_id, chunk_idx, start_sentence, end_sentence, chunk_text, context, graph, error.

    ``extract``: models by kind, from chunk_text and context to ``raw``; an unknown kind is an error.  ``coreference`` rewrites a document
    (text to ``resolved``) before it is cut; ``size`` None leaves documents whole.  ``context`` describes a chunk (document text and
    chunk_text to ``context``), only if there are more chunks than documents.  A model's failure leaves nulls and its error.
    """
    if kind not in KINDS or kind not in extract:
        raise ValueError(f"unknown kind of extraction: {kind}")
    text = with_title(F.col("title"), F.col("text")) if title else F.col("text")
    texts = docs.select("doc_id", text.alias("text"))
    if coreference:
        texts = call_model(texts, coreference, "resolved string").select("doc_id", F.coalesce("resolved", "text").alias("text"))
    scratch = Scratch(docs.sparkSession, "process")
    texts = scratch.cut(texts, "texts")
    chunks = scratch.cut(whole_chunks(texts, "doc_id", "text") if size is None else chunk_sentences(texts, "doc_id", "text", size, overlap), "chunks")
    if context and chunks.count() > texts.count():
        chunks = call_model(chunks.join(texts, "doc_id"), context, "context string").drop("text", "error")
    else:
        chunks = chunks.withColumn("context", F.lit(None).cast("string"))
    # Models are called once: what they said is stored.
    said = scratch.cut(call_model(chunks.withColumn("key", F.struct("doc_id", "chunk_idx")), extract[kind], "raw string").withColumnRenamed("error", "model_error"), "said")
    read = parse_output(said, "key", "raw").select("key", "graph", F.col("error").alias("read_error"))
    return said.join(read, "key").select("doc_id", "chunk_idx", "start_sentence", "end_sentence", "chunk_text", "context", "graph", F.coalesce("model_error", "read_error").alias("error"))


def reconcile(memory: Memory, match: Callable[[DataFrame], DataFrame] = canonical_entities) -> tuple[Memory, DataFrame]:
    """A memory reconciled, and the map (id, canonical_id) of its entities.

    ``match`` is the strategy: from entities to (id, canonical_id).  Entities that become others go, with their roles to the
    canonical one; answers name canonical entities; verb phrases fold within their documents.
    """
    scratch = Scratch(memory.entities.sparkSession, "reconcile")
    to = scratch.cut(match(memory.entities), "canonical")
    entities = memory.entities.join(to.where("id = canonical_id").select("id"), "id", "left_semi")
    roles = merge_roles(memory.roles, to, memory.entities).select(F.col("canonical_id").alias("entity_id"), "role", "states", "chunk_id")
    changed = rewrite_answers(memory.questions, to).withColumnRenamed("answers", "rewritten")
    questions = memory.questions.join(changed, "id", "left").withColumn("answers", F.coalesce("rewritten", "answers")).drop("rewritten")
    folded = scratch.cut(reconcile_verb_phrases(memory.verb_phrases, scratch.cut(questions, "questions")), "folded")
    kept = folded.where("q_id is null").select(F.col("vp_id").alias("id"))
    phrases = memory.verb_phrases.where("phrase is not null").join(kept, "id", "left_anti")
    asked = folded.where("q_id is not null").select(F.col("q_id").alias("id"), F.col("kept_id").alias("vp_id"), "text", "answers", "chunk_id")
    answers = asked.select(F.col("id").alias("q_id"), "vp_id", "text", F.posexplode("answers").alias("a_pos", "answer"))
    return Memory(entities, roles, phrases, asked, answers), to


def entity_summaries(memory: Memory, summarise: Maker | None = None) -> DataFrame:
    """(entity_id, name, summary): a model's summary of what is known of an entity (facts to ``summary``), or the facts where it fails or there is none.

    Entities of which nothing is known have no summary.
    """
    cell = F.concat(F.coalesce("role", F.lit("")), F.when(F.size("states") > 0, F.concat(F.lit(": "), F.array_join("states", ", "))).otherwise(""))
    facts = memory.roles.select("entity_id", cell.alias("fact"))
    said = memory.answers.select("q_id", F.col("answer").alias("entity_id")).distinct().join(resolved_answers(memory), "q_id")
    facts = facts.unionByName(said.select("entity_id", F.concat_ws(" ", "question", "answer_names").alias("fact"))).distinct()
    lists = facts.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("facts"))
    lists = lists.join(memory.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    if summarise is None:
        return lists.select("entity_id", "name", F.col("facts").alias("summary"))
    return call_model(lists, summarise, "summary string").select("entity_id", "name", F.coalesce("summary", "facts").alias("summary"))


def ask(questions: DataFrame, summaries: DataFrame, mentions: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], answer: Maker, most: int = 17) -> DataFrame:
    """Questions (question_id, question) answered from entity summaries: question_id, question, used, context, answer, error.

    ``summaries``: entity_id, name, summary, of one memory or of several whose ids are told apart.  ``mentions``: from questions to
    (question_id, mention); ``score``: from (query_id, question, doc_id, name, summary) to the same with score; ``answer``: a
    model from question and context to ``reply``.  Questions without a match are asked with an empty context.
    """
    scratch = Scratch(questions.sparkSession, "ask")
    asked = mentions(questions).select(F.col("question_id").alias("mention_id"), "mention")
    found = approximate_matches(asked, summaries.select(F.col("entity_id").alias("doc_id"), "name")).select(F.col("mention_id").alias("question_id"), "doc_id").distinct()
    rows = found.join(questions, "question_id").join(summaries.withColumnRenamed("entity_id", "doc_id"), "doc_id").withColumnRenamed("question_id", "query_id")
    context = summary_context(score(rows), most).withColumnRenamed("query_id", "question_id")
    put = questions.join(context, "question_id", "left").select("question_id", "question", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("context", F.lit("")).alias("context"))
    said = scratch.cut(call_model(put, answer, "reply string"), "replies")
    return said.select("question_id", "question", "used", "context", read_reply(F.col("reply")).alias("answer"), "error")


def judge(rows: DataFrame, make: Maker, read: Callable[[Column], Column] = read_judgement, score: Callable[[Column, Column, Column], tuple[Column, Column, Column]] = judged) -> DataFrame:
    """``rows`` (correct_answer, a list, and whatever the judge reads) with n_found, total, precision, recall, f1, explanation, error and, where the reply could not be read, raw_reply.

    A judge is any model that gives ``reply``; ``read`` makes of it what was found, and ``score`` the measures of it, so that another
    judge brings its own.  A failed call finds nothing.
    """
    said = Scratch(rows.sparkSession, "judge").cut(call_model(rows, make, "reply string"), "replies").withColumn("_j", read(F.col("reply")))
    p, r, f = score(F.coalesce(F.size("correct_answer"), F.lit(0)), F.col("_j.n_found"), F.col("_j.total"))
    raw = F.when(F.col("_j.error").isNotNull(), F.col("reply")).alias("raw_reply")
    return said.select(*rows.columns, "_j.n_found", "_j.total", p.alias("precision"), r.alias("recall"), f.alias("f1"), "_j.explanation", F.coalesce("error", "_j.error").alias("error"), raw)


def evaluate_run(questions: DataFrame, golds: DataFrame, decompose: Maker, gather: Callable[[DataFrame], DataFrame], answer: Maker) -> DataFrame:
    """Questions (question_id, question) decomposed, searched, answered and scored: question_id, question, n_steps, evidence, prediction, em, f1, error.

    ``decompose``: from question to ``steps``, a list of (template, requires_retrieval); where it fails or gives none, the question is its only step.
    ``gather``: from all steps (question_id, q_idx, template, requires_retrieval) to (question_id, evidence).  ``answer``: from question and
    evidence to ``reply``.  ``golds``: question_id, golds (a list); questions without golds score 0.
    """
    scratch = Scratch(questions.sparkSession, "evaluate")
    asked = questions.select("question_id", "question")
    cut = scratch.cut(call_model(asked, decompose, "steps array<struct<template:string,requires_retrieval:boolean>>"), "steps")
    whole = F.array(F.struct(F.col("question").alias("template"), F.lit(True).alias("requires_retrieval")))
    cut = cut.select("question_id", "question", F.when(F.size("steps") > 0, F.col("steps")).otherwise(whole).alias("steps"), F.col("error").alias("step_error"))
    steps = cut.select("question_id", F.posexplode("steps").alias("q_idx", "s")).select("question_id", "q_idx", "s.template", "s.requires_retrieval")
    found = gather(steps).select("question_id", "evidence")
    put = cut.join(found, "question_id", "left").select("question_id", "question", F.size("steps").alias("n_steps"), F.coalesce("evidence", F.lit("")).alias("evidence"), "step_error")
    said = scratch.cut(call_model(put, answer, "reply string"), "replies").withColumn("prediction", extract_answer(F.col("reply")))
    # Of several golds of a question all count.
    known = golds.groupBy("question_id").agg(F.flatten(F.collect_set("golds")).alias("golds"))
    p, g = F.col("prediction"), F.col("golds")
    return said.join(known, "question_id", "left").select("question_id", "question", "n_steps", "evidence", "prediction", F.coalesce(exact_match(p, g), F.lit(0.0)).alias("em"), F.round(F.coalesce(token_f1(p, g), F.lit(0.0)), 6).alias("f1"), F.coalesce("error", "step_error").alias("error"))
