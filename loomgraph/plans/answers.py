"""Registered queries of chains, beams and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chains as c
from ..operators import evaluate as e
from ..operators import memory as m
from ..functions.text import word_tokens
from ..operators import retrieval as r
from ..operators.chunking import token_estimate
from ..session import Scratch, table
from .graph import DELIVERED, MEMORY_SQL, bm25_sql, delivered_sql


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of a verb phrase as steps: two of three refer to the step before."""
    q = m.load(spark, sf_dir).questions
    idx = F.row_number().over(Window.partitionBy("vp_id").orderBy(m.delivered("id"))) - 1
    q = q.select(F.col("vp_id").alias("question_id"), idx.cast("int").alias("q_idx"), F.coalesce("text", F.lit("")).alias("text"))
    template = F.when(F.col("q_idx") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" <ENTITY_Q"), "q_idx", F.lit(">")))
    return q.select("question_id", "q_idx", template.alias("template"), (F.col("q_idx") % 7 != 6).alias("requires_retrieval"))


def step_dependencies(spark, sf_dir):
    return c.dependencies(_steps(spark, sf_dir))


def reasoning_chains(spark, sf_dir):
    return c.reasoning_chains(_steps(spark, sf_dir)).select("question_id", "chain_no", F.array_join(F.col("chain").cast("array<string>"), " ").alias("chain"))


def concrete_questions(spark, sf_dir):
    """Steps with the placeholder replaced by the name of the first answer of the step before; each concrete question once."""
    mem = m.load(spark, sf_dir)
    idx = F.row_number().over(Window.partitionBy("vp_id").orderBy(m.delivered("id")))
    first = mem.questions.select(F.col("vp_id").alias("question_id"), idx.cast("int").alias("q_idx"), F.get("answers", F.lit(0)).alias("answer"))
    first = first.join(mem.entities.select(F.col("id").alias("answer"), "name"), "answer").select("question_id", "q_idx", F.create_map("q_idx", "name").alias("bindings"))
    steps = _steps(spark, sf_dir).join(first, ["question_id", "q_idx"]).select(c.substitute(F.col("template"), F.col("bindings")).alias("question"))
    return steps.groupBy("question").agg(F.count("*").alias("uses"))


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "entity_matches").where("left_id is not null and right_id is not null")


def beam_scores(spark, sf_dir):
    return c.cumulative_score(_pairs(spark, sf_dir), "left_id", "score")


def _states(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).select("left_id", "right_id", "pair_id", F.coalesce("score", F.lit(0.0)).alias("chain_score"), F.coalesce(F.col("verdict").cast("double"), F.lit(0.5)).alias("last_hop"))


def beam_best_per_entity(spark, sf_dir):
    return c.best_per_entity(_states(spark, sf_dir), "left_id", "right_id", "pair_id")


def beam_prune(spark, sf_dir):
    return c.prune(beam_best_per_entity(spark, sf_dir), "left_id", 5, "pair_id")


def beam_parents(spark, sf_dir):
    beams = _states(spark, sf_dir).select(F.col("left_id").alias("question_id"), (F.col("pair_id") % 2).cast("int").alias("parent"), F.col("pair_id").alias("state_id"), "chain_score")
    return c.combine_parents(beams)


def chain_score_modes(spark, sf_dir):
    s = _states(spark, sf_dir)
    modes = [F.round(c.chain_score(k, c.confidence(F.col("chain_score")), F.col("last_hop")), 6).alias(f"m_{k}") for k in ("cumulative", "similarity", "combined", "none")]
    return s.select("pair_id", *modes, F.round(c.harmonic(F.array("chain_score", "last_hop")), 6).alias("harmonic"))


def _facts(mem: m.Memory) -> DataFrame:
    live = mem.answers.where(~m.is_none(F.col("answer")) & ~m.is_text(F.col("answer"))).select("vp_id", "q_id", F.coalesce("text", F.lit("")).alias("question"), F.col("answer").alias("next_entity")).distinct()
    inside = live.select("vp_id", F.col("next_entity").alias("entity_id")).distinct()
    return inside.join(live, "vp_id").select("entity_id", "q_id", "question", "next_entity")


def chain_evidence(spark, sf_dir):
    """Two hops over the memory from each answer of every twentieth question."""
    mem = m.load(spark, sf_dir)
    start = table(spark, sf_dir, "questions").where("question_row % 20 = 0").select(F.col("question_row").alias("question_id"), F.coalesce("text", F.lit("")).alias("asked"), F.explode(F.array_distinct("answers")).alias("entity_id"))
    return c.multi_hop(start, _facts(mem), 2)


def _two_steps(spark, sf_dir) -> DataFrame:
    """Every twentieth question as a question of two steps: itself, and what its verb phrase says of the name found; every third of these has one step only."""
    q = table(spark, sf_dir, "questions").where("question_row % 20 = 0 and text is not null")
    q = q.join(m.load(spark, sf_dir).verb_phrases.where("phrase is not null").select(F.col("id").alias("vp_id"), "phrase"), "vp_id")
    texts = F.when(F.col("question_row") % 3 == 0, F.array("text")).otherwise(F.array("text", F.concat("phrase", F.lit(" <ENTITY_Q1>"))))
    return q.select(F.col("question_row").alias("question_id"), F.posexplode(texts).alias("q_idx", "template"), F.lit(True).alias("requires_retrieval"))


def _qa_search(spark, sf_dir):
    """Questions and answers of the memory by BM25 of their texts, the best 15."""
    mem = m.load(spark, sf_dir)
    rows = mem.answers.join(mem.entities.select(F.col("id").alias("answer"), "name"), "answer", "left").select("q_id", "text", F.struct("a_pos", F.coalesce("name", "answer").alias("n")).alias("x"))
    qa = rows.groupBy("q_id").agg(F.min("text").alias("question"), F.transform(F.array_sort(F.collect_list("x")), lambda s: s["n"]).alias("names"))
    qa = Scratch(spark, "qa").cut(qa.withColumn("tokens", word_tokens(F.concat_ws(" ", "question", F.array_join("names", " ")))), "qa")

    def search(asked: DataFrame) -> DataFrame:
        found = r.bm25(qa.select(F.col("q_id").alias("doc_id"), "tokens"), asked.select("query_id", word_tokens("text").alias("tokens")), 15)
        return found.join(qa.drop("tokens"), found["doc_id"] == qa["q_id"]).select("query_id", "q_id", "question", "names", F.round(F.col("score") / (1 + F.col("score")), 6).alias("score"))

    return search


def multi_hop_search(spark, sf_dir):
    """Final states of the search along reasoning chains."""
    beams, _ = c.chain_search(_two_steps(spark, sf_dir), _qa_search(spark, sf_dir))
    return beams.where("last").select("question_id", "rank", F.element_at("bindings", 1).alias("first"), F.element_at("bindings", 2).alias("answer"), "chain_score", "last_hop", F.md5(F.array_join("evidence", "\n")).alias("evidence_md5"))


def multi_hop_evidence(spark, sf_dir):
    """The evidence a reader gets, in order: along the chains, or what one search finds for questions without a chain."""
    return c.chain_search(_two_steps(spark, sf_dir), _qa_search(spark, sf_dir))[1].groupBy("question_id").agg(F.count("*").alias("texts"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")).alias("evidence_md5"))


def evidence_texts(spark, sf_dir):
    """``Q: … A: …`` of every question, each text once, in the order of the first question."""
    rows = m.resolved_answers(m.load(spark, sf_dir)).select(c.evidence_text(F.coalesce("question", F.lit("")), F.col("answer_names")).alias("evidence"), "q_id")
    return rows.groupBy("evidence").agg(F.min_by("q_id", m.delivered("q_id")).alias("first_q_id"))


def chain_statistics(spark, sf_dir):
    steps = _steps(spark, sf_dir).groupBy("question_id").agg(F.count("*").alias("steps"))
    chains = c.reasoning_chains(_steps(spark, sf_dir)).groupBy("question_id").agg(F.count("*").alias("chains"), F.max(F.size("chain")).alias("longest"))
    x = steps.join(chains, "question_id", "left").select("steps", F.coalesce("chains", F.lit(0)).alias("chains"), F.coalesce("longest", F.lit(0)).alias("longest"))
    return x.groupBy("steps").agg(F.count("*").alias("questions"), F.count_if(F.col("chains") == 0).alias("fallbacks"), F.sum("chains").alias("chains"), F.max("longest").alias("longest"))


def answers_extracted(spark, sf_dir):
    """Model replies as a template over the documents' answers, and what is read from them."""
    q = table(spark, sf_dir, "questions").where("answers is not null").select("question_row", F.explode("answers").alias("a"), "text")
    reply = F.concat(F.lit("Thought: Answer: none yet. Answer: "), F.regexp_replace("a", "^TEXT:", ""), F.when(F.col("question_row") % 2 == 0, ".").otherwise(" "))
    return q.groupBy("question_row").agg(F.min(reply).alias("reply")).select("question_row", c.extract_answer(F.col("reply")).alias("answer"))


def _predictions(spark, sf_dir) -> DataFrame:
    """The left name of a compared pair as prediction, the right one as gold."""
    names = m.load(spark, sf_dir).entities.select("id", "name")
    p = _pairs(spark, sf_dir).join(names.select(F.col("id").alias("left_id"), F.col("name").alias("prediction")), "left_id").join(names.select(F.col("id").alias("right_id"), F.col("name").alias("gold")), "right_id")
    return p.where("prediction is not null and gold is not null").select("pair_id", "verdict", "prediction", F.array("gold").alias("golds"))


def em_f1(spark, sf_dir):
    p, g = F.col("prediction"), F.col("golds")
    return _predictions(spark, sf_dir).select("pair_id", "verdict", e.exact_match(p, g).alias("em"), F.round(e.token_f1(p, g), 6).alias("f1"))


def em_f1_by_group(spark, sf_dir):
    return em_f1(spark, sf_dir).rollup("verdict").agg(F.grouping("verdict").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"))


def comparison(spark, sf_dir):
    return e.compare_systems(em_f1(spark, sf_dir).withColumn("system", F.when(F.col("verdict"), "accepted").otherwise("other")), "system", "f1", "other", "accepted")


def judge_metrics(spark, sf_dir):
    """Answers as found items; expected are those that some entity has; a dangling one scores 0."""
    mem = m.load(spark, sf_dir)
    known = mem.entities.select(F.col("id").alias("answer"), F.lit(1).alias("hit"))
    a = mem.answers.join(known, "answer", "left")
    n = a.groupBy("q_id").agg(F.count_if(F.col("hit") == 1).alias("n_truth"), F.count_if(~m.is_none(F.col("answer"))).alias("n_found"), F.coalesce(F.sum("hit"), F.lit(0)).cast("double").alias("total"))
    p, r, f = e.judged(F.col("n_truth"), F.col("n_found"), F.col("total"))
    return n.select("q_id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def judge_replies(spark, sf_dir):
    """Replies as judges pack them, around the questions' answers: bare, in prose, with scores that are no numbers, cut short."""
    q = table(spark, sf_dir, "questions").where("answers is not null").select("question_row", "answers")
    kind = F.col("question_row") % 4
    items = F.concat(F.lit("["), F.array_join(F.transform("answers", lambda a, i: F.concat(F.lit('"i'), i, F.lit('"'))), ", "), F.lit("]"))
    number = lambda i: F.when((kind == 2) & (i == 0), F.lit('"none"')).when(i % 2 == 0, F.lit("1.0")).otherwise(F.lit('"0.5"'))
    scores = F.concat(F.lit("["), F.array_join(F.transform("answers", lambda a, i: F.concat(F.lit('{"i'), i, F.lit('": '), number(i), F.lit("}"))), ", "), F.lit("]"))
    body = F.concat(F.lit('{"identified_items_in_AI_answer": '), items, F.lit(', "matching_score": '), scores, F.lit("}"))
    reply = F.when(kind == 0, F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))).when(kind == 3, F.concat(F.lit("}"), F.rtrim(body, F.lit("}")))).otherwise(body)
    j = q.select("question_row", F.size("answers").alias("n_truth"), e.read_judgement(reply).alias("j"))
    p, r, f = e.judged(F.col("n_truth"), F.col("j.n_found"), F.col("j.total"))
    return j.select("question_row", "j.n_found", "j.total", p.alias("precision"), r.alias("recall"), f.alias("f1"), "j.error")


def judge_summary(spark, sf_dir):
    """Means over all questions; a null precision doesn't count."""
    mean = lambda x: F.coalesce(F.round(F.avg(x), 4), F.lit(0.0)).alias(x)
    return judge_metrics(spark, sf_dir).withColumn("vp_id", F.regexp_extract("q_id", "^(.*)::", 1)).groupBy("vp_id").agg(mean("precision"), mean("recall"), mean("f1"))


def chapter_metrics(spark, sf_dir):
    """Documents an answer should be from (the question's own) against those its answers are from."""
    q = m.load(spark, sf_dir).questions.select("id", F.array(F.substring_index("vp_id", "_", 1)).alias("truth"), F.transform(F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.contains("::")), lambda a: F.substring_index(a, "_", 1)).alias("found"))
    p, r, f = e.set_scores(F.col("truth"), F.col("found"))
    return q.select("id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def results_with_truth(spark, sf_dir):
    """Results joined to truth on the question's text; of repeated truths the last counts."""
    q = table(spark, sf_dir, "questions").where("text is not null")
    truth = q.groupBy("text").agg(F.max_by("chunk_id", "question_row").alias("truth"), F.count("*").alias("n"))
    return q.join(truth, "text").select("question_row", "text", "truth", "n")


def token_usage(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("collection", token_estimate(F.coalesce("text", F.lit(""))).alias("t"))
    return t.groupBy("collection").agg(F.sum("t").alias("total"), F.round(F.avg("t"), 4).alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"))


def missing_documents(spark, sf_dir):
    """Document numbers of the graph run, from first to last, that have no stored chunk."""
    have = table(spark, sf_dir, "chunks").select("doc_idx").distinct()
    lo, hi = have.agg(F.min("doc_idx"), F.max("doc_idx")).first()
    return spark.range(lo or 0, (hi or -1) + 1).withColumnRenamed("id", "doc_idx").join(have, "doc_idx", "left_anti")


def missing_chunks(spark, sf_dir):
    """Chunk numbers below a document's last that were never stored."""
    c_ = table(spark, sf_dir, "chunks").select("doc_idx", "chunk_idx").distinct()
    want = c_.groupBy("doc_idx").agg(F.max("chunk_idx").alias("last")).select("doc_idx", F.explode(F.sequence(F.lit(0), "last")).alias("chunk_idx"))
    return want.join(c_, ["doc_idx", "chunk_idx"], "left_anti")


def reid_documents(spark, sf_dir):
    """Batch-relative document numbers made global: the batch's start plus the number within it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 500).alias("batch"), (F.col("doc_id") % 500).alias("local"))
    log = docs.groupBy("batch").agg(F.count("*").alias("processed")).withColumn("batch_start", F.col("batch") * 500)
    return docs.join(log, "batch").select((F.col("batch_start") + F.col("local")).alias("global_id"), "batch", "local", "processed")


QUERIES = {f.__name__: f for f in (
    step_dependencies, reasoning_chains, concrete_questions, beam_scores, beam_best_per_entity, beam_prune, beam_parents, chain_score_modes, chain_evidence, multi_hop_search, multi_hop_evidence, evidence_texts, chain_statistics,
    answers_extracted, em_f1, em_f1_by_group, comparison, judge_metrics, judge_replies, judge_summary, chapter_metrics, results_with_truth, token_usage, missing_documents, missing_chunks, reid_documents,
)}

_STEPS = MEMORY_SQL + f""", st AS (SELECT vp_id AS question_id, (row_number() OVER (PARTITION BY vp_id ORDER BY {DELIVERED}) - 1)::BIGINT AS q_idx, coalesce(text, '') AS text FROM qs),
steps AS (SELECT question_id, q_idx, CASE WHEN q_idx % 3 = 0 THEN text ELSE text || ' <ENTITY_Q' || q_idx || '>' END AS template, q_idx % 7 <> 6 AS need FROM st),
run AS (SELECT s.question_id, s.q_idx, CASE WHEN d.q_idx IS NOT NULL AND d.need THEN 1 ELSE 0 END AS link, s.need FROM steps s LEFT JOIN steps d ON d.question_id = s.question_id AND d.q_idx = s.q_idx AND s.q_idx % 3 <> 0),
grp AS (SELECT *, sum(1 - link) OVER (PARTITION BY question_id ORDER BY q_idx) AS g FROM run),
ch AS (SELECT question_id, string_agg(q_idx::VARCHAR, ' ' ORDER BY q_idx) AS chain, min(q_idx) AS head, count(*) AS n FROM grp GROUP BY question_id, g HAVING count(*) > 1)"""
_PAIRS = "WITH st AS (SELECT left_id, right_id, pair_id, coalesce(score, 0.0) AS chain_score, coalesce(verdict::INT::DOUBLE, 0.5) AS last_hop, score FROM entity_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL)"
_BEST = _PAIRS + ", best AS (SELECT left_id, right_id, pair_id, chain_score, last_hop FROM st QUALIFY row_number() OVER (PARTITION BY left_id, right_id ORDER BY chain_score DESC, last_hop DESC, pair_id) = 1)"
_CONF = "least(greatest(0.5 * ({} + 1), 1e-6), 1.0)"
_TOK = r"list_filter(regexp_split_to_array(translate(lower({}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`" + "{{|}}~', ''), " + r"'[\pZ\x09-\x0d\x{{85}}]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
_PRED = MEMORY_SQL + ", pr AS (SELECT pair_id, verdict, " + _TOK.format("a.name") + " AS p, " + _TOK.format("b.name") + """ AS g FROM entity_matches JOIN ent a ON a.id = left_id JOIN ent b ON b.id = right_id WHERE a.name IS NOT NULL AND b.name IS NOT NULL),
sh AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w))))), 0) AS s FROM pr),
sc AS (SELECT pair_id, verdict, CASE WHEN p = g THEN 1.0 ELSE 0.0 END::DOUBLE AS em, round(CASE WHEN s > 0 THEN 2.0 * s / (len(p) + len(g)) ELSE 0 END, 6)::DOUBLE AS f1 FROM sh)"""
_JUDGE = MEMORY_SQL + """, n AS (SELECT q_id, count(e.id) AS t, count(*) FILTER (answer <> 'None') AS f FROM ans LEFT JOIN ent e ON e.id = answer GROUP BY q_id),
j AS (SELECT q_id, t, f, CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN t = 0 THEN 0.0 WHEN f = 0 THEN NULL ELSE t / f END AS p, CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN t = 0 OR f = 0 THEN 0.0 ELSE 1.0 END AS r FROM n),
jm AS (SELECT q_id, round(p, 6)::DOUBLE AS "precision", round(r, 6)::DOUBLE AS recall, round(CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN t = 0 OR f = 0 THEN 0.0 ELSE coalesce(2 * p * r / nullif(p + r, 0), 0) END, 6)::DOUBLE AS f1 FROM j)"""
_TOKENS = r"regexp_extract_all(lower({}), '[\pL\pM\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')"
_CUM = "round(exp(list_avg(list_transform({}, lambda x: ln(least(greatest(0.5 * (x + 1), 1e-6), 1.0))))), 6)"
_HOPS = (
    MEMORY_SQL
    + ", qa AS (SELECT q_id, min(text) AS question, list(coalesce(e.name, answer) ORDER BY a_pos) AS names FROM ans LEFT JOIN ent e ON e.id = answer GROUP BY q_id), qat AS (SELECT q_id AS doc_id, "
    + _TOKENS.format("concat_ws(' ', question, array_to_string(names, ' '))")
    + " AS tokens FROM qa), st AS (SELECT question_row AS question_id, text, phrase, question_row % 3 = 0 AS single FROM questions JOIN vp ON vp.id = vp_id WHERE question_row % 20 = 0 AND text IS NOT NULL AND phrase IS NOT NULL)"
    + bm25_sql("SELECT * FROM qat", "SELECT DISTINCT text AS query_id, " + _TOKENS.format("text") + " AS tokens FROM st", 15, "1")
    + """, f1 AS (SELECT query_id, q_id, question, names, round(score / (1 + score), 6) AS score FROM bm1 JOIN qa ON q_id = doc_id),
mv1 AS (SELECT DISTINCT question_id, phrase, n, q_id || '=' || n AS path, score, 'Q: ' || coalesce(question, '') || ' A: ' || array_to_string(names, ', ') AS ev FROM (SELECT *, unnest(names) AS n FROM st JOIN f1 ON query_id = text WHERE NOT single)),
b1 AS (SELECT *, """ + _CUM.format("[score]") + """ AS cs FROM mv1 QUALIFY row_number() OVER (PARTITION BY question_id, n ORDER BY cs DESC, score DESC, path) = 1),
k1 AS (SELECT *, phrase || ' ' || n AS asked FROM b1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY cs DESC, score DESC, path) <= 5)"""
    + bm25_sql("SELECT * FROM qat", "SELECT DISTINCT asked AS query_id, " + _TOKENS.format("asked") + " AS tokens FROM k1", 15, "2")
    + """, f2 AS (SELECT query_id, q_id, question, names, round(score / (1 + score), 6) AS score FROM bm2 JOIN qa ON q_id = doc_id),
mv2 AS (SELECT question_id, n AS first, array_to_string(names, ', ') AS answer, f2.score AS last_hop, """ + _CUM.format("[k1.score, f2.score]") + """ AS chain_score, path || '|' || q_id || '=' || array_to_string(names, ', ') AS tie, ev AS e1, 'Q: ' || coalesce(question, '') || ' A: ' || array_to_string(names, ', ') AS e2 FROM k1 JOIN f2 ON query_id = asked),
last AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY chain_score DESC, last_hop DESC, tie) AS rank FROM mv2 QUALIFY rank <= 5)"""
)
ORACLES = {
    "multi_hop_search": _HOPS + " SELECT question_id, rank, first, answer, chain_score, last_hop, md5(e1 || chr(10) || e2) AS evidence_md5 FROM last",
    "multi_hop_evidence": _HOPS + """, said AS (SELECT question_id, rank::DOUBLE AS a, '0' AS b, e1 AS t FROM last UNION ALL SELECT question_id, rank, '1', e2 FROM last
  UNION ALL SELECT question_id, -score, q_id, 'Q: ' || coalesce(question, '') || ' A: ' || array_to_string(names, ', ') FROM st JOIN f1 ON query_id = text WHERE single),
once AS (SELECT question_id, t, min({'a': a, 'b': b}) AS o FROM said GROUP BY question_id, t)
SELECT question_id, count(*) AS texts, md5(string_agg(t, chr(10) ORDER BY o, t)) AS evidence_md5 FROM once GROUP BY question_id""",
    "step_dependencies": _STEPS + " SELECT question_id, q_idx, q_idx - 1 AS needs FROM steps WHERE q_idx % 3 <> 0",
    "reasoning_chains": _STEPS + " SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY head) - 1 AS chain_no, chain FROM ch",
    "chain_statistics": _STEPS + """, k AS (SELECT question_id, count(*) AS chains, max(n) AS longest FROM ch GROUP BY question_id), z AS (SELECT question_id, count(*) AS steps FROM steps GROUP BY question_id)
SELECT steps, count(*) AS questions, count(*) FILTER (chains IS NULL) AS fallbacks, coalesce(sum(chains), 0)::BIGINT AS chains, coalesce(max(longest), 0)::BIGINT AS longest FROM z LEFT JOIN k USING (question_id) GROUP BY steps""",
    "concrete_questions": _STEPS + ", f AS (SELECT vp_id AS question_id, row_number() OVER (PARTITION BY vp_id ORDER BY " + DELIVERED + ") AS q_idx, answers[1] AS a FROM qs) SELECT replace(template, '<ENTITY_Q' || q_idx || '>', coalesce(name, '')) AS question, count(*) AS uses FROM steps JOIN f USING (question_id, q_idx) JOIN ent ON ent.id = a GROUP BY 1",
    "beam_scores": _PAIRS + " SELECT left_id, round(exp(avg(ln(" + _CONF.format("coalesce(score, -1.0)") + "))), 6) AS chain_score, count(*) AS evidence FROM st GROUP BY left_id",
    "beam_best_per_entity": _BEST + " SELECT * FROM best",
    "beam_prune": _BEST + " SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY chain_score DESC, last_hop DESC, pair_id) AS rank FROM best QUALIFY rank <= 5",
    "beam_parents": _PAIRS + """, k AS (SELECT left_id AS question_id, pair_id % 2 AS parent, pair_id AS state_id, chain_score FROM st QUALIFY row_number() OVER (PARTITION BY left_id, pair_id % 2 ORDER BY chain_score DESC, pair_id) <= 5),
x AS (SELECT a.question_id, a.state_id AS a_state, b.state_id AS b_state, round(CASE WHEN a.chain_score > 1e-6 AND b.chain_score > 1e-6 THEN 2 / (1 / a.chain_score + 1 / b.chain_score) WHEN a.chain_score > 1e-6 THEN a.chain_score WHEN b.chain_score > 1e-6 THEN b.chain_score ELSE 1e-6 END, 6) AS chain_score FROM k a JOIN k b ON a.question_id = b.question_id AND a.parent = 0 AND b.parent = 1)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY chain_score DESC, a_state, b_state) AS rank FROM x QUALIFY rank <= 5 AND (chain_score >= 0.3 OR rank = 1)""",
    "chain_score_modes": _PAIRS + ", z AS (SELECT pair_id, " + _CONF.format("chain_score") + " AS a, " + _CONF.format("last_hop") + " AS b, chain_score AS x, last_hop AS y FROM st) SELECT pair_id, round(a, 6) AS m_cumulative, round(b, 6) AS m_similarity, round(0.5 * a + 0.5 * b, 6) AS m_combined, 1.0::DOUBLE AS m_none, round(CASE WHEN x > 1e-6 AND y > 1e-6 THEN 2 / (1 / x + 1 / y) WHEN x > 1e-6 THEN x WHEN y > 1e-6 THEN y ELSE 1e-6 END, 6) AS harmonic FROM z",
    "evidence_texts": MEMORY_SQL + ", res AS (SELECT q_id, min(text) AS question, coalesce(string_agg(coalesce(e.name, answer), ', ' ORDER BY a_pos), '') AS answer_names FROM ans LEFT JOIN ent e ON e.id = ans.answer GROUP BY q_id, vp_id) SELECT 'Q: ' || coalesce(question, '') || ' A: ' || answer_names AS evidence, arg_min(q_id, " + delivered_sql("q_id") + ") AS first_q_id FROM res GROUP BY 1",
    "answers_extracted": r"""
WITH r AS (SELECT question_row, min('Thought: Answer: none yet. Answer: ' || regexp_replace(a, '^TEXT:', '') || CASE WHEN question_row % 2 = 0 THEN '.' ELSE ' ' END) AS reply FROM (SELECT question_row, unnest(answers) AS a FROM questions) GROUP BY 1),
s AS (SELECT question_row, regexp_replace(string_split(reply, 'Answer: ')[-1], '^[\pZ\x09-\x0d\x{85}]+|[\pZ\x09-\x0d\x{85}]+$', '', 'g') AS t FROM r)
SELECT question_row, CASE WHEN regexp_matches(t, '^[\d, ]*\d[\d, ]*\.$') THEN left(t, length(t) - 1) ELSE t END AS answer FROM s""",
    "em_f1": _PRED + " SELECT * FROM sc",
    "em_f1_by_group": _PRED + " SELECT verdict, grouping(verdict)::BIGINT AS overall, count(*) AS n, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1 FROM sc GROUP BY ROLLUP (verdict)",
    "comparison": _PRED + ", m AS (SELECT coalesce(round(avg(f1) FILTER (verdict IS NOT TRUE), 6), 0) AS base, coalesce(round(avg(f1) FILTER (verdict), 6), 0) AS other FROM sc) SELECT base, other, round(other - base, 6) AS difference, round(100 * (other - base) / nullif(base, 0), 4) AS improvement FROM m",
    "judge_metrics": _JUDGE + " SELECT * FROM jm",
    "judge_replies": """
WITH q AS (SELECT question_row, question_row % 4 AS kind, len(answers) AS t FROM questions WHERE answers IS NOT NULL),
s AS (SELECT *, CASE WHEN kind = 3 THEN 0 ELSE t END AS f, CASE WHEN kind = 3 OR t = 0 THEN 0 ELSE (t + 1) // 2 + 0.5 * (t // 2) - CASE WHEN kind = 2 THEN 1 ELSE 0 END END::DOUBLE AS total FROM q),
p AS (SELECT *, CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN f = 0 THEN NULL ELSE total / f END AS p, CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN f = 0 THEN 0.0 ELSE total / t END AS r FROM s)
SELECT question_row, f::BIGINT AS n_found, total, round(p, 6)::DOUBLE AS "precision", round(r, 6)::DOUBLE AS recall, round(CASE WHEN t = 0 AND f = 0 THEN 1.0 WHEN f = 0 THEN 0 ELSE coalesce(2 * p * r / nullif(p + r, 0), 0) END, 6)::DOUBLE AS f1,
  CASE WHEN kind = 3 AND t = 0 THEN 'No JSON found in response' WHEN kind = 3 THEN 'Could not parse JSON' END AS error FROM p""",
    "judge_summary": _JUDGE + """ SELECT regexp_extract(q_id, '^(.*)::', 1) AS vp_id, coalesce(round(avg("precision"), 4), 0) AS "precision", coalesce(round(avg(recall), 4), 0) AS recall, coalesce(round(avg(f1), 4), 0) AS f1 FROM jm GROUP BY 1""",
    "chapter_metrics": MEMORY_SQL + """, s AS (SELECT id, split_part(vp_id, '_', 1) AS t, list_distinct(list_transform(list_filter(coalesce(answers, []), lambda a: contains(a, '::')), lambda a: split_part(a, '_', 1))) AS f FROM qs),
h AS (SELECT id, len(f) AS n, CASE WHEN list_contains(f, t) THEN 1 ELSE 0 END AS hit FROM s)
SELECT id, round(coalesce(hit / nullif(n, 0), 0), 6)::DOUBLE AS "precision", hit::DOUBLE AS recall, round(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / n) / (hit / n + 1) END, 6)::DOUBLE AS f1 FROM h""",
    "results_with_truth": "SELECT question_row, q.text, truth, n FROM questions q JOIN (SELECT text, arg_max_null(chunk_id, question_row) AS truth, count(*) AS n FROM questions WHERE text IS NOT NULL GROUP BY text) t ON t.text = q.text",
    "token_usage": "SELECT collection, sum(t)::BIGINT AS total, round(avg(t), 4) AS mean, min(t) AS least, max(t) AS most FROM (SELECT collection, greatest(1, floor(length(coalesce(text, '')) / 4))::BIGINT AS t FROM documents) GROUP BY collection",
    "missing_documents": "SELECT i AS doc_idx FROM (SELECT unnest(generate_series(lo, hi)) AS i FROM (SELECT min(doc_idx) AS lo, max(doc_idx) AS hi FROM chunks)) WHERE i NOT IN (SELECT doc_idx FROM chunks)",
    "missing_chunks": "WITH l AS (SELECT doc_idx, max(chunk_idx) AS m FROM chunks GROUP BY 1), w AS (SELECT doc_idx, unnest(generate_series(0, m)) AS chunk_idx FROM l) SELECT doc_idx, chunk_idx::BIGINT AS chunk_idx FROM w EXCEPT SELECT doc_idx, chunk_idx FROM chunks",
    "reid_documents": "SELECT (doc_id // 500) * 500 + doc_id % 500 AS global_id, doc_id // 500 AS batch, doc_id % 500 AS local, count(*) OVER (PARTITION BY doc_id // 500) AS processed FROM documents",
}
