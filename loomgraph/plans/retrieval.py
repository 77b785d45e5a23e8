"""Registered queries of chunking, parsing and retrieval.  Searches ask with every row whose number is
divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens, words
from ..operators import chunking as c
from ..operators import memory as m
from ..operators import retrieval as r
from ..session import Scratch, table
from ..sources.sinks import uncached
from .graph import MEMORY_SQL, bm25_sql

K = 10


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunk_sentences(spark, sf_dir):
    return c.chunk_sentences(_documents(spark, sf_dir), "doc_id", "text", 3, 1)


def chunks_whole(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("titled", c.with_title(F.col("title"), F.col("text")))
    return c.whole_chunks(docs, "doc_id", "titled").select("doc_id", "chunk_idx", F.length("chunk_text").alias("chars"), c.token_estimate(F.col("chunk_text")).alias("tokens"))


def parse_output(spark, sf_dir):
    out = c.parse_output(table(spark, sf_dir, "gsw_raw"), "gsw_id", "payload")
    return out.select("gsw_id", "error", F.size("graph.entity_nodes").alias("n_entities"), F.size("graph.verb_phrase_nodes").alias("n_phrases"))


def _asked(spark, sf_dir) -> DataFrame:
    """Names of the second extraction as queries: query_id, text, tokens."""
    n = F.substring("alt_id", 2, 20).cast("long")
    return table(spark, sf_dir, "entity_nodes_alt").where(n % 20 == 0).select(n.alias("query_id"), F.col("name").alias("text"))


def _named(spark, sf_dir) -> DataFrame:
    e = m.load(spark, sf_dir).entities
    return e.where(F.col("name").isNotNull()).select(F.col("id").alias("doc_id"), "name", "roles")


def bm25_entities(spark, sf_dir):
    corpus = _named(spark, sf_dir).select("doc_id", words("name").alias("tokens"))
    return r.bm25(corpus, _asked(spark, sf_dir).select("query_id", words("text").alias("tokens")), K)


def bm25_search_texts(spark, sf_dir):
    """Search texts by BM25; queries without a hit by the weighted search of the fields."""
    named, asked = _named(spark, sf_dir), _asked(spark, sf_dir).select("query_id", word_tokens("text").alias("tokens"))
    found = Scratch(spark, "found").cut(r.bm25(named.select("doc_id", word_tokens(r.entity_search_text()).alias("tokens")), asked, K), "bm25")
    rest = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(r.weighted_search(named, rest, K))


def bm25_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    corpus = docs.select("doc_id", word_tokens(F.concat_ws(" ", "title", "text")).alias("tokens"))
    return r.bm25(corpus, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), word_tokens("title").alias("tokens")), K, zeros=True)


def token_search(spark, sf_dir):
    """Only names are moved, no roles."""
    rows = m.first_rows(table(spark, sf_dir, "entity_nodes").select("id", "name", "arrived_at"), "id", "arrived_at")
    return r.token_search(rows.where("name is not null").select(F.col("id").alias("doc_id"), "name"), _asked(spark, sf_dir).select("query_id", words("text").alias("tokens")), K)


def weighted_search(spark, sf_dir):
    return r.weighted_search(_named(spark, sf_dir), _asked(spark, sf_dir).select("query_id", word_tokens("text").alias("tokens")), K)


def approximate_matches(spark, sf_dir):
    asked = _asked(spark, sf_dir).select(F.col("query_id").alias("mention_id"), F.col("text").alias("mention"))
    return r.approximate_matches(asked, _named(spark, sf_dir).select("doc_id", "name"))


def query_entities(spark, sf_dir):
    asked = table(spark, sf_dir, "questions").where("question_row % 20 = 0").select(F.col("question_row").alias("query_id"), "text")
    return r.names_in_queries(asked, _named(spark, sf_dir).select("doc_id", "name"))


def summary_context(spark, sf_dir):
    """Summaries of the entities that a name search finds, best first."""
    rows = m.first_rows(table(spark, sf_dir, "entity_nodes").select("id", "name", "summary", "arrived_at"), "id", "arrived_at").select(F.col("id").alias("doc_id"), "name", "summary")
    corpus = rows.where("trim(summary) <> '' and name is not null")
    found = r.bm25(corpus.select("doc_id", words("name").alias("tokens")), _asked(spark, sf_dir).select("query_id", words("text").alias("tokens")), 30).drop("rank")
    return r.summary_context(found.join(corpus, "doc_id"))


def baseline_evidence(spark, sf_dir):
    """The five best documents of a title search as evidence, in order, with their whole texts."""
    return evidence(bm25_documents(spark, sf_dir).where("rank <= 5"), table(spark, sf_dir, "documents"))


def evidence(best: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, evidence_md5, documents) of ``best`` (query_id, doc_id, rank) and ``docs`` (doc_id, title, text); only texts that are listed are moved to their queries."""
    best = Scratch(best.sparkSession, "evidence").cut(best.select("query_id", "doc_id", "rank"), "best")
    line = F.concat(F.lit("Q: What is "), F.coalesce("title", F.lit("")), F.lit("? A: "), F.coalesce("text", F.lit("")))
    listed = best.join(docs.select("doc_id", "title", "text"), "doc_id").select("query_id", F.struct("rank", line.alias("t")).alias("x"))
    lists = listed.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("query_id", F.md5(F.array_join(F.transform("x", lambda s: s["t"]), "\n")).alias("evidence_md5"), F.size("x").alias("documents"))


def compiled_results(spark, sf_dir):
    """Questions with the answer a run has for them: questions without one get ``NA`` and no tokens; rows without text are errors and go."""
    q = table(spark, sf_dir, "questions")
    got = table(spark, sf_dir, "questions").where("answers is not null and size(answers) > 0 and answers[0] like 'TEXT:%'").select(F.col("question_row").alias("row"), F.substr(F.get("answers", F.lit(0)), F.lit(6)).alias("answer"))
    out = q.where("text is not null").join(got, q["question_row"] == got["row"], "left")
    return out.select("question_row", F.coalesce("answer", F.lit("NA")).alias("answer"), F.when(F.col("answer").isNull(), 0).otherwise(c.token_estimate(F.col("answer"))).alias("tokens"))


def search_texts(spark, sf_dir):
    return _named(spark, sf_dir).select(F.col("doc_id").alias("id"), r.entity_search_text().alias("search_text"))


def knn_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return r.knn(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), K)


def knn_other_chunk(spark, sf_dir):
    """Neighbours for matching: those of the same label are of the same chunk and don't count."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return r.knn(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 5, apart="label")


def rerank_cosine(spark, sf_dir):
    """Candidates of one lexical search reordered by vectors; candidates without a vector count as zero."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), r.unit(F.col("embedding")).alias("u"))
    found = bm25_documents(spark, sf_dir).select("query_id", "doc_id")
    found = found.join(v.select(F.col("vec_id").alias("query_id"), F.col("u").alias("qu")), "query_id", "left").join(v.select(F.col("vec_id").alias("doc_id"), F.col("u").alias("du")), "doc_id", "left")
    return r.top_k(found.select("query_id", "doc_id", F.round(F.coalesce(r.dot(F.col("qu"), F.col("du")), F.lit(0.0)), 6).alias("score")), "query_id", "score", "doc_id", 5)


def dual_retrieval(spark, sf_dir):
    """QA pairs of the entities found and QA pairs found directly, each once, entities first; the best 15 per query."""
    mem = m.load(spark, sf_dir)
    found = bm25_entities(spark, sf_dir).select("query_id", F.col("doc_id").alias("entity_id"), "score")
    by_entity = found.join(m.qa_pairs_of_entities(mem), "entity_id").select("query_id", "question", "answer_names", "score", F.lit(0).alias("source"), "q_id")
    qa = m.resolved_answers(mem).select(F.col("q_id").alias("doc_id"), "question", "answer_names", word_tokens("question").alias("tokens"))
    direct = r.bm25(qa.select("doc_id", "tokens"), _asked(spark, sf_dir).select("query_id", word_tokens("text").alias("tokens")), 15).drop("rank")
    direct = direct.join(qa.drop("tokens"), "doc_id").select("query_id", "question", "answer_names", "score", F.lit(1).alias("source"), F.col("doc_id").alias("q_id"))
    one = by_entity.unionByName(direct).groupBy("query_id", "question", "answer_names").agg(F.min(F.struct("source", -F.col("score"), "q_id")).alias("x"))
    one = one.select("query_id", "question", "answer_names", F.col("x.source").alias("source"), (-F.col("x.col2")).alias("score"), F.col("x.q_id").alias("q_id"))
    return r.top_k(one, "query_id", "score", "q_id", 15).select("query_id", "q_id", "question", "answer_names", "source", "score", "rank")


def cache_misses(spark, sf_dir):
    """Texts that no cache holds yet: stored by content, compared by content."""
    alt = table(spark, sf_dir, "entity_nodes_alt").select(F.md5(F.coalesce("name", F.lit(""))).alias("key"))
    return uncached(_named(spark, sf_dir), "name", alt).select("key", F.col("text").alias("name"))


QUERIES = {f.__name__: f for f in (chunk_sentences, chunks_whole, parse_output, bm25_entities, bm25_search_texts, bm25_documents, token_search, weighted_search, approximate_matches, query_entities, summary_context, baseline_evidence, compiled_results, search_texts, knn_cosine, knn_other_chunk, rerank_cosine, dual_retrieval, cache_misses)}

_WS = r"[\pZ\x09-\x0d\x{85}]"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{_WS}+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), " + r"'[\pL\pM\p{Nd}\p{Nl}\p{Pc}]+')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_NAMED = MEMORY_SQL + ", named AS (SELECT id AS doc_id, name, roles FROM ent WHERE name IS NOT NULL), asked AS (SELECT CAST(substr(alt_id, 2) AS BIGINT) AS query_id, name AS text FROM entity_nodes_alt WHERE CAST(substr(alt_id, 2) AS BIGINT) % 20 = 0)"
_SEARCH_TEXT = "CASE WHEN coalesce(len(roles), 0) > 0 THEN coalesce(name, '') || ' - Roles: ' || array_to_string(list_transform(roles, lambda r: coalesce(r.role, '') || CASE WHEN len(coalesce(r.states, [])) > 0 THEN ': ' || array_to_string(r.states, ', ') ELSE '' END), ' | ') ELSE coalesce(name, '') || ' - No specific roles' END"


_BM_ENTITIES = bm25_sql(f"SELECT doc_id, {_words('name')} AS tokens FROM named", f"SELECT query_id, {_words('text')} AS tokens FROM asked")
#: All documents are listed, those without a common word with score 0.
_BM_DOCS = "WITH z AS (SELECT 1)" + bm25_sql("SELECT doc_id, " + _tokens("concat_ws(' ', title, text)") + " AS tokens FROM documents", "SELECT doc_id AS query_id, " + _tokens("title") + " AS tokens FROM documents WHERE doc_id % 20 = 0", name="0") + """,
bm AS (SELECT query_id, doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, doc_id) AS rank FROM (SELECT query_id, doc_id FROM q0, c0 WHERE c0.tokens IS NOT NULL) LEFT JOIN x0 USING (query_id, doc_id) QUALIFY rank <= 10)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"
_WEIGHTED = f"""wf AS (SELECT doc_id, 1.0 AS w, lower({_SEARCH_TEXT}) AS t FROM named UNION ALL SELECT doc_id, 2.0, lower(name) FROM named UNION ALL SELECT doc_id, 1.5, lower(r.role) FROM (SELECT doc_id, unnest(roles) AS r FROM named) UNION ALL SELECT doc_id, 1.0, lower(s) FROM (SELECT doc_id, unnest(r.states) AS s FROM (SELECT doc_id, unnest(roles) AS r FROM named))),
wt AS (SELECT query_id, unnest(list_distinct({_tokens('text')})) AS token FROM asked),
wx AS (SELECT query_id, doc_id, round(sum(w), 6)::DOUBLE AS score FROM wt JOIN wf ON contains(wf.t, token) GROUP BY ALL)"""
_KNN = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), kn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score, a.label AS la, b.label AS lb FROM e a, e b WHERE a.vec_id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kn WHERE score > 0 QUALIFY rank <= 10)"
_RES = ", res AS (SELECT q_id, vp_id, min(text) AS question, coalesce(string_agg(coalesce(e.name, answer), ', ' ORDER BY a_pos), '') AS answer_names FROM ans LEFT JOIN ent e ON e.id = ans.answer GROUP BY q_id, vp_id)"
ORACLES = {
    "chunk_sentences": f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '!?', '..'), '.'), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, s, unnest(range(0, len(s), 2)) AS st FROM s WHERE len(s) > 0)
SELECT doc_id, (st // 2)::BIGINT AS chunk_idx, st::BIGINT AS start_sentence, least(st + 3, len(s))::BIGINT AS end_sentence, array_to_string(s[st + 1:st + 3], '. ') || '.' AS chunk_text FROM w""",
    "chunks_whole": "SELECT doc_id, 0::BIGINT AS chunk_idx, length(t)::BIGINT AS chars, greatest(1, floor(length(t) / 4))::BIGINT AS tokens FROM (SELECT doc_id, CASE WHEN title IS NOT NULL THEN title || chr(10) || text ELSE text END AS t FROM documents)",
    "bm25_entities": _NAMED + _BM_ENTITIES + " SELECT * FROM bm",
    "bm25_search_texts": _NAMED + bm25_sql(f"SELECT doc_id, {_tokens(_SEARCH_TEXT)} AS tokens FROM named", f"SELECT query_id, {_tokens('text')} AS tokens FROM asked") + f", {_WEIGHTED} SELECT * FROM bm UNION ALL SELECT query_id, doc_id, score, {_TOP} FROM wx WHERE query_id NOT IN (SELECT query_id FROM bm) QUALIFY rank <= 10",
    "bm25_documents": _BM_DOCS + " SELECT * FROM bm",
    "token_search": _NAMED + f", t AS (SELECT query_id, unnest({_words('text')}) AS token FROM asked), x AS (SELECT query_id, doc_id, count(*) AS score FROM t JOIN named ON contains(lower(name), token) GROUP BY ALL) SELECT query_id, doc_id, score, {_TOP} FROM x QUALIFY rank <= 10",
    "weighted_search": _NAMED + f", {_WEIGHTED} SELECT query_id, doc_id, score, {_TOP} FROM wx QUALIFY rank <= 10",
    "summary_context": _NAMED + ", sm AS (SELECT id AS doc_id, name, summary FROM entity_nodes WHERE trim(summary) <> '' AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at) = 1)" + bm25_sql(f"SELECT doc_id, {_words('name')} AS tokens FROM sm", f"SELECT query_id, {_words('text')} AS tokens FROM asked", 30) + """,
k AS (SELECT query_id, name, summary, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM bm JOIN sm USING (doc_id) WHERE trim(summary) <> '' QUALIFY rk <= 17)
SELECT query_id, count(*) AS used, string_agg('Entity: ' || coalesce(name, '') || chr(10) || 'Summary: ' || summary, chr(10) || chr(10) ORDER BY rk) AS context FROM k GROUP BY query_id""",
    "baseline_evidence": _BM_DOCS + " SELECT query_id, md5(string_agg('Q: What is ' || coalesce(title, '') || '? A: ' || coalesce(text, ''), chr(10) ORDER BY rank)) AS evidence_md5, count(*)::BIGINT AS documents FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id",
    "compiled_results": "SELECT question_row, CASE WHEN answers[1] LIKE 'TEXT:%' THEN substr(answers[1], 6) ELSE 'NA' END AS answer, CASE WHEN answers[1] LIKE 'TEXT:%' THEN greatest(1, length(substr(answers[1], 6)) // 4)::BIGINT ELSE 0 END AS tokens FROM questions WHERE text IS NOT NULL",
    "approximate_matches": _NAMED + f""", a AS (SELECT query_id, regexp_replace(lower(text), '^"|"$', '', 'g') AS mn FROM asked WHERE trim(text) <> ''), n AS (SELECT doc_id, regexp_replace(lower(name), '^"|"$', '', 'g') AS nm FROM named WHERE trim(name) <> '')
SELECT query_id AS mention_id, doc_id FROM (SELECT *, {_words('mn')} AS mw FROM a), (SELECT *, {_words('nm')} AS nw FROM n) WHERE len(list_intersect(mw, nw)) > 0 OR (len(mw) > 0 AND contains(nm, mn)) OR (len(nw) > 0 AND contains(mn, nm))""",
    "query_entities": _NAMED + f""", q AS (SELECT question_row AS query_id, lower(text) AS q FROM questions WHERE question_row % 20 = 0), n AS (SELECT doc_id, lower(name) AS nm, list_distinct({_words('name')}) AS ws FROM named),
e AS (SELECT query_id, doc_id FROM q JOIN n ON len(ws) > 0 AND contains(q, nm))
SELECT * FROM e UNION ALL SELECT query_id, doc_id FROM q JOIN n ON len(ws) > 1 AND len(list_filter(ws, lambda w: NOT contains(q, w))) = 0 WHERE query_id NOT IN (SELECT query_id FROM e)""",
    "search_texts": _NAMED + f" SELECT doc_id AS id, {_SEARCH_TEXT} AS search_text FROM named",
    "knn_cosine": _KNN + " SELECT query_id, doc_id, score, rank FROM top",
    "knn_other_chunk": _KNN + ", o AS (SELECT query_id, doc_id, score FROM kn WHERE la <> lb AND score > 0) SELECT *, " + _TOP + " FROM o QUALIFY rank <= 5",
    "rerank_cosine": _BM_DOCS + f", e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), o AS (SELECT query_id, doc_id, round(coalesce(list_cosine_similarity(a.v, b.v), 0.0), 6) AS score FROM bm LEFT JOIN e a ON a.vec_id = query_id LEFT JOIN e b ON b.vec_id = doc_id) SELECT *, {_TOP} FROM o QUALIFY rank <= 5",
    "dual_retrieval": _NAMED + _RES + _BM_ENTITIES + bm25_sql("SELECT q_id AS doc_id, " + _tokens("question") + " AS tokens FROM res", "SELECT query_id, " + _tokens("text") + " AS tokens FROM asked", 15, "2") + """,
span AS (SELECT DISTINCT vp_id, answer AS entity_id FROM ans WHERE answer IN (SELECT id FROM ent)),
u AS (SELECT query_id, question, answer_names, score, 0::BIGINT AS source, q_id FROM bm JOIN span ON span.entity_id = doc_id JOIN res USING (vp_id) UNION ALL SELECT query_id, question, answer_names, score, 1::BIGINT, q_id FROM bm2 JOIN res ON q_id = doc_id),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, question, answer_names ORDER BY source, score DESC, q_id) = 1)
SELECT query_id, q_id, question, answer_names, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, q_id) AS rank FROM o QUALIFY rank <= 15""",
    "cache_misses": _NAMED + " SELECT md5(name) AS key, min(name) AS name FROM named WHERE md5(name) NOT IN (SELECT md5(coalesce(name, '')) FROM entity_nodes_alt) GROUP BY 1",
}
