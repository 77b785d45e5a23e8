"""Registered queries of searches by vectors, with a stand-in embedder, and of what verifiers and resolvers write back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import memory as m
from ..operators import reconcile as rc
from ..operators import retrieval as r
from ..operators.models import hashed_vector
from ..session import Scratch, table
from .graph import GLOBAL_SQL, LOCAL_SQL, MEMORY_SQL
from .graph import QUERIES as GRAPH
from .graph import ORACLES as GRAPH_SQL
from .retrieval import ORACLES as RETRIEVAL_SQL
from .retrieval import _asked, _named


def qa_search_vectors(spark, sf_dir):
    """QA texts, each once, by their vectors."""
    texts = Scratch(spark, "qa").cut(GRAPH["qa_texts"](spark, sf_dir), "texts")
    found = r.knn(texts.select(F.col("q_id").alias("doc_id"), hashed_vector(F.col("qa_text")).alias("vec")), _asked(spark, sf_dir).select("query_id", hashed_vector(F.col("text")).alias("vec")), 10)
    return found.join(texts.withColumnRenamed("q_id", "doc_id"), "doc_id").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").alias("q_id"), "vp_id", "qa_text", "score", "rank")


def entity_search_embedded(spark, sf_dir):
    """Entities by their vectors, and the QA pairs of those found."""
    found = r.entity_search(_named(spark, sf_dir), _asked(spark, sf_dir).select("query_id", "text"), 5, use_bm25=False, embed=hashed_vector)
    found = Scratch(spark, "routed").cut(found, "found").withColumnRenamed("doc_id", "entity_id")
    return found.join(m.qa_pairs_of_entities(m.load(spark, sf_dir)), "entity_id", "left").select("query_id", "entity_id", "score", "rank", "q_id", "question", "answer_names")


def _described(spark, sf_dir):
    """Entities of every twentieth document against all: the five nearest of other chunks, as a verifier is asked about them."""
    entities = m.load(spark, sf_dir).entities.where(F.col("name").isNotNull())
    texts = Scratch(spark, "matching").cut(entities.select("id", "name", "roles", "chunk_id", "doc_id", "chunk_idx", "pos", hashed_vector(rc.entity_text()).alias("vec")), "texts")
    found = r.knn(texts.select(F.col("id").alias("doc_id"), "vec", "chunk_id"), texts.where("doc_id % 20 = 0").select(F.col("id").alias("query_id"), "vec", "chunk_id"), 5, apart="chunk_id")
    return texts, rc.pair_descriptions(found.select(F.col("query_id").alias("new_id"), F.col("doc_id").alias("old_id"), "rank"), texts)


def embedding_pairs(spark, sf_dir):
    return _described(spark, sf_dir)[1]


def embedding_matches(spark, sf_dir):
    """Pairs that the stand-in verifier accepts: equal name keys; it is silent about names without a key."""
    texts, pairs = _described(spark, sf_dir)
    pairs = Scratch(spark, "pairs").cut(pairs, "pairs")
    key = texts.select("id", name_key("name").alias("k")).where("k <> ''")
    said = pairs.join(key.select(F.col("id").alias("new_id"), F.col("k").alias("a")), "new_id").join(key.select(F.col("id").alias("old_id"), F.col("k").alias("b")), "old_id")
    return rc.verified_pairs(pairs, said.select("chunk_id", "pair", (F.col("a") == F.col("b")).alias("verdict")))


def summary_rerank(spark, sf_dir):
    """Summaries of the entities whose names match a mention, by the cosine of mention and summary."""
    asked = _asked(spark, sf_dir)
    rows = m.first_rows(table(spark, sf_dir, "entity_nodes").select("id", "name", "summary", "arrived_at"), "id", "arrived_at").select(F.col("id").alias("doc_id"), "name", "summary")
    rows = Scratch(spark, "summaries").cut(rows.where("trim(summary) <> ''"), "rows")
    found = r.matches_ranked(asked.select("query_id", F.col("text").alias("mention")), rows.select("doc_id", "name", F.col("summary").alias("text")), 17, hashed_vector)
    return r.summary_context(found.drop("rank").join(rows, "doc_id"), 17).select("query_id", "used", F.md5("context").alias("context_md5"))


def questions_resolved(spark, sf_dir):
    """Open questions with the stand-in resolver's answer: the smallest answer that the verb phrase's other questions have, texts as texts."""
    mem = m.load(spark, sf_dir)
    asked = rc.open_questions(mem.verb_phrases, mem.questions, rc.canonical_entities(mem.entities).where("id <> canonical_id").select("canonical_id"))
    said = mem.answers.where(~m.is_none(F.col("answer"))).groupBy("vp_id").agg(F.min("answer").alias("a"))
    text = m.is_text(F.col("a"))
    replies = asked.join(said, "vp_id", "left").select("q_id", F.when(~text, F.col("a")).alias("entity_id"), F.when(text, F.substr("a", F.lit(6))).alias("answer_text"), F.substring_index("vp_id", "::", 1).alias("chunk_id"))
    return rc.write_answers(mem.questions, replies, mem.entities)


def context_node_merges(spark, sf_dir):
    """Chunks in which entities have roles, as their nodes: which merge because entities of a document do."""
    mem = m.load(spark, sf_dir)
    edges = mem.roles.select("entity_id", F.col("chunk_id").alias("node_id"), F.struct(m.delivered("entity_id").alias("of"), "role_pos").alias("place"))
    return rc.context_merges(edges, rc.canonical_entities(mem.entities, per_document=True))


QUERIES = {f.__name__: f for f in (qa_search_vectors, entity_search_embedded, embedding_pairs, embedding_matches, summary_rerank, questions_resolved, context_node_merges)}

_TOK = r"regexp_extract_all(lower({}), '[\pL\pM\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')"
_ASKED = "asked AS (SELECT CAST(substr(alt_id, 2) AS BIGINT) AS query_id, name AS text FROM entity_nodes_alt WHERE CAST(substr(alt_id, 2) AS BIGINT) % 20 = 0)"


def _vec(text: str) -> str:
    """The stand-in embedder in SQL."""
    hashed = f"list_transform({_TOK.format(text)}, lambda w: ('0x' || substr(md5(w), 1, 2))::INT % 64)"
    return f"(SELECT list_transform(range(64), lambda b: coalesce(len(list_filter(h, lambda x: x = b)), 0)::DOUBLE) FROM (SELECT {hashed} AS h))"


def _texts(name: str, source: str, text: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, {_vec(text)} AS v FROM ({source}))"


_SEARCH_TEXT = "CASE WHEN len(roles) > 0 THEN coalesce(name, '') || ' - Roles: ' || array_to_string(list_transform(roles, lambda r: coalesce(r.role, '') || CASE WHEN len(coalesce(r.states, [])) > 0 THEN ': ' || array_to_string(r.states, ', ') ELSE '' END), ' | ') ELSE coalesce(name, '') || ' - No specific roles' END"
_ENTITY_TEXT = "concat_ws(' ', 'Entity: ' || coalesce(name, ''), coalesce(array_to_string(list_transform(roles, lambda r: 'Role: ' || coalesce(r.role, '') || ' States: ' || coalesce(array_to_string(r.states, ', '), '')), ' '), ''))"
_RES = ", res AS (SELECT q_id, vp_id, min(text) AS question, coalesce(string_agg(coalesce(e.name, answer), ', ' ORDER BY a_pos), '') AS answer_names FROM ans LEFT JOIN ent e ON e.id = ans.answer GROUP BY q_id, vp_id)"
_COS = "round(list_cosine_similarity(a.v, b.v), 6)"
_PAIRS = (
    GLOBAL_SQL + ", " + _texts("tx", f"SELECT *, {_ENTITY_TEXT} AS t FROM ent WHERE name IS NOT NULL", "t")
    + f""", kn AS (SELECT a.id AS new_id, b.id AS old_id, {_COS} AS score FROM tx a JOIN tx b ON a.doc_id % 20 = 0 AND a.chunk_id <> b.chunk_id WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_id) AS rank FROM kn WHERE score > 0 QUALIFY rank <= 5),
pr AS (SELECT a.chunk_id, new_id, old_id, 'pair_' || (row_number() OVER (PARTITION BY a.chunk_id ORDER BY a.doc_id, a.chunk_idx, a.pos, new_id, rank) - 1) AS pair, a.t AS ta, b.t AS tb, a.name AS na, b.name AS nb FROM best JOIN tx a ON a.id = new_id JOIN tx b ON b.id = old_id)"""
)
_KEYED = r"lower(regexp_replace({}, '[^a-zA-Z0-9\s]', '', 'g'))"
ORACLES = {
    "qa_search_vectors": GRAPH_SQL["qa_texts"].replace(" SELECT qa_text,", ", qt AS (SELECT qa_text,", 1)
    + "), " + _ASKED + ", " + _texts("qv", "SELECT * FROM qt", "qa_text") + ", " + _texts("av", "SELECT * FROM asked", "text")
    + f" SELECT query_id, q_id, vp_id, qa_text, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, q_id) AS rank FROM av a JOIN qv b ON list_sum(a.v) > 0 AND list_sum(b.v) > 0 WHERE score > 0 QUALIFY rank <= 10",
    "entity_search_embedded": MEMORY_SQL + _RES + ", " + _ASKED + ", " + _texts("nv", f"SELECT id, {_SEARCH_TEXT} AS t FROM ent WHERE name IS NOT NULL", "t") + ", " + _texts("av", "SELECT * FROM asked", "text")
    + f""", best AS (SELECT query_id, id AS entity_id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM av a JOIN nv b ON list_sum(a.v) > 0 AND list_sum(b.v) > 0 WHERE score > 0 QUALIFY rank <= 5),
span AS (SELECT DISTINCT vp_id, answer AS entity_id FROM ans WHERE answer IN (SELECT id FROM ent)), qp AS (SELECT entity_id, q_id, question, answer_names FROM span JOIN res USING (vp_id))
SELECT query_id, entity_id, score, rank, q_id, question, answer_names FROM best LEFT JOIN qp USING (entity_id)""",
    "embedding_pairs": _PAIRS + " SELECT chunk_id, pair, new_id, old_id, pair || ': New entity ''' || ta || ''' and old entity ''' || tb || '''' AS description FROM pr",
    "embedding_matches": _PAIRS + f" SELECT new_id, old_id FROM pr WHERE {_KEYED.format('na')} = {_KEYED.format('nb')} AND {_KEYED.format('na')} <> ''",
    "summary_rerank": RETRIEVAL_SQL["approximate_matches"].replace("n AS (SELECT doc_id,", "sm AS (SELECT id AS doc_id, name, summary FROM (SELECT id, name, summary FROM entity_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at) = 1) WHERE trim(summary) <> ''), n AS (SELECT doc_id,").replace("FROM named WHERE", "FROM sm WHERE").replace("SELECT query_id AS mention_id", ", am AS (SELECT query_id", 1)
    + "), " + _texts("av", "SELECT * FROM asked", "text") + ", " + _texts("sv", "SELECT * FROM sm", "summary")
    + """, k AS (SELECT query_id, b.name, b.summary, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(CASE WHEN list_sum(a.v) > 0 AND list_sum(b.v) > 0 THEN list_cosine_similarity(a.v, b.v) END, 6), 0) DESC, doc_id) AS rk FROM am JOIN av a USING (query_id) JOIN sv b USING (doc_id) QUALIFY rk <= 17)
SELECT query_id, count(*) AS used, md5(string_agg('Entity: ' || coalesce(name, '') || chr(10) || 'Summary: ' || summary, chr(10) || chr(10) ORDER BY rk)) AS context_md5 FROM k GROUP BY query_id""",
    "questions_resolved": GLOBAL_SQL + """, hit AS (SELECT DISTINCT vp_id FROM ans WHERE answer IN (SELECT canonical_id FROM can WHERE id <> canonical_id)),
said AS (SELECT vp_id, min(answer) AS a FROM ans WHERE answer <> 'None' GROUP BY vp_id),
rep AS (SELECT qs.id, split_part(qs.vp_id, '::', 1) AS c, CASE WHEN a IS NULL THEN 'None' WHEN starts_with(a, 'TEXT:') THEN CASE WHEN a = 'TEXT:' THEN 'None' ELSE a END WHEN a = '' THEN 'None' WHEN a IN (SELECT id FROM ent) THEN a ELSE 'TEXT:None' END AS answer
  FROM qs JOIN vp ON vp.id = qs.vp_id LEFT JOIN said ON said.vp_id = qs.vp_id WHERE answers = ['None'] AND qs.vp_id IN (SELECT vp_id FROM hit))
SELECT qs.id, vp_id, text, CASE WHEN rep.id IS NULL THEN answers ELSE [answer] END AS answers, coalesce(c, chunk_id) AS chunk_id FROM qs LEFT JOIN rep ON rep.id = qs.id""",
    "context_node_merges": LOCAL_SQL + """, last AS (SELECT entity_id, rol.chunk_id AS node, role_pos, e.doc_id AS d, e.chunk_idx AS c, e.pos AS p FROM rol JOIN ent e ON e.id = entity_id QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY role_pos DESC) = 1),
mv AS (SELECT a.node AS source_id, b.node AS target_id, a.d, a.c, a.p, a.entity_id FROM can JOIN last a ON a.entity_id = id JOIN last b ON b.entity_id = canonical_id WHERE id <> canonical_id)
SELECT source_id, target_id FROM (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY d DESC, c DESC, p DESC, entity_id DESC) = 1) WHERE source_id <> target_id""",
}
