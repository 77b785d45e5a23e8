"""Registered queries on the memory graph: mutators, reconciliation, neighbourhoods, export, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import memory as m
from ..operators import reconcile as r
from ..session import table

#: The memory of the workspace tables, as common table expressions.
MEMORY_SQL = r"""
WITH ent AS (
  SELECT id, name, roles, c AS chunk_id, TRY_CAST(split_part(c, '_', 1) AS BIGINT) AS doc_id, TRY_CAST(split_part(c, '_', -1) AS INT) AS chunk_idx, TRY_CAST(regexp_extract(id, '::[a-z]+(\d+)$', 1) AS INT) AS pos
  FROM (SELECT *, coalesce(chunk_id, split_part(id, '::', 1)) AS c FROM entity_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at) = 1)),
rol AS (
  SELECT entity_id, i - 1 AS role_pos, r.role AS role, coalesce(r.states, []) AS states, coalesce(r.chunk_id, chunk_id) AS chunk_id
  FROM (SELECT id AS entity_id, chunk_id, unnest(roles) AS r, generate_subscripts(roles, 1) AS i FROM ent)),
vp AS (
  SELECT id, phrase, c AS chunk_id, TRY_CAST(split_part(c, '_', 1) AS BIGINT) AS doc_id, TRY_CAST(split_part(c, '_', -1) AS INT) AS chunk_idx
  FROM (SELECT *, coalesce(chunk_id, split_part(id, '::', 1)) AS c FROM verb_phrase_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at) = 1)),
qs AS (SELECT id, vp_id, text, answers, chunk_id FROM questions QUALIFY row_number() OVER (PARTITION BY id ORDER BY question_row) = 1),
ans AS (SELECT id AS q_id, vp_id, text, unnest(answers) AS answer, generate_subscripts(answers, 1) - 1 AS a_pos FROM qs)
"""


def bm25_sql(corpus: str, queries: str, k: int = 10, name: str = "") -> str:
    """BM25 over ``corpus`` (doc_id, tokens) and ``queries`` (query_id, tokens), as common table expressions."""
    n = name
    return f""", c{n} AS ({corpus}), q{n} AS ({queries}), s{n} AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS mean FROM c{n} WHERE tokens IS NOT NULL),
p{n} AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM c{n}) GROUP BY ALL),
d{n} AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p{n}, s{n} GROUP BY term, n),
m{n} AS (SELECT avg(idf) AS mean_idf FROM d{n}),
a{n} AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(tokens) AS term FROM q{n}) GROUP BY ALL),
x{n} AS (SELECT query_id, doc_id, round(sum(CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean)) * qf), 6) AS score FROM p{n} JOIN a{n} USING (term) JOIN d{n} USING (term), m{n}, s{n} GROUP BY query_id, doc_id),
bm{n} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x{n} WHERE score > 0 QUALIFY rank <= {k})"""


def delivered_sql(node: str) -> str:
    """Order of delivery of an identifier, as a struct of numbers."""
    chunk = f"split_part({node}, '::', 1)"
    return f"{{'d': TRY_CAST(split_part({chunk}, '_', 1) AS BIGINT), 'c': TRY_CAST(split_part({chunk}, '_', -1) AS BIGINT), 'n': TRY_CAST(regexp_extract({node}, '([0-9]+)$', 1) AS BIGINT), 'i': {node}}}"


DELIVERED = delivered_sql("id")
_FIRST = ", key AS (SELECT *, lower(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g')) AS k FROM ent), can AS (SELECT id, CASE WHEN k IS NULL OR k = '' OR fc = chunk_id THEN id ELSE fi END AS canonical_id FROM (SELECT *, first_value(chunk_id) OVER w AS fc, first_value(id) OVER w AS fi FROM key WINDOW w AS (PARTITION BY {scope}k ORDER BY doc_id, chunk_idx, pos, chunk_id, id)))".replace("\\\\", "\\")
_EDGES = ", edges AS (SELECT DISTINCT least(left_id, right_id) AS src, greatest(left_id, right_id) AS dst FROM entity_matches WHERE verdict AND left_id <> right_id AND left_id IN (SELECT id FROM ent) AND right_id IN (SELECT id FROM ent))"
GLOBAL_SQL = MEMORY_SQL + _FIRST.format(scope="")
LOCAL_SQL = MEMORY_SQL + _FIRST.format(scope="doc_id, ")


def _edges(spark: SparkSession, sf_dir: str, mem: m.Memory) -> DataFrame:
    return m.similarity_edges(table(spark, sf_dir, "entity_matches").where("verdict"), mem.entities)


def _query(build):
    """A query from a function of the memory."""
    return lambda spark, sf_dir: build(m.load(spark, sf_dir))


def most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = m.load(spark, sf_dir)
    return m.most_connected(mem, _edges(spark, sf_dir, mem))


def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, m.load(spark, sf_dir))


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = m.load(spark, sf_dir)
    return r.merged_edges(_edges(spark, sf_dir, mem), r.canonical_entities(mem.entities))


def context_nodes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as space nodes, one per chunk and name; all nodes of one name in a document merge into the first."""
    nodes, merges = _context(m.load(spark, sf_dir))
    out = m.merge_context_nodes(nodes, merges)
    return out.select("node_id", "chunk_id", "current_name", m.history_text(F.col("name_history")).alias("history"))


def _context(mem: m.Memory) -> tuple[DataFrame, DataFrame]:
    key = name_key("name")
    named = mem.entities.where(F.col("name").isNotNull() & (key != "")).select("doc_id", key.alias("k"), "chunk_id", "chunk_idx", "id", "name", "pos")
    nodes = named.select(F.col("id").alias("node_id"), "chunk_id", F.create_map("chunk_id", "name").alias("name_history"), F.col("name").alias("current_name"))
    place = F.struct("chunk_idx", "pos", "id")
    heads = named.groupBy("doc_id", "k").agg(F.min(place).alias("a")).select(F.col("doc_id").alias("d"), F.col("k").alias("k2"), F.col("a.id").alias("target_id"))
    merges = named.join(heads, (F.col("k") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("d"))).where("id <> target_id")
    return nodes, merges.select(F.col("id").alias("source_id"), "target_id", place.alias("place"))


def entities_unmerged(mem: m.Memory) -> DataFrame:
    """Entities that reconciliation adds to the memory: those that become no other."""
    can = r.canonical_entities(mem.entities)
    return mem.entities.join(can.where("id <> canonical_id").select("id"), "id", "left_anti").select("id", "name", "doc_id")


def globalised_answers(mem: m.Memory) -> DataFrame:
    """Answers with their kind: an entity's id, a text, none, or an id that no entity has."""
    rows = mem.answers.join(mem.entities.select(F.col("id").alias("answer"), F.lit(1).alias("hit")), "answer", "left")
    kind = F.when(m.is_none(F.col("answer")), "none").when(m.is_text(F.col("answer")), "text").when(F.col("hit").isNotNull(), "entity").otherwise("dangling")
    return rows.groupBy("vp_id").agg(*(F.count_if(kind == k).alias(k) for k in ("entity", "text", "none", "dangling")))


def open_questions(mem: m.Memory) -> DataFrame:
    return r.open_questions(mem.verb_phrases, mem.questions, r.canonical_entities(mem.entities).where("id <> canonical_id"))


def entity_texts(mem: m.Memory) -> DataFrame:
    return mem.entities.select("id", r.entity_text().alias("entity_text"))


def qa_texts(mem: m.Memory) -> DataFrame:
    """QA texts, each once: the first question's data stay."""
    rows = m.resolved_answers(mem).select(F.concat_ws(" ", "question", F.when(F.col("answer_names") != "", F.col("answer_names"))).alias("qa_text"), "q_id", "vp_id")
    return rows.groupBy("qa_text").agg(F.min_by(F.struct("q_id", "vp_id"), F.struct(m.delivered("q_id"), "vp_id")).alias("x"), F.count("*").alias("copies")).select("qa_text", "x.q_id", "x.vp_id", "copies")


def corpus_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree of canonical entities over the whole memory: the flagship query."""
    mem = m.load(spark, sf_dir)
    can = r.canonical_entities(mem.entities)
    return m.most_connected(mem, _edges(spark, sf_dir, mem)).drop("name").join(can, "id").groupBy("canonical_id").agg(F.sum("degree").alias("degree"), F.count("*").alias("members"))


def canonical_relabelled(mem: m.Memory) -> DataFrame:
    return m.rewrite_answers(mem.questions, r.canonical_entities(mem.entities))


QUERIES = {
    "corpus_top_entities": corpus_top_entities,
    "entity_canonical_global": _query(lambda x: r.canonical_entities(x.entities)),
    "entity_canonical_local": _query(lambda x: r.canonical_entities(x.entities, per_document=True)),
    "entity_canonical_compat": _query(lambda x: r.canonical_entities(x.entities, empty_keys=True)),
    "entity_merge_roles": _query(lambda x: m.merge_roles(x.roles, r.canonical_entities(x.entities), x.entities)),
    "entities_unmerged": _query(entities_unmerged),
    "answers_rewritten": _query(canonical_relabelled),
    "answer_kinds": _query(globalised_answers),
    "open_questions": _query(open_questions),
    "verb_phrase_reconcile": _query(lambda x: r.reconcile_verb_phrases(x.verb_phrases, x.questions)),
    "entity_texts": _query(entity_texts),
    "qa_texts": _query(qa_texts),
    "most_connected": most_connected,
    "similarity_edges": similarity_edges,
    "merged_edges": merged_edges,
    "context_nodes_merged": context_nodes_merged,
    "connected_entities": _query(m.connected_entities),
    "entity_context": _query(m.entity_context),
    "entity_qa_pairs": _query(m.qa_pairs_of_entities),
    "timeline_roles": _query(m.timeline_roles),
    "timeline_actions": _query(m.timeline_actions),
    "graph_nodes": _query(m.graph_nodes),
    "graph_edges": _query(m.graph_edges),
    "node_evolution": _query(m.node_evolution),
    "reconcile_stats": _query(lambda x: m.memory_statistics(x, r.canonical_entities(x.entities, per_document=True))),
    "role_histogram": _query(m.role_histogram),
    "corpus_stats": _query(m.corpus_statistics),
}

_LIVE = "answer <> 'None' AND NOT starts_with(answer, 'TEXT:')"
_RESOLVED = ", res AS (SELECT q_id, vp_id, min(text) AS question, coalesce(string_agg(coalesce(e.name, answer), ', ' ORDER BY a_pos), '') AS answer_names FROM ans LEFT JOIN ent e ON e.id = ans.answer GROUP BY q_id, vp_id)"
_GEDGES = f""", rows AS (
  SELECT id, vp_id, CASE WHEN coalesce(len(list_filter(answers, lambda a: a <> 'None')), 0) = 0 THEN ['unresolved_' || vp_id || '_' || id] ELSE list_filter(answers, lambda a: a <> 'None') END AS a FROM qs),
gedges AS (SELECT source, target, arg_max(q_id, {delivered_sql("q_id")}) AS q_id FROM (SELECT vp_id AS source, unnest(a) AS target, id AS q_id FROM rows) GROUP BY source, target)"""
_DEGREE = _EDGES + f", ends AS (SELECT answer AS id FROM ans WHERE {_LIVE} UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT ent.id, name, count(ends.id) AS degree FROM ent LEFT JOIN ends ON ends.id = ent.id GROUP BY ent.id, name)"
ORACLES = {
    "corpus_top_entities": GLOBAL_SQL + _DEGREE + " SELECT canonical_id, sum(degree)::BIGINT AS degree, count(*) AS members FROM deg JOIN can USING (id) GROUP BY canonical_id",
    "entity_canonical_global": GLOBAL_SQL + " SELECT * FROM can",
    "entity_canonical_local": LOCAL_SQL + " SELECT * FROM can",
    "entity_canonical_compat": GLOBAL_SQL.replace("k IS NULL OR k = '' OR", "k IS NULL OR") + " SELECT * FROM can",
    "entity_merge_roles": GLOBAL_SQL + " SELECT canonical_id, role, chunk_id, states FROM (SELECT canonical_id, rol.role, rol.chunk_id, rol.states, row_number() OVER (PARTITION BY canonical_id, rol.role, rol.chunk_id ORDER BY doc_id, chunk_idx, pos, ent.id, role_pos) AS rn FROM rol JOIN can ON can.id = entity_id JOIN ent ON ent.id = entity_id) WHERE rn = 1",
    "entities_unmerged": GLOBAL_SQL + " SELECT id, name, doc_id FROM ent JOIN can USING (id) WHERE id = canonical_id",
    "answers_rewritten": GLOBAL_SQL + " SELECT q_id AS id, list(coalesce(canonical_id, answer) ORDER BY a_pos) AS answers FROM ans LEFT JOIN can ON can.id = answer AND can.id <> canonical_id GROUP BY q_id HAVING bool_or(canonical_id IS NOT NULL)",
    "answer_kinds": MEMORY_SQL + " SELECT vp_id, count(*) FILTER (k = 'entity') AS entity, count(*) FILTER (k = 'text') AS text, count(*) FILTER (k = 'none') AS \"none\", count(*) FILTER (k = 'dangling') AS dangling FROM (SELECT vp_id, CASE WHEN answer = 'None' THEN 'none' WHEN starts_with(answer, 'TEXT:') THEN 'text' WHEN e.id IS NOT NULL THEN 'entity' ELSE 'dangling' END AS k FROM ans LEFT JOIN ent e ON e.id = answer) GROUP BY vp_id",
    "open_questions": GLOBAL_SQL + ", hit AS (SELECT DISTINCT vp_id FROM ans WHERE answer IN (SELECT canonical_id FROM can WHERE id <> canonical_id)) SELECT qs.vp_id, qs.id AS q_id, phrase, text AS question FROM qs JOIN vp ON vp.id = qs.vp_id WHERE answers = ['None'] AND qs.vp_id IN (SELECT vp_id FROM hit)",
    "entity_texts": MEMORY_SQL + " SELECT id, concat_ws(' ', 'Entity: ' || coalesce(name, ''), coalesce(array_to_string(list_transform(roles, lambda r: 'Role: ' || coalesce(r.role, '') || ' States: ' || coalesce(array_to_string(r.states, ', '), '')), ' '), '')) AS entity_text FROM ent",
    "qa_texts": MEMORY_SQL + _RESOLVED + ", t AS (SELECT concat_ws(' ', question, nullif(answer_names, '')) AS qa_text, q_id, vp_id FROM res) SELECT qa_text, arg_min(q_id, {'o': " + delivered_sql("q_id") + ", 'v': vp_id}) AS q_id, arg_min(vp_id, {'o': " + delivered_sql("q_id") + ", 'v': vp_id}) AS vp_id, count(*) AS copies FROM t GROUP BY qa_text",
    "most_connected": MEMORY_SQL + _DEGREE + " SELECT id, name, degree FROM deg",
    "similarity_edges": MEMORY_SQL + _EDGES + " SELECT src, dst FROM edges",
    "merged_edges": GLOBAL_SQL + _EDGES + " SELECT DISTINCT least(a.canonical_id, b.canonical_id) AS src, greatest(a.canonical_id, b.canonical_id) AS dst FROM edges JOIN can a ON a.id = src JOIN can b ON b.id = dst WHERE a.canonical_id <> b.canonical_id",
    "context_nodes_merged": MEMORY_SQL + r""", named AS (SELECT *, lower(regexp_replace(name, '[^a-zA-Z0-9\s]', '', 'g')) AS k FROM ent WHERE name IS NOT NULL),
placed AS (SELECT *, first_value(id) OVER w AS head, row_number() OVER w AS place FROM named WHERE k <> '' WINDOW w AS (PARTITION BY doc_id, k ORDER BY chunk_idx, pos, id)),
per_chunk AS (SELECT head, chunk_id, arg_min(name, place) AS name FROM placed GROUP BY head, chunk_id)
SELECT head AS node_id, max(chunk_id) AS chunk_id, arg_max(name, chunk_id) AS current_name, string_agg('Chunk' || chunk_id || ':' || name, ', ' ORDER BY chunk_id) AS history FROM per_chunk GROUP BY head""",
    "connected_entities": MEMORY_SQL + f", l AS (SELECT DISTINCT vp_id, answer AS id FROM ans WHERE {_LIVE}) SELECT DISTINCT a.id, b.id AS neighbour FROM l a JOIN l b USING (vp_id) WHERE a.id <> b.id",
    "entity_context": MEMORY_SQL + f", mine AS (SELECT DISTINCT q_id, text AS question, answer AS entity_id FROM ans WHERE {_LIVE} AND answer IN (SELECT id FROM ent)), oth AS (SELECT DISTINCT q_id, answer AS co_answer, coalesce(e.name, answer) AS co_name FROM ans LEFT JOIN ent e ON e.id = answer WHERE answer <> 'None') SELECT entity_id, mine.q_id, question, co_answer, co_name FROM mine LEFT JOIN oth ON oth.q_id = mine.q_id AND co_answer <> entity_id",
    "entity_qa_pairs": MEMORY_SQL + _RESOLVED + ", span AS (SELECT DISTINCT vp_id, answer AS entity_id FROM ans WHERE answer IN (SELECT id FROM ent)) SELECT entity_id, q_id, question, answer_names FROM span JOIN res USING (vp_id)",
    "timeline_roles": MEMORY_SQL + r""" SELECT entity_id, chunk_id, string_agg('  - Role: ' || coalesce(role, 'None') || CASE WHEN len(states) > 0 THEN chr(10) || '    States: [' || array_to_string(list_transform(states, lambda s: '"' || coalesce(s, 'null') || '"'), ', ') || ']' ELSE '' END, chr(10) ORDER BY role_pos) AS roles_text FROM rol WHERE chunk_id IS NOT NULL GROUP BY entity_id, chunk_id""",
    "timeline_actions": MEMORY_SQL + f" SELECT entity_id, qs.chunk_id, l.vp_id, q_id, phrase, l.text AS answered_question FROM (SELECT DISTINCT q_id, vp_id, text, answer AS entity_id FROM ans WHERE {_LIVE} AND answer IN (SELECT id FROM ent)) l JOIN qs ON qs.id = q_id JOIN vp ON vp.id = l.vp_id WHERE qs.chunk_id IS NOT NULL",
    "graph_nodes": MEMORY_SQL + _GEDGES + " SELECT id AS node_id, 'entity' AS node_type, name AS label FROM ent UNION ALL SELECT id, 'verb_phrase', phrase FROM vp UNION ALL SELECT DISTINCT target, CASE WHEN starts_with(target, 'unresolved_') THEN 'unresolved' ELSE 'placeholder' END, target FROM gedges WHERE target NOT IN (SELECT id FROM ent UNION ALL SELECT id FROM vp)",
    "graph_edges": MEMORY_SQL + _GEDGES + " SELECT source, target, q_id FROM gedges",
    "node_evolution": MEMORY_SQL + " SELECT ent.id AS entity_id, count(DISTINCT rol.chunk_id) AS role_chunks, count(DISTINCT rol.chunk_id) > 1 AS evolves, CASE WHEN length(name) > 20 THEN left(name, 20) || '...' ELSE name END AS short_label FROM ent LEFT JOIN rol ON rol.entity_id = ent.id GROUP BY ent.id, name",
    "reconcile_stats": LOCAL_SQL + """, sp AS (SELECT canonical_id, count(DISTINCT rol.chunk_id) AS spans FROM rol JOIN can ON can.id = entity_id GROUP BY canonical_id),
x AS (SELECT doc_id, can.id, canonical_id, spans, coalesce(len(roles), 0) AS n FROM can JOIN ent USING (id) LEFT JOIN sp USING (canonical_id)),
g AS (SELECT doc_id, count(*) AS input_entities, count(*) FILTER (id = canonical_id) AS reconciled_entities, count(*) FILTER (id = canonical_id AND spans > 1) AS entities_with_evolution, sum(n)::BIGINT AS total_roles FROM x GROUP BY GROUPING SETS ((doc_id), ()))
SELECT *, round(coalesce(reconciled_entities / nullif(input_entities, 0), 0), 6) AS compression_ratio, round(coalesce(total_roles / nullif(reconciled_entities, 0), 0), 6) AS avg_roles FROM g""",
    "role_histogram": MEMORY_SQL + " SELECT (coalesce(len(roles), 0) // 10 * 10)::BIGINT AS bucket, count(*) AS entities FROM ent GROUP BY 1",
    "corpus_stats": MEMORY_SQL + " SELECT count(*) AS entities, count(*) FILTER (len(roles) > 0) AS with_roles, round(avg(coalesce(len(roles), 0)), 6) AS avg_roles, count(DISTINCT doc_id) AS documents, count(DISTINCT chunk_id) AS chunks FROM ent",
}
