"""Registered queries of the text pipeline with stand-in models, of exports and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import memory as m
from ..operators import models as mo
from ..operators.chunking import chunk_sentences
from ..sources.sinks import cytoscape, preview
from ..streaming import incremental as inc
from ..session import table
from .graph import MEMORY_SQL
from .graph import ORACLES as GRAPH_SQL


def extracted_entities(spark, sf_dir):
    """Documents to chunks to names; of each name in a document the first chunk and how often it is named."""
    chunks = chunk_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 0)
    names = mo.extract_mentions(chunks.withColumn("at", F.struct("doc_id", "chunk_idx")), "at", "chunk_text").select("at.*", "name")
    return names.groupBy("doc_id", name_key("name").alias("key")).agg(F.min("chunk_idx").alias("first_chunk"), F.count("*").alias("mentions"))


def chunk_mentions(spark, sf_dir):
    """Names in stored chunks against the entities of the same chunk: how many are found by exact key."""
    chunks = m.first_rows(table(spark, sf_dir, "chunks").select("chunk_id", "text", "arrived_at"), "chunk_id", "arrived_at")
    said = mo.extract_mentions(chunks, "chunk_id", "text").select("chunk_id", name_key("name").alias("key")).distinct()
    known = m.load(spark, sf_dir).entities.select("chunk_id", name_key("name").alias("key")).where("key <> ''").distinct()
    hits = said.join(known.withColumn("hit", F.lit(1)), ["chunk_id", "key"], "left")
    return hits.groupBy("chunk_id").agg(F.count("*").alias("said"), F.count("hit").alias("known"))


def question_mentions(spark, sf_dir):
    q = table(spark, sf_dir, "questions").where("text is not null")
    return mo.extract_mentions(q, "question_row", "text")


def space_time_edges(spark, sf_dir):
    """Years in chunks of the documents, linked to the names in the chunk."""
    chunks = chunk_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 0)
    return mo.space_time(chunks.select(F.concat_ws("_", "doc_id", "chunk_idx").alias("chunk_id"), F.col("chunk_text").alias("text")))[1]


def replies_read(spark, sf_dir):
    """Replies as models pack them, around the questions' answers, and the answers read from them."""
    q = table(spark, sf_dir, "questions").where("answers is not null and size(answers) > 0").select("question_row", F.transform("answers", lambda a: F.regexp_replace(a, r"[^A-Za-z0-9_: ]", "")).alias("a"))
    listed = F.concat(F.lit('{"answer": ["'), F.array_join("a", '", "'), F.lit('"]}'))
    single = F.concat(F.lit('{"answer": "'), F.get("a", F.lit(0)), F.lit('"}'))
    reply = F.when(F.col("question_row") % 3 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(F.col("question_row") % 3 == 1, single).otherwise(F.get("a", F.lit(0)))
    return q.select("question_row", mo.read_reply(reply).alias("answer"))


def graph_elements(spark, sf_dir):
    mem = m.load(spark, sf_dir)
    return cytoscape(m.graph_nodes(mem), m.graph_edges(mem)).groupBy(F.substring(F.md5("element"), 1, 3).alias("bucket")).agg(F.count("*").alias("elements"), F.sum(F.length("element").cast("long")).alias("chars"))


def document_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def stream_first_names(spark, sf_dir):
    return inc.first_of_name(spark, inc.arriving(spark, sf_dir, "entity_nodes"))


def stream_question_windows(spark, sf_dir):
    out = inc.question_windows(spark, inc.arriving(spark, sf_dir, "questions"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (extracted_entities, chunk_mentions, question_mentions, space_time_edges, replies_read, graph_elements, document_previews, stream_first_names, stream_question_windows)}

_KEY = r"lower(regexp_replace({}, '[^a-zA-Z0-9\s]', '', 'g'))"
_CAPS = r"list_distinct(regexp_extract_all({}, '\p{{Lu}}[\p{{L}}-]+(?: \p{{Lu}}[\p{{L}}-]+)+'))"
_STRIP = r"regexp_replace(x, '^[\pZ\x09-\x0d\x{85}]+|[\pZ\x09-\x0d\x{85}]+$', '', 'g')"
_CHUNKS = "ck AS (SELECT chunk_id, text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY arrived_at) = 1)"
ORACLES = {
    "extracted_entities": f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '!?', '..'), '.'), lambda x: {_STRIP}), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, s, unnest(range(0, len(s), 4)) AS st FROM s WHERE len(s) > 0),
n AS (SELECT doc_id, (st // 4)::BIGINT AS c, unnest({_CAPS.format("array_to_string(s[st + 1:st + 4], '. ') || '.'")}) AS name FROM w)
SELECT doc_id, {_KEY.format('name')} AS key, min(c) AS first_chunk, count(*) AS mentions FROM n GROUP BY 1, 2""",
    "chunk_mentions": MEMORY_SQL + f", {_CHUNKS}, said AS (SELECT DISTINCT chunk_id, {_KEY.format('name')} AS key FROM (SELECT chunk_id, unnest({_CAPS.format('text')}) AS name FROM ck)), kn AS (SELECT DISTINCT chunk_id, {_KEY.format('name')} AS key, 1 AS hit FROM ent WHERE {_KEY.format('name')} <> '') SELECT chunk_id, count(*) AS said, count(hit) AS known FROM said LEFT JOIN kn USING (chunk_id, key) GROUP BY chunk_id",
    "question_mentions": f"SELECT question_row, (i - 1)::BIGINT AS pos, name FROM (SELECT question_row, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT question_row, list_filter(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}-]+(?: \\p{{Lu}}[\\p{{L}}-]+)+'), lambda x, i: list_position(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}-]+(?: \\p{{Lu}}[\\p{{L}}-]+)+'), x) = i) AS l FROM questions WHERE text IS NOT NULL))",
    "space_time_edges": f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '!?', '..'), '.'), lambda x: {_STRIP}), lambda x: x <> '') AS s FROM documents),
w AS (SELECT doc_id, s, unnest(range(0, len(s), 4)) AS st FROM s WHERE len(s) > 0),
ck AS (SELECT doc_id || '_' || st // 4 AS chunk_id, array_to_string(s[st + 1:st + 4], '. ') || '.' AS text FROM w)
SELECT DISTINCT chunk_id, entity, tag_value FROM (SELECT chunk_id, entity, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda y: length(y) = 4)) AS tag_value FROM (SELECT chunk_id, text, unnest({_CAPS.format('text')}) AS entity FROM ck))""",
    "replies_read": "SELECT question_row, CASE WHEN question_row % 3 = 0 THEN array_to_string(a, ', ') ELSE a[1] END AS answer FROM (SELECT question_row, list_transform(answers, lambda x: regexp_replace(x, '[^A-Za-z0-9_: ]', '', 'g')) AS a FROM questions WHERE answers IS NOT NULL AND len(answers) > 0)",
    "graph_elements": f"""
WITH nd AS ({GRAPH_SQL["graph_nodes"]}), ed AS ({GRAPH_SQL["graph_edges"]}),
el AS (SELECT CASE WHEN label IS NULL THEN to_json({{'data': {{'id': node_id, 'type': node_type}}}}) ELSE to_json({{'data': {{'id': node_id, 'label': label, 'type': node_type}}}}) END::VARCHAR AS element FROM nd
  UNION ALL SELECT to_json({{'data': {{'source': source, 'target': target, 'label': q_id}}}})::VARCHAR FROM ed)
SELECT left(md5(element), 3) AS bucket, count(*) AS elements, sum(length(element))::BIGINT AS chars FROM el GROUP BY 1""",
    "document_previews": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents",
    "stream_first_names": f"SELECT {_KEY.format('name')} AS name_key, arg_min(id, {{'d': TRY_CAST(split_part(coalesce(chunk_id, id), '_', 1) AS BIGINT), 'c': TRY_CAST(split_part(coalesce(chunk_id, split_part(id, '::', 1)), '_', -1) AS BIGINT), 'n': TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT), 'i': id}}) AS first_id, count(*) AS seen FROM entity_nodes WHERE name IS NOT NULL AND {_KEY.format('name')} <> '' GROUP BY 1",
    "stream_question_windows": "SELECT strftime(time_bucket(INTERVAL 7 DAY, recorded_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AT TIME ZONE 'UTC', '%Y-%m-%d') AS window_start, chunk_id IS NOT NULL AS chunk_known, count(*) AS questions FROM questions GROUP BY 1, 2",
}
