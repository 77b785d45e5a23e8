"""Registered queries of readers and writers: tables go out in a format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as m
from ..operators import reconcile as r
from ..session import Scratch, table
from ..sources import files, sinks
from .graph import LOCAL_SQL, MEMORY_SQL


def _path(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, 'files').base}/{name}"


def corpus_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus as JSON lines, numbered on reading: of equal texts as many numbers as copies."""
    path = _path(spark, "corpus")
    table(spark, sf_dir, "documents").where("title is not null or text is not null").select("title", "text").write.json(path)
    docs = files.read_corpus(spark, path, lines=True)
    return docs.groupBy("title", F.md5("text").alias("text_md5"), F.length("combined").alias("chars")).agg(F.count_distinct("id").alias("numbers"))


def question_set_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set as JSON lines: the answer in its field, a text or a list, and aliases."""
    path = _path(spark, "questions")
    q = table(spark, sf_dir, "questions").where("text is not null").select(F.col("question_row").cast("string").alias("_id"), F.col("text").alias("question"), F.get("answers", F.lit(0)).alias("answer"), F.slice("answers", 2, 1).alias("answer_aliases"))
    q.write.json(path)
    out = files.read_questions(spark, path, "musique", lines=True)
    return out.select(F.col("id").cast("bigint").alias("question_row"), "question", F.array_join("golds", "|").alias("golds"), F.size("golds").alias("n_golds"), "answerable")


def memory_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reconciled memory written and read again, and what its statistics file says, document by document."""
    path = _path(spark, "memory")
    mem = m.load(spark, sf_dir)
    sinks.write_memory(mem, m.memory_statistics(mem, r.canonical_entities(mem.entities, per_document=True)), path)
    back, statistics = files.read_memory(spark, path)
    roles = back.roles.join(back.entities.select(F.col("id").alias("entity_id"), "doc_id"), "entity_id").groupBy("doc_id").agg(F.count("*").alias("roles"))
    return statistics.where("doc_id is not null").select("doc_id", "input_entities", "reconciled_entities").join(roles, "doc_id", "left").select("doc_id", "input_entities", "reconciled_entities", F.coalesce("roles", F.lit(0)).alias("roles"))


def processed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a graph as a run leaves them, numbered from an offset, and read again."""
    path = _path(spark, "run")
    raw = table(spark, sf_dir, "gsw_raw").select("chunk_id", F.col("payload").alias("gsw"), F.substring_index("chunk_id", "_", 1).try_cast("bigint").alias("doc_id"), F.substring_index("chunk_id", "_", -1).try_cast("int").alias("chunk_idx"))
    meta = sinks.write_chunks(raw.where("doc_id is not null"), path, 1_000)
    rows = spark.read.parquet(f"{path}/chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("chunk_idx").alias("first"), F.max("chunk_idx").alias("last"))
    total = meta.select(F.lit(-1).cast("bigint").alias("doc_id"), F.col("chunks_with_graph").alias("chunks"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return rows.unionByName(total)


def recovered_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the first delivery, and those that only came later, merged back; documents in both keep their first run."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "doc_idx", "chunk_idx", "arrived_at")
    half = F.month("arrived_at") <= 6
    kept, recovered = c.where(half), c.where(~half)
    out = sinks.merge_recovered(kept.select("chunk_id", "doc_idx", "chunk_idx"), recovered.select("chunk_id", "doc_idx", "chunk_idx"), "doc_idx")
    return out.groupBy("doc_idx").agg(F.count("*").alias("chunks"))


QUERIES = {f.__name__: f for f in (corpus_read, question_set_read, memory_read, processed_read, recovered_merged)}

ORACLES = {
    "corpus_read": "SELECT title, md5(text) AS text_md5, length(concat_ws(' ', title, text))::BIGINT AS chars, count(*) AS numbers FROM documents WHERE title IS NOT NULL OR text IS NOT NULL GROUP BY 1, 2, 3",
    "question_set_read": "SELECT question_row, text AS question, array_to_string(answers[1:2], '|') AS golds, len(answers[1:2])::BIGINT AS n_golds, true AS answerable FROM (SELECT question_row, text, coalesce(list_filter(answers, lambda a: a IS NOT NULL), []) AS answers FROM questions WHERE text IS NOT NULL)",
    "memory_read": LOCAL_SQL + ", n AS (SELECT doc_id, count(*) AS roles FROM rol JOIN ent ON ent.id = entity_id GROUP BY doc_id) SELECT doc_id, count(*) AS input_entities, count(*) FILTER (id = canonical_id) AS reconciled_entities, coalesce(any_value(n.roles), 0) AS roles FROM can JOIN ent USING (id) LEFT JOIN n USING (doc_id) WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "processed_read": "WITH g AS (SELECT payload, TRY_CAST(split_part(chunk_id, '_', 1) AS BIGINT) + 1000 AS doc_id, TRY_CAST(split_part(chunk_id, '_', -1) AS BIGINT) AS c FROM gsw_raw) SELECT doc_id, count(*) AS chunks, min(c) AS \"first\", max(c) AS \"last\" FROM g WHERE payload IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id UNION ALL SELECT -1, count(payload), NULL, NULL FROM g WHERE doc_id IS NOT NULL",
    "recovered_merged": "WITH c AS (SELECT doc_idx, month(arrived_at AT TIME ZONE 'UTC') <= 6 AS early FROM chunks) SELECT doc_idx, count(*) AS chunks FROM c WHERE early OR doc_idx NOT IN (SELECT doc_idx FROM c WHERE early) GROUP BY doc_idx",
}
