"""Registered queries of the general data problems: nested records (2) and orphan references (3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_reference
from ..operators.nested import LEVELS, TABLES, flatten_records
from ..operators.references import orphan_references, parent_keys
from ..session import Scratch, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all six tables, which are written whole first, as one who wants them does."""
    scratch = Scratch(spark, "tables")
    stored = [scratch.cut(t, name) for name, t in flatten_records(table(spark, sf_dir, "gsw_raw")).items()]
    return reduce(DataFrame.unionByName, (t.select("gsw_id", "parent_path", "path") for t in stored))


def _p2_table(name: str):
    return lambda spark, sf_dir: flatten_records(table(spark, sf_dir, "gsw_raw"), tables=(name,))[name]


def _misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of questions: target ``chunk_id`` (chunks) and ``answers`` (entity_nodes)."""
    q = table(spark, sf_dir, "questions").select("question_row", "answers", "chunk_id", F.unix_micros("recorded_at").alias("ref_at"))
    answer = clean_reference(F.col("answer"))
    refs = q.select(F.lit("chunk_id").alias("target"), F.col("chunk_id").alias("key"), F.col("question_row").alias("ref_id"), "ref_at").unionByName(
        q.select("question_row", "ref_at", F.explode(F.array_distinct("answers")).alias("answer"))
        .select(F.lit("answers").alias("target"), answer.alias("key"), F.col("question_row").alias("ref_id"), "ref_at")
        .where(~F.col("key").isin("", "none", "na") & ~F.col("key").startswith("text:"))
    )
    parents = parent_keys(table(spark, sf_dir, "chunks"), "chunk_id", "chunk_id", "arrived_at", "deleted_at").unionByName(
        parent_keys(table(spark, sf_dir, "entity_nodes"), "answers", "id", "arrived_at", "deleted_at")
    )
    return orphan_references(refs, parents).select(
        F.col("ref_id").alias("question_row"), F.col("target").alias("ref_field"), "ref_key", "reason", F.date_format(F.timestamp_micros("ref_at"), "yyyy-MM").alias("period")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misses(spark, sf_dir)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referenced table and month."""
    by = F.when(F.col("ref_field") == "chunk_id", "chunks").otherwise("entity_nodes").alias("target_table")
    return _misses(spark, sf_dir).groupBy(by, "period").agg(
        F.count("*").alias("orphans"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "late", "deleted"))
    )


QUERIES = {"p2_found": p2_found, **{f"p2_{t}": _p2_table(t) for t in TABLES}, "p3_found": p3_found, "p3_report": p3_report}

_MISSES_SQL = r"""
WITH refs AS (
  SELECT question_row, 'chunk_id' AS ref_field, chunk_id AS ref_key, recorded_at FROM questions WHERE chunk_id IS NOT NULL
  UNION ALL
  SELECT question_row, 'answers', k, recorded_at FROM (
    SELECT question_row, recorded_at, lower(regexp_replace(a, '^[\pZ\s\x{85}\x1c-\x1f]+|[\pZ\s\x{85}\x1c-\x1f]+$', '', 'g')) AS k
    FROM (SELECT question_row, recorded_at, unnest(list_distinct(answers)) AS a FROM questions))
  WHERE k NOT IN ('', 'none', 'na') AND NOT starts_with(k, 'text:')),
parents AS (
  SELECT 'chunk_id' AS ref_field, chunk_id AS ref_key, min(arrived_at) AS arrived, min(deleted_at) AS deleted FROM chunks GROUP BY chunk_id
  UNION ALL
  SELECT 'answers', id, min(arrived_at), min(deleted_at) FROM entity_nodes GROUP BY id),
misses AS (
  SELECT r.question_row, r.ref_field, r.ref_key,
    CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN p.arrived > r.recorded_at THEN 'late' WHEN p.deleted <= r.recorded_at THEN 'deleted' END AS reason,
    strftime(r.recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period
  FROM refs r LEFT JOIN parents p USING (ref_field, ref_key))
"""
#: The structure of each payload, and each level's items with their paths; ``item`` and lists are JSON.
_NODES_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT gsw_id, regexp_replace(payload, '^[\x{feff}\s]+|[\x{feff}\s]+$', '', 'g') AS t FROM gsw_raw),
whole AS (
  SELECT gsw_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(f) THEN f END AS t
  FROM (SELECT gsw_id, t, regexp_extract(t, '(?s)```\w*\s(.*?)```', 1) AS f FROM texts)),
seen AS (
  SELECT gsw_id, t::JSON AS j FROM whole WHERE t <> ''
  UNION ALL
  SELECT gsw_id, CASE WHEN k.type = 'VARCHAR' THEN (k.value ->> '$')::JSON ELSE k.value END
  FROM (SELECT gsw_id, j, unnest(CASE json_type(j)
      WHEN 'ARRAY' THEN [{'type': json_type(x), 'value': x} for x in json_extract(j, '$[*]')]
      WHEN 'OBJECT' THEN [{'type': json_type(x), 'value': x} for x in json_extract(j, '$.*')]
      WHEN 'VARCHAR' THEN [{'type': 'VARCHAR', 'value': j}] END) AS k
    FROM seen WHERE NOT coalesce(json_exists(j, '$.entity_nodes') OR json_exists(j, '$.verb_phrase_nodes'), false))
  WHERE k.type IN ('ARRAY', 'OBJECT') OR k.type = 'VARCHAR' AND contains(k.value ->> '$', '_nodes') AND json_valid(k.value ->> '$')),
structure AS (SELECT gsw_id, j FROM seen WHERE json_exists(j, '$.entity_nodes') OR json_exists(j, '$.verb_phrase_nodes')),
"""


def _level(name: str, above: str, letter: str, field: str, prefix: str) -> str:
    """The nodes of one level: delivered lists, or one value where a list belongs; nulls count and are no nodes."""
    parent = "'root'" if above == "structure" else "path"
    listed = f"CASE json_type(json_extract(j, '$.{field}')) WHEN 'ARRAY' THEN json_extract(j, '$.{field}[*]') WHEN 'NULL' THEN [] ELSE [json_extract(j, '$.{field}')] END"
    return f"""{name} AS (
  SELECT gsw_id, parent_path, {prefix} || '{letter}' || i AS path, i AS ordinal, j
  FROM (SELECT gsw_id, {parent} AS parent_path, unnest(l) AS j, unnest(range(len(l))) AS i FROM (SELECT *, {listed} AS l FROM {above} WHERE json_exists(j, '$.{field}')))
  WHERE json_type(j) <> 'NULL')"""


_NODES_SQL += ", ".join(_level(*x) for x in (
    ("entities", "structure", "e", "entity_nodes", "''"), ("roles", "entities", "r", "roles", "parent_path || '.'"), ("states", "roles", "s", "states", "parent_path || '.'"),
    ("verb_phrases", "structure", "v", "verb_phrase_nodes", "''"), ("questions", "verb_phrases", "q", "questions", "parent_path || '.'"), ("answers", "questions", "a", "answers", "parent_path || '.'"),
))


def _cells(name: str) -> str:
    """A table's fields; a bare value stands for the field named by its level."""
    ancestor, fields = TABLES[name]
    bare = LEVELS[ancestor.rpartition(".")[2]][2]
    cell = lambda f: f"CASE WHEN json_type(j) = 'OBJECT' AND '{f}' <> 'value' THEN j ->> '$.{f}' {f"ELSE j ->> '$'" if f == bare else ''} END AS {f}"
    return f"{_NODES_SQL} SELECT gsw_id, parent_path, path, ordinal::INTEGER AS ordinal, {', '.join(map(cell, fields))} FROM {name}"


ORACLES = {
    "p2_found": _NODES_SQL + " UNION ALL ".join(f" SELECT gsw_id, parent_path, path FROM {t}" for t in TABLES),
    **{f"p2_{t}": _cells(t) for t in TABLES},
    "p3_found": _MISSES_SQL + "SELECT * FROM misses WHERE reason IS NOT NULL",
    "p3_report": _MISSES_SQL + """
SELECT CASE WHEN ref_field = 'chunk_id' THEN 'chunks' ELSE 'entity_nodes' END AS target_table, period, count(*) AS orphans,
  count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'late') AS late, count(*) FILTER (reason = 'deleted') AS deleted
FROM misses WHERE reason IS NOT NULL GROUP BY ALL""",
}
