"""Writers: processed chunks, reconciled graphs, results, caches, exports, recovered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.memory import Memory


def write_chunks(chunks: DataFrame, path: str, doc_offset: int = 0) -> DataFrame:
    """Chunks with a graph, in the order of their documents, and a one-row metadata table, which is returned.

    Documents are kept together by ranges: a folder for each would be as many folders as documents, and the files' statistics
    find a document as well.

    ``chunks``: doc_id, chunk_idx and more; rows without a graph in ``gsw`` are counted, not written.
    """
    rows = chunks.withColumn("doc_id", F.col("doc_id") + doc_offset)
    rows.where("gsw is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "chunk_idx").write.mode("overwrite").parquet(f"{path}/chunks")
    meta = rows.agg(F.count_distinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"), F.count("gsw").alias("chunks_with_graph"))
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return meta


def write_memory(memory: Memory, statistics: DataFrame, path: str) -> None:
    """A reconciled memory, one table each, with its statistics."""
    for name in ("entities", "roles", "verb_phrases", "questions", "answers"):
        getattr(memory, name).write.mode("overwrite").parquet(f"{path}/{name}")
    statistics.write.mode("overwrite").json(f"{path}/statistics")


def preview(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def write_results(results: DataFrame, path: str, text: str | None = None) -> None:
    """One JSON object per question; a text column is cut to a preview."""
    out = results if text is None else results.withColumn(text, preview(F.col(text)))
    out.write.mode("overwrite").json(path)


def uncached(rows: DataFrame, text: str, cache: DataFrame | None) -> DataFrame:
    """Texts whose content (md5) no cache row has: key, text, each once.  ``cache``: key and whatever is cached."""
    keyed = rows.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node_id, node_type, label) and edges (source, target, q_id) as elements of a graph view, one JSON text each."""
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("node_id").alias("id"), F.col("label"), F.col("node_type").alias("type")).alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct("source", "target", F.col("q_id").alias("label")).alias("data"))).alias("element"))
    return n.unionByName(e)


def merge_recovered(kept: DataFrame, recovered: DataFrame, id_col: str) -> DataFrame:
    """Rows of a run with recovered ones in place of what is missing; a document in both keeps its first run."""
    have = kept.select(id_col).distinct()
    return kept.unionByName(recovered.join(have, id_col, "left_anti"), allowMissingColumns=True)
