"""Texts into chunks, model output into graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exploded, strip


def sentences(text: Column) -> Column:
    """Parts between ``.``, ``!`` and ``?``, stripped; blank ones go."""
    return F.filter(F.transform(F.split(F.translate(text, "!?", ".."), r"\."), lambda s: strip(s)), lambda s: s != "")


def chunk_sentences(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """Sliding windows of ``size`` sentences, ``overlap`` shared with the next.

    Windows start at every step below the number of sentences, so the last may lie within
    the one before; sentence ranges are half open.  Texts without a sentence, and null texts, give
    no chunk.  ``size`` must exceed ``overlap``.
    """
    if size <= overlap or overlap < 0:
        raise ValueError(f"windows of {size} sentences cannot overlap by {overlap}")
    step = size - overlap
    parts = df.select(id_col, sentences(F.col(text)).alias("s"))
    starts = exploded(parts, [id_col, "s"], F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1, F.lit(step))), "start_sentence", "chunk_idx")
    end = F.least(F.col("start_sentence") + size, F.size("s"))
    return starts.select(
        id_col, "chunk_idx", "start_sentence", end.alias("end_sentence"), F.concat(F.array_join(F.slice("s", F.col("start_sentence") + 1, size), ". "), F.lit(".")).alias("chunk_text")
    )


def whole_chunks(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One chunk per text, for runs without chunking."""
    zero = F.lit(0)
    return df.select(id_col, zero.alias("chunk_idx"), zero.alias("start_sentence"), zero.alias("end_sentence"), F.col(text).alias("chunk_text"))


def with_title(title: Column, text: Column) -> Column:
    return F.when(title.isNotNull(), F.concat(title, F.lit("\n"), text)).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one: what budgets use without a tokenizer."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


#: What a model is expected to return for a chunk.
GRAPH = (
    "entity_nodes array<struct<id:string,name:string,roles:array<struct<role:string,states:array<string>,chunk_id:string>>,chunk_id:string,summary:string>>,"
    " verb_phrase_nodes array<struct<id:string,phrase:string,questions:array<struct<id:string,text:string,answers:array<string>,chunk_id:string>>,chunk_id:string>>, broken string"
)


def json_of_output(raw: Column) -> Column:
    """The JSON text in a model's answer: a json fence, any fence, what precedes the closing tag, else up to the last brace."""
    fence = F.regexp_extract(raw, r"(?s)```json\s*(.*?)```", 1)
    other = F.regexp_extract(raw, r"(?s)```\w*\s*(.*?)```", 1)
    tag = F.substring_index(raw, "</semantic_construction>", 1)
    return F.when(fence != "", fence).when(other != "", other).when(raw.contains("</semantic_construction>"), tag).otherwise(F.regexp_extract(raw, r"(?s)^(.*\})", 1))


def parse_output(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id_col, graph, error): the graph a model's answer holds, parsed permissively.

    ``error``: ``empty``, ``unreadable`` or ``incomplete`` (a node without id, or without name or phrase); then
    ``graph`` is null.  Packings beyond the fences are left to the nested-record operator.
    """
    graph = F.from_json(json_of_output(F.col(raw)), GRAPH, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
    lost = F.exists(F.coalesce("g.entity_nodes", F.array()), lambda e: e["id"].isNull() | e["name"].isNull()) | F.exists(F.coalesce("g.verb_phrase_nodes", F.array()), lambda v: v["id"].isNull() | v["phrase"].isNull())
    nothing = F.col("g.entity_nodes").isNull() & F.col("g.verb_phrase_nodes").isNull()
    error = F.when(F.coalesce(F.length(F.trim(raw)), F.lit(0)) == 0, "empty").when(F.col("g").isNull() | F.col("g.broken").isNotNull() | nothing, "unreadable").when(lost, "incomplete")
    out = df.select(id_col, raw, graph.alias("g")).select(id_col, F.col("g").dropFields("broken").alias("graph"), error.alias("error"))
    return out.select(id_col, F.when(F.col("error").isNull(), F.col("graph")).alias("graph"), "error")
