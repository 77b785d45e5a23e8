"""Model calls as pluggable functions, and rule-based stand-ins that need no network.

A model is a function from a list of inputs (dicts) to a list of outputs (dicts) of the same length, made
once per worker by a factory.  Stand-ins are column expressions, so that they run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import exploded, strip, word_tokens

Model = Callable[[list[dict]], list[dict]]


def call_model(df: DataFrame, make: Callable[[], Model], output: str, batch: int = 64) -> DataFrame:
    """The rows of ``df`` with a model's output columns and ``error``: a failed batch is tried row by row, a failed row has nulls and the error's text."""
    kind = StructType.fromDDL(output + ", error string")
    schema = StructType([*df.schema.fields, *kind.fields])
    arrow = to_arrow_schema(schema)
    empty = {f.name: None for f in kind.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def one(row: dict) -> dict:
            try:
                return row | empty | model([row])[0]
            except Exception as e:  # noqa: BLE001
                return row | empty | {"error": f"{type(e).__name__}: {e}"}

        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                rows = whole.slice(lo, batch).to_pylist()
                try:
                    got = model(rows)
                    if len(got) != len(rows):
                        raise ValueError("a model must answer every row")
                    out = [r | empty | g for r, g in zip(rows, got)]
                except Exception:  # noqa: BLE001
                    out = [one(r) for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def capitalised(text: Column) -> Column:
    """Stand-in for entity extraction: distinct runs of two or more capitalised words, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}-]+(?: \p{Lu}[\p{L}-]+)+)"), 1))


def temporal(text: Column) -> Column:
    """Stand-in for temporal tags: years."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), 1))


def hashed_vector(text: Column, width: int = 64) -> Column:
    """Stand-in for an embedder: how often words fall into each of ``width`` (at most 256) buckets, by the first byte of their MD5; null for null, zeros without words."""

    @F.arrow_udf("array<double>")
    def count(lists: pa.Array) -> pa.Array:
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        said = lists.flatten().dictionary_encode()
        buckets = np.array([md5(w.encode()).digest()[0] % width for w in said.dictionary.to_pylist()], np.int64)
        at = np.repeat(np.arange(len(lists)), sizes) * width + (buckets[said.indices.to_numpy()] if len(said) else np.zeros(0, np.int64))
        values = np.bincount(at, minlength=len(lists) * width).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * width, pa.int32()), pa.array(values), mask=lists.is_null())

    return count(word_tokens(text))


def extract_mentions(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, pos, name): the stand-in's entities of each text."""
    return exploded(df, [id_col], capitalised(F.col(text)), "name", "pos")


def space_time(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (chunk_id, tag_type, tag_value) and edges (chunk_id, entity, tag_value) of chunks (chunk_id, text):
    one node per tag, one edge per entity of the chunk and tag; four-digit numbers are years."""
    tags = chunks.select("chunk_id", "text", F.explode(F.filter(temporal(F.col("text")), lambda y: F.length(y) == 4)).alias("tag_value")).distinct()
    nodes = tags.select("chunk_id", F.lit("temporal").alias("tag_type"), "tag_value").distinct()
    edges = tags.select("chunk_id", F.explode(capitalised(F.col("text"))).alias("entity"), "tag_value").distinct()
    return nodes, edges


def split_mentions(reply: Column) -> Column:
    """Mentions a model returned, separated by bars; blank ones go."""
    parts = F.transform(F.split(reply, r"\|"), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def read_reply(reply: Column, field: str = "answer") -> Column:
    """The answer in a model's JSON reply: fences aside, lists joined by commas, else the reply itself."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    body = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), bare)
    value = F.get_json_object(body, f"$.{field}")
    listed = F.from_json(value, "array<string>")
    return F.coalesce(F.when(value.startswith("["), F.array_join(listed, ", ")), value, reply)


def run_agent(plan: Callable[[list[dict]], dict], tools: dict[str, Callable[..., DataFrame]], most: int = 10, rows: int = 20) -> dict:
    """A tool-calling loop: ``plan`` sees the calls so far and names a tool with arguments, or an answer.

    Tools are queries; at most ``rows`` rows of a result go back to the plan.  An unknown tool is an error the plan sees.
    """
    calls: list[dict] = []
    for _ in range(most):
        step = plan(calls)
        if "answer" in step:
            return {"answer": step["answer"], "reasoning": step.get("reasoning", ""), "tool_calls_made": calls}
        tool = tools.get(step.get("tool", ""))
        if tool is None:
            result: object = {"error": f"unknown tool {step.get('tool')}"}
        else:
            result = [r.asDict(True) for r in tool(**step.get("arguments", {})).limit(rows).collect()]
        calls.append({"tool_name": step.get("tool"), "arguments": step.get("arguments", {}), "result": result})
    return {"answer": None, "reasoning": "no answer within the allowed calls", "tool_calls_made": calls}
