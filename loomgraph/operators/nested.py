"""Deeply nested graph payloads into related flat tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Where nodes repeat: list field -> (letter of its paths, list fields below it, field that holds a bare string).
LEVELS = {
    "entity_nodes": ("e", ("roles",), "name"),
    "roles": ("r", ("states",), "role"),
    "states": ("s", (), "value"),
    "verb_phrase_nodes": ("v", ("questions",), "phrase"),
    "questions": ("q", ("answers",), "text"),
    "answers": ("a", (), "value"),
}
ROOTS = ("entity_nodes", "verb_phrase_nodes")
#: Flat tables: name -> (repeated ancestor, fields).
TABLES = {
    "entities": ("entity_nodes", ("id", "name", "chunk_id", "summary")),
    "roles": ("entity_nodes.roles", ("role", "chunk_id")),
    "states": ("entity_nodes.roles.states", ("value",)),
    "verb_phrases": ("verb_phrase_nodes", ("id", "phrase", "chunk_id")),
    "questions": ("verb_phrase_nodes.questions", ("id", "text", "chunk_id")),
    "answers": ("verb_phrase_nodes.questions.answers", ("value",)),
}
TRIPLES = "ancestor string, parent_path string, path string, ordinal int, field string, value string"
_FIELDS = {ancestor: frozenset(fields) for ancestor, fields in TABLES.values()}

#: One JSON token: punctuation, string, number or literal, anything else.
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:([{}\[\]:,])|"([^"\\]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\]*+)*+)"'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN|-?Infinity)|(\S)|)"
)
_PUNCTUATION, _STRING, _ATOM = 1, 2, 3
_FENCE, _OPEN = re.compile(r"```\w*\s(.*?)```", re.S), re.compile(r"[{\[]")
#: What a text that is cut off ends with: a string without its end, a number or literal.
_LEFT_OPEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+\\?\Z|[-+.\w]*+\s*\Z', re.S)
#: What may come next.
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _NEXT = range(6)
#: What an open container is: of no interest, outside the structure, the structure, a list of nodes, a node.
_SKIPPED, _OUTSIDE, _STRUCTURE, _LIST, _NODE = range(5)
_SKIPPED_OBJECT, _SKIPPED_LIST, _OUTSIDE_LIST = ("}", _SKIPPED), ("]", _SKIPPED), ("]", _OUTSIDE)


class _Broken(Exception):
    """Not JSON from here on: where to look for the next value; ``None`` if the text is cut off."""


def _string(text: str, m: re.Match) -> str:
    raw = m[_STRING]
    if "\\" not in raw:
        return raw
    value = scanstring(text, m.start(_STRING), False)[0]
    # A half of a surrogate pair is no character.
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in raw else value


def _scan(text: str, pos: int, found: list) -> int:
    """Read the JSON value at ``pos`` token by token and return where it ends.

    ``found`` gets (position, triples) of every structure that is complete, and (position, text) of
    strings that may hold one.  Open containers are on a stack of our own, so depth costs nothing but room, and
    every token is read once.
    """
    match = _TOKEN.match
    stack: list = []
    out: list = []  # triples of the structure being read
    inside = False
    expect, last_string = _VALUE, pos

    def broken(at: int) -> _Broken:
        if _LEFT_OPEN.match(text, at):
            return _Broken(None)
        # A quotation mark outside JSON may have swallowed a bracket.
        return _Broken(last_string + 1 if last_string > pos_0 and _OPEN.search(text, last_string, at) else max(at, pos_0 + 1))

    pos_0 = pos
    while True:
        m = match(text, pos)
        pos, kind = m.end(), m.lastindex
        mark = m[_PUNCTUATION] if kind == _PUNCTUATION else ""
        if expect == _NEXT:
            top = stack[-1]
            if mark == ",":
                expect = _KEY if top[0] == "}" else _VALUE
                if top[1] == _LIST:
                    top[6] += 1
                continue
            if mark != top[0]:
                raise broken(m.start(kind) if kind else pos)
        elif expect == _COLON:
            if mark != ":":
                raise broken(m.start(kind) if kind else pos)
            expect = _VALUE
            continue
        elif expect == _KEY or expect == _KEY_OR_END:
            if kind == _STRING:
                last_string = m.start(_STRING) - 1
                expect, top = _COLON, stack[-1]
                role = top[1]
                if role != _SKIPPED:
                    key = _string(text, m)
                    top[2] = key
                    if role == _OUTSIDE:
                        if key in ROOTS:
                            top[1], top[3], inside, out = _STRUCTURE, {}, True, []
                        elif top[3] and key in top[3]:
                            a, b = top[3].pop(key)
                            found[a:b] = [None] * (b - a)
                        else:
                            top[5] = len(found)
                    elif key in top[3]:  # said again: what was said first goes
                        a, b = top[3].pop(key)
                        out[a:b] = [None] * (b - a)
                    if top[1] in (_STRUCTURE, _NODE):
                        top[5] = len(out)
                continue
            if expect == _KEY or mark != "}":
                raise broken(m.start(kind) if kind else pos)
        elif not (expect == _VALUE_OR_END and mark == "]"):
            # A value begins.
            if kind not in (_PUNCTUATION, _STRING, _ATOM) or mark and mark not in "{[":
                raise broken(m.start(kind) if kind else pos)
            if kind == _STRING:
                last_string = m.start(_STRING) - 1
            top = stack[-1] if stack else _OUTSIDE_LIST
            role = top[1]
            item = None  # (field, ancestor, parent, prefix, ordinal)
            if role == _LIST:
                item = top[2:7]
            elif role == _STRUCTURE:
                if top[2] in ROOTS:
                    item = (top[2], top[2], "root", "", 0)
            elif role == _NODE and top[2] in top[4][5]:
                item = (top[2], f"{top[4][0]}.{top[2]}", top[4][2], top[4][2] + ".", 0)
            if mark == "[" and item is not None and role != _LIST:
                stack.append(["]", _LIST, *item])
                expect = _VALUE_OR_END
                continue
            if item is not None:
                if not (kind == _ATOM and m[_ATOM] == "null"):
                    field, ancestor, parent, prefix, i = item
                    letter, below, bare = LEVELS[field]
                    path = f"{prefix}{letter}{i}"
                    if mark == "{" and bare != "value":
                        out.append((ancestor, parent, path, i, None, None))
                        stack.append(["}", _NODE, None, {}, (ancestor, parent, path, i, _FIELDS[ancestor], below), 0])
                        expect = _KEY_OR_END
                        continue
                    if mark:
                        stack.append((*(_SKIPPED_OBJECT if mark == "{" else _SKIPPED_LIST), (ancestor, parent, path, i, bare, pos - 1)))
                        expect = _KEY_OR_END if mark == "{" else _VALUE_OR_END
                        continue
                    out.append((ancestor, parent, path, i, bare, _string(text, m) if kind == _STRING else m[_ATOM]))
            elif role == _NODE and top[2] in top[4][4]:
                if mark:
                    stack.append((*(_SKIPPED_OBJECT if mark == "{" else _SKIPPED_LIST), (*top[4][:4], top[2], pos - 1)))
                    expect = _KEY_OR_END if mark == "{" else _VALUE_OR_END
                    continue
                if kind == _STRING:
                    out.append((*top[4][:4], top[2], _string(text, m)))
                elif m[_ATOM] != "null":
                    out.append((*top[4][:4], top[2], m[_ATOM]))
            elif mark:
                if inside:
                    stack.append(_SKIPPED_OBJECT if mark == "{" else _SKIPPED_LIST)
                else:
                    stack.append(["}", _OUTSIDE, None, {}, pos - 1, 0] if mark == "{" else _OUTSIDE_LIST)
                expect = _KEY_OR_END if mark == "{" else _VALUE_OR_END
                continue
            elif not inside and kind == _STRING and any(r in m[_STRING] for r in ROOTS):
                found.append((last_string, _string(text, m)))
            if not stack:
                return pos
            expect = _NEXT
            if top[1] != _SKIPPED and top[0] == "}":
                _remember(top, found if top[1] == _OUTSIDE else out)
            continue
        # A container ends.
        top = stack.pop()
        if top[1] == _SKIPPED:
            if len(top) > 2:
                *node, field, start = top[2]
                out.append((*node, field, text[start:pos]))
        elif top[1] == _STRUCTURE:
            found.append((top[4], [t for t in out if t is not None]))
            inside = False
        if not stack:
            return pos
        top, expect = stack[-1], _NEXT
        if top[1] != _SKIPPED and top[0] == "}":
            _remember(top, found if top[1] == _OUTSIDE else out)


def _remember(top: list, made: list) -> None:
    """Which rows the value of an object's key made, in case the key is said again."""
    if len(made) > top[5] or top[1] == _NODE and top[2] in top[4][5]:
        top[3][top[2]] = (top[5], len(made))


def _first(found: list) -> list[tuple] | None:
    """The structure that begins first, with those in strings read as texts of their own."""
    for _, x in sorted((f for f in found if f is not None), key=lambda f: f[0]):
        got = x if isinstance(x, list) else find_structure(x)
        if got is not None:
            return got
    return None


def _whole(text: str) -> list | None:
    """What is found in a text that is one JSON value; None if it is none."""
    found: list = []
    try:
        end = _scan(text, 0, found)
    except _Broken:
        return None
    return None if text[end:].strip(" \t\r\n") else found


def find_structure(text: str | None) -> list[tuple] | None:
    """The triples of the object that holds nodes, wherever it sits; None if there is none.

    The text is one JSON value, or has such values in fences, or standing free in it; the object may sit in
    objects, lists or JSON text in a string.  A triple is (repeated ancestor, parent path, node path, ordinal, field,
    value), a node without fields one with nulls for field and value.  Values that are no strings are the JSON text as delivered.
    """
    text = text.strip("﻿ \t\r\n") if text else ""
    if not text:
        return None
    if (found := _whole(text)) is not None:
        return _first(found)
    fenced = [x for body in _FENCE.findall(text) if (x := _whole(body.strip())) is not None]
    if fenced:
        return next((x for x in map(_first, fenced) if x is not None), None)
    found, at = [], 0
    while (m := _OPEN.search(text, at)) is not None:
        here: list = []
        try:
            at = _scan(text, m.start(), here)
        except _Broken as e:
            at = e.args[0]
            if at is None:
                break
        found += here
    return _first(found)


def parse_triples(df: DataFrame, id_col: str, payload: str, tables: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """Payloads as path-value-ordinal triples of the tables' ancestors, read token by token, one record at a time, within Arrow batches.

    Null, empty, cut-off and other unreadable payloads give no rows; of a repeated key in an
    object the last one counts.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *TRIPLES.replace(",", "").split()[::2]]
    wanted = {TABLES[t][0] for t in tables}
    every = len(wanted) == len(TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if got := find_structure(text):
                        got = got if every else [t for t in got if t[0] in wanted]
                        rows += got
                        at += [i] * len(got)
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.int32() if n == "ordinal" else pa.string()) for n, c in zip(names[1:], columns))], names=names
                    )

    return df.select(F.col(id_col), F.col(payload)).where(F.length(F.trim(payload)) > 1).mapInArrow(run, f"`{id_col}` {kind}, {TRIPLES}")


def pivot_nodes(triples: DataFrame, id_col: str, name: str) -> DataFrame:
    """The triples of one repeated ancestor as its table: one row per node, its fields as columns; ids must be unique among the payloads."""
    ancestor, fields = TABLES[name]
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"f_{f}")
    nodes = triples.where(F.col("ancestor") == ancestor).groupBy(id_col, "parent_path", "path", "ordinal").agg(*map(value, fields))
    return nodes.select(id_col, "parent_path", "path", "ordinal", *(F.col(f"f_{f}").alias(f) for f in fields))


def flatten_records(df: DataFrame, id_col: str = "gsw_id", payload: str = "payload", tables: tuple[str, ...] = tuple(TABLES)) -> dict[str, DataFrame]:
    """Nested payloads as related tables, each row naming its parent.

    Tables: entities, roles, states, verb_phrases, questions, answers, or those named, with (id_col, parent_path,
    path, ordinal, fields); (id_col, parent_path) is the (id_col, path) of the parent, or ``root``.
    Ordinals count in the delivered list, null items included; null items are no nodes; a single
    object or string stands for a list of one; empty and absent lists have no nodes.  Extra fields
    and extra columns of ``df`` are ignored.  A field that is no string is the JSON text as delivered.

    Every record is parsed once; where several tables are wanted, the triples are stored by repeated ancestor, and
    each table is the pivot of its own.
    """
    triples = parse_triples(df, id_col, payload, tables)
    if len(tables) > 1:
        triples = Scratch(df.sparkSession, "nested").cut(triples, "triples", "ancestor")
    return {name: pivot_nodes(triples, id_col, name) for name in tables}
