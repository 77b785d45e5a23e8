"""Reconciliation of entities and verb phrases across chunks and documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key
from .memory import delivered


def canonical_entities(entities: DataFrame, per_document: bool = False, empty_keys: bool = False) -> DataFrame:
    """(id, canonical_id) of exact-name reconciliation, in closed form.

    Within a scope (a document, or everything) and name key, the entities of the first chunk stay
    themselves and every later one becomes the first entity of that chunk.  Names whose key is empty
    are left alone unless ``empty_keys``; null names always are.  The first is found by an
    aggregate, combined before the shuffle, so a name may be as frequent as it likes.
    """
    rows = entities.select("id", "chunk_id", F.struct("doc_id", "chunk_idx", "pos", "chunk_id", "id").alias("place"), (F.col("doc_id") if per_document else F.lit(0)).alias("scope"), name_key("name").alias("key"))
    usable = F.col("key").isNotNull() if empty_keys else F.col("key") != ""
    first = rows.where(usable).groupBy("scope", "key").agg(F.min("place").alias("first"))
    joined = rows.join(first, ["scope", "key"], "left") if empty_keys else rows.join(first.where("key <> ''"), ["scope", "key"], "left")
    return joined.select("id", F.when(F.col("first").isNull() | (F.col("first.chunk_id") == F.col("chunk_id")), F.col("id")).otherwise(F.col("first.id")).alias("canonical_id"))


def entity_text(name: str = "name", roles: str = "roles") -> Column:
    """``Entity: … Role: … States: …`` as embedded for matching."""
    cell = lambda r: F.concat(F.lit("Role: "), F.coalesce(r["role"], F.lit("")), F.lit(" States: "), F.array_join(F.coalesce(r["states"], F.array()), ", "))
    return F.concat_ws(" ", F.concat(F.lit("Entity: "), F.coalesce(name, F.lit(""))), F.array_join(F.transform(F.coalesce(roles, F.array()), cell), " "))


def merged_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges (src, dst) between canonical entities, each once, without loops."""
    to = canonical.select("id", "canonical_id")
    out = edges.join(to.select(F.col("id").alias("src"), F.col("canonical_id").alias("a")), "src", "left").join(to.select(F.col("id").alias("dst"), F.col("canonical_id").alias("b")), "dst", "left")
    a, b = F.coalesce("a", "src"), F.coalesce("b", "dst")
    return out.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def open_questions(verb_phrases: DataFrame, questions: DataFrame, matched: DataFrame) -> DataFrame:
    """Unanswered questions of verb phrases in which a matched entity answers: what a resolver would be asked."""
    rows = questions.select(F.col("id").alias("q_id"), "vp_id", "text", F.explode("answers").alias("answer"))
    touched = rows.join(matched.select(F.col("canonical_id").alias("answer")).distinct(), "answer", "left_semi").select("vp_id").distinct()
    empty = questions.where(F.col("answers") == F.array(F.lit("None"))).select(F.col("id").alias("q_id"), "vp_id", "text")
    return empty.join(touched, "vp_id", "left_semi").join(verb_phrases.select(F.col("id").alias("vp_id"), "phrase"), "vp_id").select("vp_id", "q_id", "phrase", F.col("text").alias("question"))


def write_answers(questions: DataFrame, replies: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions (id, vp_id, text, answers, chunk_id) with the answers that a resolver found.

    ``replies``: q_id, entity_id, answer_text, chunk_id, one per question (of several, the smallest).  An entity of the memory is the
    answer; else the text is, as ``TEXT:...``, also beside an unknown entity; without both the answer stays open.  The question takes the reply's chunk if it
    has one.  Replies to unknown questions change nothing.  Only questions with a reply meet the entities.
    """
    one = replies.where("q_id is not null").groupBy("q_id").agg(F.min(F.struct("entity_id", "answer_text", "chunk_id")).alias("r")).select(F.col("q_id").alias("id"), F.nullif("r.entity_id", F.lit("")).alias("entity_id"), F.nullif("r.answer_text", F.lit("")).alias("said"), F.nullif("r.chunk_id", F.lit("")).alias("new_chunk"))
    known = entities.select(F.col("id").alias("entity_id"), F.lit(True).alias("known")).distinct()
    one = one.join(known, "entity_id", "left")
    answer = F.when(F.col("known"), F.col("entity_id")).when(F.col("entity_id").isNotNull() | F.col("said").isNotNull(), F.concat(F.lit("TEXT:"), F.coalesce("said", F.lit("None")))).otherwise("None")
    out = questions.join(one.select("id", F.array(answer).alias("found"), "new_chunk"), "id", "left")
    return out.select("id", "vp_id", "text", F.coalesce("found", "answers").alias("answers"), F.coalesce("new_chunk", "chunk_id").alias("chunk_id"))


def context_merges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source_id, target_id) of space or time nodes that merge because their entities do.

    ``edges``: entity_id, node_id, place.  Of each entity its last edge counts; the node of a merged entity goes into the node of
    the entity it became, and a node of several merged entities into that of the last of them, as edges come.
    """
    last = edges.groupBy("entity_id").agg(F.max(F.struct("place", "node_id")).alias("x")).select("entity_id", "x.place", "x.node_id")
    moved = canonical.where("id <> canonical_id").select(F.col("id").alias("entity_id"), "canonical_id")
    pairs = moved.join(last.select("entity_id", "place", F.col("node_id").alias("source_id")), "entity_id")
    pairs = pairs.join(last.select(F.col("entity_id").alias("canonical_id"), F.col("node_id").alias("target_id")), "canonical_id")
    return pairs.groupBy("source_id").agg(F.max(F.struct("place", "entity_id", "target_id")).alias("x")).select("source_id", "x.target_id").where("source_id <> target_id")


def pair_descriptions(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, pair, new_id, old_id, description) of candidate pairs as a verifier is asked about them.

    ``pairs``: new_id, old_id, rank.  Pairs of one chunk of new entities are one request and are counted from 0 in the order of
    the new entities and ranks; pairs within a chunk are none.
    """
    text = entities.select("id", "chunk_id", entity_text().alias("t"), F.struct("doc_id", "chunk_idx", "pos", "id").alias("place"))
    new = text.select(F.col("id").alias("new_id"), "chunk_id", F.col("t").alias("new_text"), "place")
    old = text.select(F.col("id").alias("old_id"), F.col("chunk_id").alias("old_chunk"), F.col("t").alias("old_text"))
    rows = pairs.join(new, "new_id").join(old, "old_id").where(~F.col("chunk_id").eqNullSafe(F.col("old_chunk")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("place", "rank", "old_id")) - 1)
    pair = F.concat(F.lit("pair_"), "n")
    line = F.concat(pair, F.lit(": New entity '"), "new_text", F.lit("' and old entity '"), "old_text", F.lit("'"))
    return rows.select("chunk_id", pair.alias("pair"), "new_id", "old_id", line.alias("description"))


def verified_pairs(described: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(new_id, old_id) of described pairs with a verdict (chunk_id, pair, verdict) of true; a missing or null verdict is false."""
    said = verdicts.groupBy("chunk_id", "pair").agg(F.bool_and(F.coalesce("verdict", F.lit(False))).alias("yes"))
    return described.join(said.where("yes"), ["chunk_id", "pair"], "left_semi").select("new_id", "old_id")


OPEN = ["None"]


class _Kept:
    """A verb phrase of the memory: its questions in order, and which of them are open, by text."""

    def __init__(self, vp: str, place: int):
        self.vp, self.place, self.rows = vp, place, []
        self.texts: set = set()
        self.known: set = set()
        self.holes: dict = {}

    def add(self, q: list) -> None:
        self.rows.append(q)
        self.texts.add(q[1])
        self.known.add(_content(q))
        if q[2] == OPEN:
            self.holes.setdefault(q[1], deque()).append(q)


def _content(q: list) -> tuple:
    return q[1], tuple(sorted((a is not None, a or "") for a in q[2]))


def _keys(q: list) -> set:
    """What two questions share if they match: the first word and an answer."""
    first = (q[1] or "").split(None, 1)[:1]
    return {(first[0], a) for a in q[2] if a is not None and a != "None"} if first else set()


def fold_phrases(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Fold verb phrases of one wording, chunk by chunk, into the memory built so far.

    ``rows``: (chunk order, vp id, [[question id, text, answers, ...]]) in order.  Result: the memory's (vp id, question id, text, answers, ...),
    and (vp id, kept vp id) of merged phrases.  A phrase of a chunk goes into the first of the memory, as it was before the chunk, with
    which it shares the first word and an answer of a question.  Then its questions are taken over one by one: an answer fills the first open question of
    that text, which takes all but its id; an open question comes only with a new text; a question that is there is not repeated.

    Which phrases of the memory have a first word and an answer is remembered, so the fold takes time in
    proportion to the questions and answers, not to the pairs of phrases.
    """
    memory: dict[str, _Kept] = {}
    order: list[_Kept] = []
    # The first two phrases with a key: one of them may be the phrase itself, delivered again.
    holders: dict[tuple, list[int]] = {}
    merged: dict[str, str] = {}

    def note(q: list, place: int) -> None:
        for key in _keys(q):
            holders[key] = sorted({*holders.get(key, ()), place})[:2]

    chunks: dict = {}
    for chunk, vp, questions in rows:
        chunks.setdefault(chunk, []).append((vp, questions))
    for _, phrases in sorted(chunks.items()):
        matches = {}
        for vp, questions in phrases:
            places = {p for q in questions for key in _keys(q) for p in holders.get(key, ()) if order[p].vp != vp}
            if places:
                matches[vp] = order[min(places)]
        for vp, questions in phrases:
            if (old := matches.get(vp)) is None:
                continue
            merged[vp] = old.vp
            added, fresh = [], set()
            for q in questions:
                holes = old.holes.get(q[1])
                if q[1] in old.texts and q[2] == OPEN:
                    continue
                if holes:
                    hole = holes.popleft()
                    hole[2:] = q[2:]
                    old.known.add(_content(hole))
                    note(hole, old.place)
                elif _content(q) not in old.known and _content(q) not in fresh:
                    fresh.add(_content(q))
                    added.append(list(q))
            for q in added:
                old.add(q)
                note(q, old.place)
        for vp, questions in phrases:
            if vp not in matches and vp not in memory:
                memory[vp] = kept = _Kept(vp, len(order))
                order.append(kept)
                for q in questions:
                    kept.add(list(q))
                    note(q, kept.place)
    return [(x.vp, *q) for x in order for q in x.rows], list(merged.items())


def reconcile_verb_phrases(verb_phrases: DataFrame, questions: DataFrame) -> DataFrame:
    """Verb-phrase reconciliation within documents: (doc_id, vp_id, kept_id, q_id, text, answers, chunk_id).

    Phrases match only if equal, so each document's phrases of one wording fold on their own, chunk by
    chunk.  Groups are streamed from sorted partitions; one is bounded by a document.  Phrases of an unknown document merge with none.
    Rows with q_id null say which phrase was merged into which.
    """
    chunk = F.col("chunk_id") if "chunk_id" in questions.columns else F.lit(None).cast("string")
    asked = questions.groupBy("vp_id").agg(F.array_sort(F.collect_list(F.struct(delivered("id").alias("place"), "id", "text", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), chunk.alias("chunk_id")))).alias("qs"))
    alone = F.when(F.col("doc_id").isNull(), F.col("id")).alias("alone")
    rows = verb_phrases.where("phrase is not null").join(asked.withColumnRenamed("vp_id", "id"), "id", "left").select("doc_id", "phrase", alone, "chunk_idx", "pos", "id", "qs")

    names = ["doc_id", "vp_id", "kept_id", "q_id", "text", "answers", "chunk_id"]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[tuple] = []
        for (doc, _, _), group in groupby(rows, key=lambda r: (r["doc_id"], r["phrase"], r["alone"])):
            read = [(-1 if r["chunk_idx"] is None else r["chunk_idx"], r["id"], [[q["id"], q["text"], list(q["answers"]), q["chunk_id"]] for q in r["qs"] or ()]) for r in group]
            kept, merged = fold_phrases(read)
            out += [(doc, x[0], *x) for x in kept]
            out += [(doc, vp, old, None, None, None, None) for vp, old in merged]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    ordered = rows.repartition("doc_id", "phrase", "alone").sortWithinPartitions("doc_id", "phrase", "alone", "chunk_idx", "pos", "id")
    return ordered.mapInArrow(run, "doc_id long, vp_id string, kept_id string, q_id string, text string, answers array<string>, chunk_id string")
