"""A semantic memory as related tables, and the operators on its graph.

``entities`` (id, name, roles, chunk_id, doc_id, chunk_idx, pos), ``roles`` (entity_id, role_pos,
role, states, chunk_id), ``verb_phrases`` (id, phrase, chunk_id, doc_id, chunk_idx, pos),
``questions`` (id, vp_id, text, answers, chunk_id) and ``answers`` (q_id, vp_id, text, a_pos,
answer).  Rows delivered again are one row: the first to arrive counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


@dataclass(frozen=True)
class Memory:
    entities: DataFrame
    roles: DataFrame
    verb_phrases: DataFrame
    questions: DataFrame
    answers: DataFrame


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; combined before the shuffle, so a key may repeat without bound."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def place(id_col: str, chunk: Column) -> list[Column]:
    """Where a node stands: document, chunk and position within the chunk, from its identifiers."""
    return [
        chunk.alias("chunk_id"), F.substring_index(chunk, "_", 1).try_cast("bigint").alias("doc_id"),
        F.substring_index(chunk, "_", -1).try_cast("int").alias("chunk_idx"), F.regexp_extract(id_col, r"::[a-z]+(\d+)$", 1).try_cast("int").alias("pos"),
    ]


def delivered(id_col: Column | str) -> Column:
    """Order of delivery, as identifiers tell it: document, chunk and number within the chunk as numbers, for ``10`` comes after ``2``."""
    node = F.col(id_col) if isinstance(id_col, str) else id_col
    chunk = F.substring_index(node, "::", 1)
    return F.struct(
        F.substring_index(chunk, "_", 1).try_cast("bigint").alias("doc"), F.substring_index(chunk, "_", -1).try_cast("bigint").alias("chunk"),
        F.regexp_extract(node, r"(\d+)$", 1).try_cast("bigint").alias("number"), node.alias("id"),
    )


def load(spark: SparkSession, sf_dir: str) -> Memory:
    own_chunk = F.coalesce("chunk_id", F.substring_index("id", "::", 1))
    entities = first_rows(table(spark, sf_dir, "entity_nodes").select("id", "name", "roles", "chunk_id", "arrived_at"), "id", "arrived_at")
    entities = entities.select("id", "name", "roles", *place("id", own_chunk))
    roles = entities.select(F.col("id").alias("entity_id"), F.col("chunk_id").alias("_own"), F.posexplode("roles").alias("role_pos", "r")).select(
        "entity_id", "role_pos", "r.role", F.coalesce("r.states", F.array().cast("array<string>")).alias("states"), F.coalesce("r.chunk_id", "_own").alias("chunk_id")
    )
    phrases = first_rows(table(spark, sf_dir, "verb_phrase_nodes"), "id", "arrived_at").select("id", "phrase", *place("id", own_chunk))
    questions = first_rows(table(spark, sf_dir, "questions").select("question_row", "id", "vp_id", "text", "answers", "chunk_id"), "id", "question_row").drop("question_row")
    answers = questions.select(F.col("id").alias("q_id"), "vp_id", "text", F.posexplode("answers").alias("a_pos", "answer"))
    return Memory(entities, roles, phrases, questions, answers)


def is_none(c: Column) -> Column:
    return c == "None"


def is_text(c: Column) -> Column:
    return c.startswith("TEXT:")


def is_empty(c: Column) -> Column:
    """Markers of no answer, as summaries read them."""
    return F.lower(c).isin("none", "na", "")


# Mutators


def similarity_edges(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) between two different, existing entities, each once."""
    a, b = F.col("left_id"), F.col("right_id")
    edges = pairs.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    known = entities.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def merge_roles(roles: DataFrame, canonical: DataFrame, entities: DataFrame) -> DataFrame:
    """Roles of merged entities: of equal (role, chunk_id) the first to come stays, whatever its states."""
    order = F.struct("doc_id", "chunk_idx", "pos", "id", "role_pos")
    rows = roles.join(canonical, roles["entity_id"] == canonical["id"]).join(entities.select("id", "doc_id", "chunk_idx", "pos"), "id")
    return rows.groupBy("canonical_id", "role", "chunk_id").agg(F.min_by("states", order).alias("states"))


def rewrite_answers(questions: DataFrame, canonical: DataFrame) -> DataFrame:
    """Questions whose answers name canonical entities; unknown answers stay.  Order is kept.

    Only answers that change are shuffled to the map; lists are rebuilt per question, which bounds a group.
    """
    rows = questions.select("id", F.posexplode("answers").alias("a_pos", "answer"))
    moved = canonical.where("id <> canonical_id").select(F.col("id").alias("answer"), "canonical_id")
    rows = rows.join(moved, "answer", "left").select("id", "a_pos", F.coalesce("canonical_id", "answer").alias("answer"), F.col("canonical_id").isNotNull().alias("changed"))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a_pos", "answer"))).alias("x"), F.bool_or("changed").alias("changed")).where("changed")
    return lists.select("id", F.transform("x", lambda s: s["answer"]).alias("answers"))


def most_connected(memory: Memory, edges: DataFrame, n: int | None = None) -> DataFrame:
    """(id, degree): answers naming the entity, repetitions included, and ends of edges; entities
    without any stay.  ``n`` keeps the top of the order (degree desc, document, chunk, position)."""
    named = memory.answers.where(~is_none(F.col("answer")) & ~is_text(F.col("answer"))).select(F.col("answer").alias("id"))
    ends = named.unionAll(edges.select(F.col("src").alias("id"))).unionAll(edges.select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    out = memory.entities.join(degree, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"), "doc_id", "chunk_idx", "pos")
    if n is not None:
        out = out.orderBy(F.desc("degree"), "doc_id", "chunk_idx", "pos", "id").limit(n)
    return out.select("id", "name", "degree")


def _real_merges(node_ids: DataFrame, merges: DataFrame) -> DataFrame:
    """(source_id, target_id, place) of merges between two different, known nodes; a source goes into one target, the first by ``place``."""
    place = F.col("place") if "place" in merges.columns else F.lit(0)
    first = merges.where("source_id <> target_id").groupBy("source_id").agg(F.min(F.struct(place.alias("place"), "target_id")).alias("x")).select("source_id", "x.target_id", "x.place")
    known = node_ids.select("node_id")
    return first.join(known.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def merge_context_nodes(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge space or time nodes: ``nodes`` (node_id, chunk_id, name_history map, current_name), ``merges``
    (source_id, target_id, and place if their order matters), any number of sources per target; a target is no source itself.

    Per chunk the target's history wins, then that of the first source by (place, source_id); the latest chunk's
    current name stays, of equal chunks the first's; sources go.  Merges that name an unknown node change nothing.
    """
    real = _real_merges(nodes, merges)
    moved = nodes.join(real.withColumnRenamed("source_id", "node_id"), "node_id")
    moved = moved.select("target_id", F.struct("place", "node_id").alias("place"), "chunk_id", "name_history", "current_name")
    kept = nodes.join(real.select(F.col("source_id").alias("node_id")), "node_id", "left_anti")
    said = moved.select("target_id", "place", F.explode("name_history").alias("key", "value")).groupBy("target_id", "key").agg(F.min_by("value", "place").alias("value"))
    said = said.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("s_history"))
    last = moved.where("chunk_id is not null").groupBy("target_id", "chunk_id").agg(F.min_by("current_name", "place").alias("s_name"))
    last = last.groupBy("target_id").agg(F.max("chunk_id").alias("s_chunk"), F.max_by("s_name", "chunk_id").alias("s_name"))
    out = kept.join(said.withColumnRenamed("target_id", "node_id"), "node_id", "left").join(last.withColumnRenamed("target_id", "node_id"), "node_id", "left")
    extra = F.map_filter("s_history", lambda k, v: ~F.map_contains_key("name_history", k))
    later = F.coalesce(F.col("s_chunk") > F.col("chunk_id"), F.lit(False))
    return out.select(
        "node_id", F.when(later, F.col("s_chunk")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("s_history").isNotNull(), F.coalesce(F.map_concat("name_history", extra), "s_history")).otherwise(F.col("name_history")).alias("name_history"),
        F.when(later, F.col("s_name")).otherwise(F.col("current_name")).alias("current_name"),
    )


def redirect_edges(edges: DataFrame, nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(entity_id, node_id): edges to merged nodes lead to their targets, each once; ``nodes`` and ``merges`` as merged."""
    moved = _real_merges(nodes, merges).select(F.col("source_id").alias("node_id"), "target_id")
    return edges.join(moved, "node_id", "left").select("entity_id", F.coalesce("target_id", "node_id").alias("node_id")).distinct()


def history_text(history: Column) -> Column:
    """``Chunk{k}:{v}`` in the order of the keys as texts."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(history)), lambda e: F.concat(F.lit("Chunk"), e["key"], F.lit(":"), e["value"])), ", ")


# Lookups and neighbourhoods


def connected_entities(memory: Memory) -> DataFrame:
    """(id, neighbour): the other entities that answer in a verb phrase in which the entity answers."""
    named = memory.answers.where(~is_none(F.col("answer")) & ~is_text(F.col("answer"))).select("vp_id", F.col("answer").alias("id")).distinct()
    return named.join(named.select("vp_id", F.col("id").alias("neighbour")), "vp_id").where("id <> neighbour").select("id", "neighbour").distinct()


def entity_context(memory: Memory) -> DataFrame:
    """(entity_id, q_id, question, co_answer, co_name): what each entity answers, and with whom.

    Co-answers that no entity has are echoed; answers of none are dropped; without co-answers
    the question stands once with nulls.
    """
    mine = memory.answers.where(~is_none(F.col("answer")) & ~is_text(F.col("answer"))).select("q_id", F.col("text").alias("question"), F.col("answer").alias("entity_id")).distinct()
    mine = mine.join(memory.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    others = memory.answers.where(~is_none(F.col("answer"))).select("q_id", F.col("answer").alias("co_answer")).distinct()
    others = others.join(memory.entities.select(F.col("id").alias("co_answer"), F.col("name")), "co_answer", "left").select("q_id", "co_answer", F.coalesce("name", "co_answer").alias("co_name"))
    both = mine.join(others.withColumnRenamed("q_id", "q2"), (F.col("q_id") == F.col("q2")) & (F.col("entity_id") != F.col("co_answer")), "left")
    return both.select("entity_id", "q_id", "question", "co_answer", "co_name")


def qa_pairs_of_entities(memory: Memory) -> DataFrame:
    """(entity_id, q_id, question, answer_names): all questions of every verb phrase in which the entity answers."""
    spans = memory.answers.select("vp_id", F.col("answer").alias("entity_id")).distinct().join(memory.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return spans.join(resolved_answers(memory), "vp_id").select("entity_id", "q_id", "question", "answer_names")


def resolved_answers(memory: Memory) -> DataFrame:
    """(q_id, vp_id, question, answer_names): answers in order by the names of their entities, else as they are."""
    rows = memory.answers.join(memory.entities.select(F.col("id").alias("answer"), "name"), "answer", "left").select("q_id", "vp_id", "text", F.struct("a_pos", F.coalesce("name", "answer").alias("n")).alias("x"))
    grouped = rows.groupBy("q_id", "vp_id").agg(F.min("text").alias("question"), F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("q_id", "vp_id", "question", F.array_join(F.transform("x", lambda s: s["n"]), ", ").alias("answer_names"))


def chunk_key(chunk: Column) -> Column:
    """Order of a chunk in a timeline: the numbers after the first underscore; [-1] without any."""
    cleaned = F.regexp_replace(chunk, "^chunk_chunk_", "chunk_")
    parts = F.filter(F.transform(F.slice(F.split(cleaned, "_"), 2, F.greatest(F.size(F.split(cleaned, "_")) - 1, F.lit(0))), lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(-1)))


def timeline_roles(memory: Memory) -> DataFrame:
    """(entity_id, chunk_id, roles_text): what an entity is, chunk by chunk.  Roles without a chunk are left out."""
    states = F.concat(F.lit("["), F.array_join(F.transform("states", lambda s: F.concat(F.lit('"'), F.coalesce(s, F.lit("null")), F.lit('"'))), ", "), F.lit("]"))
    line = F.concat(F.lit("  - Role: "), F.coalesce("role", F.lit("None")), F.when(F.size("states") > 0, F.concat(F.lit("\n    States: "), states)).otherwise(""))
    rows = memory.roles.where("chunk_id is not null").select("entity_id", "chunk_id", F.struct("role_pos", line.alias("line")).alias("x"))
    return rows.groupBy("entity_id", "chunk_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("entity_id", "chunk_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("roles_text"))


def timeline_actions(memory: Memory) -> DataFrame:
    """(entity_id, chunk_id, actions): verb phrases with the question the entity answers, by the question's chunk."""
    asked = memory.questions.where("chunk_id is not null").select(F.col("id").alias("q_id"), "chunk_id")
    rows = memory.answers.where(~is_none(F.col("answer")) & ~is_text(F.col("answer"))).select("q_id", "vp_id", "text", F.col("answer").alias("entity_id")).distinct()
    rows = rows.join(memory.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(asked, "q_id").join(memory.verb_phrases.select(F.col("id").alias("vp_id"), "phrase"), "vp_id")
    return rows.select("entity_id", "chunk_id", "vp_id", "q_id", "phrase", F.col("text").alias("answered_question"))


# Export


def graph_nodes(memory: Memory) -> DataFrame:
    """(node_id, node_type, label): entities, verb phrases, placeholders of unknown answers and of unanswered questions."""
    entities = memory.entities.select(F.col("id").alias("node_id"), F.lit("entity").alias("node_type"), F.col("name").alias("label"))
    phrases = memory.verb_phrases.select(F.col("id").alias("node_id"), F.lit("verb_phrase").alias("node_type"), F.col("phrase").alias("label"))
    edges = graph_edges(memory)
    known = entities.select("node_id").unionByName(phrases.select("node_id"))
    other = edges.select(F.col("target").alias("node_id")).distinct().join(known, "node_id", "left_anti")
    other = other.select("node_id", F.when(F.col("node_id").startswith("unresolved_"), "unresolved").otherwise("placeholder").alias("node_type"), F.col("node_id").alias("label"))
    return entities.unionByName(phrases).unionByName(other)


def graph_edges(memory: Memory) -> DataFrame:
    """(source, target, q_id): one edge per verb phrase and answer; the last question stays.  Questions
    without an answer get a node of their own."""
    q = memory.questions.select("id", "vp_id", F.when(F.coalesce(F.size(F.filter("answers", lambda a: ~is_none(a))), F.lit(0)) <= 0, F.array(F.concat(F.lit("unresolved_"), "vp_id", F.lit("_"), "id"))).otherwise(F.filter("answers", lambda a: ~is_none(a))).alias("answers"))
    rows = q.select(F.col("vp_id").alias("source"), F.explode("answers").alias("target"), F.col("id").alias("q_id"))
    return rows.groupBy("source", "target").agg(F.max_by("q_id", delivered("q_id")).alias("q_id"))


def node_evolution(memory: Memory) -> DataFrame:
    """(entity_id, role_chunks, evolves, short_label): does an entity's description span several chunks?"""
    chunks = memory.roles.where("chunk_id is not null").groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("role_chunks"))
    out = memory.entities.join(chunks, memory.entities["id"] == chunks["entity_id"], "left")
    label = F.when(F.length("name") > 20, F.concat(F.substring("name", 1, 20), F.lit("..."))).otherwise(F.col("name"))
    return out.select(F.col("id").alias("entity_id"), F.coalesce("role_chunks", F.lit(0)).alias("role_chunks"), (F.coalesce("role_chunks", F.lit(0)) > 1).alias("evolves"), label.alias("short_label"))


# Counts


def memory_statistics(memory: Memory, canonical: DataFrame) -> DataFrame:
    """Per document and overall (doc_id null): entities before and after reconciliation, compression, roles, evolution."""
    merged = canonical.join(memory.entities.select("id", "doc_id"), "id")
    size = F.coalesce(F.size("roles"), F.lit(0))
    roles = memory.roles.join(merged.select(F.col("id").alias("entity_id"), "canonical_id"), "entity_id").groupBy("canonical_id").agg(F.count_distinct("chunk_id").alias("spans"))
    rows = merged.join(memory.entities.select("id", F.when(size < 0, 0).otherwise(size).alias("n_roles")), "id").join(roles, "canonical_id", "left")
    head = (F.col("id") == F.col("canonical_id")).cast("int")
    out = rows.groupingSets([["doc_id"], []], "doc_id").agg(
        F.count("*").alias("input_entities"), F.sum(head).alias("reconciled_entities"),
        F.sum(F.when((F.col("spans") > 1) & (head == 1), 1).otherwise(0)).alias("entities_with_evolution"), F.sum("n_roles").alias("total_roles"),
    )
    return out.withColumn("compression_ratio", F.round(F.coalesce(F.try_divide("reconciled_entities", "input_entities"), F.lit(0.0)), 6)).withColumn("avg_roles", F.round(F.coalesce(F.try_divide("total_roles", "reconciled_entities"), F.lit(0.0)), 6))


def role_histogram(memory: Memory) -> DataFrame:
    """Entities by number of roles, in buckets of ten."""
    n = F.greatest(F.coalesce(F.size("roles"), F.lit(0)), F.lit(0))
    return memory.entities.select((F.floor(n / 10) * 10).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("entities"))


def corpus_statistics(memory: Memory) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("roles"), F.lit(0)), F.lit(0))
    return memory.entities.agg(
        F.count("*").alias("entities"), F.count_if(n > 0).alias("with_roles"), F.round(F.avg(n), 6).alias("avg_roles"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("chunk_id").alias("chunks")
    )

