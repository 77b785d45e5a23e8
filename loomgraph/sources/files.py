"""Readers of the file formats around a memory: corpora, graphs, results, summaries, question sets, batch logs.

All give DataFrames; files are read by Spark in place.  What is said about bad files holds per file or
line: they are skipped or marked, never fatal.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import Memory

ROLE = "struct<role:string,states:array<string>,chunk_id:string>"
QUESTION = "struct<id:string,text:string,answers:array<string>,chunk_id:string>"
GRAPH = f"entity_nodes array<struct<id:string,name:string,roles:array<{ROLE}>,chunk_id:string,summary:string>>, verb_phrase_nodes array<struct<id:string,phrase:string,questions:array<{QUESTION}>,chunk_id:string>>"
CHUNK = f"struct<text:string,doc_idx:int,chunk_idx:int,global_id:string,start_sentence:int,end_sentence:int,gsw:struct<{GRAPH.replace(' array', ':array')}>,context:string>"
#: Where a question set keeps its gold answers: field, is it JSON in a string, may it say that there is none (fixed values).
DATASETS = {
    "2wiki": ("answer", False, False),
    "2wiki_platinum": ("answer", False, True),
    "2wiki_unanswerable": ("answer", False, True),
    "hotpotqa": ("answer", False, False),
    "lveval": ("answers", False, False),
    "musique": ("answer", False, False),
    "musique_platinum": ("answer", False, True),
    "musique_unanswerable": ("answer", False, True),
    "nq_rear": ("reference", False, False),
    "popqa": ("possible_answers", True, False),
}


def read_corpus(spark: SparkSession, path: str, lines: bool = False, start: int = 0, end: int | None = None) -> DataFrame:
    """A corpus of titled texts (one JSON array, or JSON lines): id, title, text, combined; ids count from 0 in file order.

    Numbered by an order-preserving two-step count; ``lines`` files are split among tasks, an array's elements are streamed by one.
    """
    # The elements of an array are read one by one, as lines are; only lines are split among tasks.
    rows = spark.read.schema("title string, text string").option("multiLine", not lines).json(path)
    rows = rows.where("title is not null or text is not null").withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).count().orderBy("_p").collect()
    before, offsets = 0, []
    for r in sizes:  # one row per file split
        offsets.append((r["_p"], before))
        before += r["count"]
    offset = spark.createDataFrame(offsets, "_p long, _o long")
    rows = rows.withColumn("_p", part).join(F.broadcast(offset), "_p").withColumn("id", F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1))
    rows = rows.where(F.col("id") >= start)
    rows = rows if end is None else rows.where(F.col("id") < end)
    return rows.select("id", "title", "text", F.concat_ws(" ", "title", "text").alias("combined"))


def read_graphs(spark: SparkSession, root: str, first: int | None = None) -> DataFrame:
    """Graph files ``doc_<n>/…_<n>_<chunk>.json``: doc_id, chunk_idx, path and the graph's lists; unreadable files are dropped.

    ``first``: only the documents of the so many smallest numbers.
    """
    rows = spark.read.schema(GRAPH + ", broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(f"{root}/doc_*/*.json")
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    rows = rows.where("broken is null and (entity_nodes is not null or verb_phrase_nodes is not null)").drop("broken")
    rows = rows.select(F.regexp_extract("path", r"doc_(\d+)/", 1).cast("long").alias("doc_id"), F.regexp_extract("path", r"_(\d+)\.json$", 1).cast("int").alias("chunk_idx"), "path", "entity_nodes", "verb_phrase_nodes")
    if first is None:
        return rows
    wanted = rows.select("doc_id").distinct().orderBy("doc_id").limit(first)
    return rows.join(wanted, "doc_id", "left_semi")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A combined results file: one row per chunk, documents numbered by their suffix."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.documents"), f"map<string,map<string,{CHUNK}>>").alias("d"))
    docs = whole.select(F.explode("d").alias("doc", "chunks"))
    return docs.select(F.regexp_extract("doc", r"(\d+)$", 1).cast("long").alias("doc_id"), F.explode("chunks").alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.*")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Entity summaries, as objects or as bare texts: entity_id, entity_name, summary."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("entity_id", "v"))
    return whole.select("entity_id", F.get_json_object("v", "$.entity_name").alias("entity_name"), F.coalesce(F.get_json_object("v", "$.summary"), F.col("v")).alias("summary"))


def gold_answers(raw: Column, json_text: bool) -> Column:
    """Gold answers as a list, from a list, a text, or JSON in a text."""
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(raw)) if not json_text else F.coalesce(listed, F.array(raw))


def read_questions(spark: SparkSession, path: str, dataset: str, aliases_with_any_field: bool = True, lines: bool = False) -> DataFrame:
    """A question set (a JSON array, or JSON lines): id, question, golds, answerable; without an id of its own a question has its position.

    Aliases are appended where present; with ``aliases_with_any_field`` false only if the gold field is ``answer``.
    """
    if dataset not in DATASETS:
        raise ValueError(f"unknown question set {dataset}")
    field, json_text, none_allowed = DATASETS[dataset]
    rows = spark.read.schema(f"_id string, id string, question string, {field} string, answer_aliases array<string>").option("multiLine", not lines).json(path)
    golds = gold_answers(F.col(field), json_text)
    extra = F.coalesce("answer_aliases", F.array().cast("array<string>"))
    golds = F.concat(golds, extra) if aliases_with_any_field or field == "answer" else golds
    ident = F.coalesce("_id", F.col("id"), F.monotonically_increasing_id().cast("string"))
    return rows.select(ident.alias("id"), "question", golds.alias("golds"), (~F.lit(none_allowed) | (F.size(golds) > 0)).alias("answerable"))


def titles_needed(questions: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that questions' contexts name (question_id, titles array), the last of equal titles; and the titles not found."""
    wanted = questions.select(F.explode("titles").alias("title")).distinct()
    last = corpus.groupBy("title").agg(F.max_by(F.struct("id", "text"), "id").alias("d"))
    return wanted.join(last, "title").select("title", "d.*"), wanted.join(last, "title", "left_anti")


def supporting_texts(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question_id, pos, title, text): the sentence a fact names (title, sentence number), the whole text if there is none.

    ``facts``: question_id, pos, title, sent; ``corpus``: title, sentences array.  Unknown titles give nothing.
    """
    rows = facts.join(corpus, "title")
    sentence = F.when(F.col("sent") >= 0, F.get("sentences", F.col("sent")))
    return rows.select("question_id", "pos", "title", F.coalesce(sentence, F.array_join("sentences", " ")).alias("text"))


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of a book (map of key to text), in the order of the keys as texts: pos, chapter, text."""
    whole = spark.read.text(path, wholetext=True).select(F.array_sort(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    return whole.select(F.posexplode("e").alias("pos", "x")).select("pos", F.col("x.key").alias("chapter"), F.col("x.value").alias("text"))


def supporting_paragraphs(questions: DataFrame) -> DataFrame:
    """(question_id, pos, title, text): the paragraphs of a question's own contexts that are marked as supporting, in order.

    ``questions``: question_id, contexts (array of title, text, is_supporting); a null mark is none.
    """
    rows = questions.select("question_id", F.posexplode("contexts").alias("pos", "c")).where(F.coalesce("c.is_supporting", F.lit(False)))
    return rows.select("question_id", "pos", "c.title", "c.text")


def read_memory(spark: SparkSession, path: str) -> tuple[Memory, DataFrame]:
    """A reconciled memory as ``write_memory`` left it, and its statistics."""
    statistics = "doc_id long, input_entities long, reconciled_entities long, entities_with_evolution long, total_roles long, compression_ratio double, avg_roles double"
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("entities", "roles", "verb_phrases", "questions", "answers")}
    return Memory(**tables), spark.read.schema(statistics).json(f"{path}/statistics")


# What a run left behind


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stages_present(spark: SparkSession, root: str, stages: dict[str, str]) -> dict[str, bool]:
    """Which stages of a run exist (name -> file or folder below root); none at all is an error."""
    found = {}
    for name, below in stages.items():
        fs, p = _fs(spark, f"{root}/{below}")
        found[name] = bool(fs.exists(p))
    if not any(found.values()):
        raise FileNotFoundError(f"no stage of a run in {root}")
    return found


def list_runs(spark: SparkSession, root: str, marks: tuple[str, ...] = ("eval", "test")) -> list[tuple[str, int]]:
    """Folders of runs whose name has a mark, the latest name first, with their size in bytes."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = [(PurePosixPath(s.getPath().toString()).name, fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p) if s.isDirectory()]
    return sorted((x for x in out if any(m in x[0] for m in marks)), reverse=True)
