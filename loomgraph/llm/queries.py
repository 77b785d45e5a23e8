"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table
from .components import connected_groups
from .duplicates import collapse_formatting
from .linkage import link_entities
from .mixing import mix_sources
from .packing import fill_report, pack_items
from .splitting import split_texts
from .tokens import count_tokens


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return collapse_formatting(table(spark, sf_dir, "questions"), "question_row", "text", "answers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[1]


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[0]


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_entities(table(spark, sf_dir, "entity_nodes"), table(spark, sf_dir, "entity_nodes_alt"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("id", "alt_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "entity_matches").where("verdict")
    return connected_groups(accepted, "left_id", "right_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size in tokens, counted once and stored: the operators read it several times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens"))
    return Scratch(spark, "sizes").cut(docs, "documents")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "size_limits").where("purpose = 'container'")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(_sizes(spark, sf_dir), _containers(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _containers(spark, sf_dir)
    return fill_report(pack_items(_sizes(spark, sf_dir), limits), limits)


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").where("purpose = 'piece'")
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", limits)


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must hold, counted per container size: documents packed, containers above their capacity, documents whose
    parts are not exactly the document, documents divided though they fit."""
    sizes, limits = _sizes(spark, sf_dir), _containers(spark, sf_dir).select("limit_name", F.col("max_tokens").cast("long").alias("capacity"))
    packed = Scratch(spark, "packed").cut(pack_items(sizes, _containers(spark, sf_dir)), "packed").join(F.broadcast(limits), "limit_name")
    full = packed.groupBy("limit_name", "container", "capacity").agg(F.sum("n_tokens").alias("n")).groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("limit_name", "doc_id", "capacity").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"))
    whole = docs.join(sizes.select("doc_id", "n_tokens"), "doc_id", "full_outer").groupBy("limit_name").agg(
        F.count("*").alias("documents"), F.count_if(~F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("parts")), F.lit(False))).alias("broken"),
        F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("divided_in_vain"),
    )
    return whole.join(full, "limit_name", "left").select("limit_name", "documents", "overfull", "broken", "divided_in_vain")


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every mix must hold: sources off their share by more than the documents at the thresholds allow, documents repeated too often,
    documents of other sources."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen, report = mix_sources(sizes, targets)
    known = targets.select("mix_name", "source", "max_repeats")
    rows = chosen.join(F.broadcast(known), ["mix_name", "source"], "left")
    wrong = rows.groupBy("mix_name").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("repeated"), F.count_if(F.col("max_repeats").isNull()).alias("foreign"))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    full = report.where("not short").join(largest, "source", "left")
    mix = full.groupBy("mix_name").agg((F.sum("tokens") / F.sum("target_share")).alias("size"), F.count("*").alias("n"), F.max("largest").alias("most"))
    # Half a document at each threshold, and their sum in the size of the mix.
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("size")) > (1 + F.col("target_share") * F.col("n")) / 2 * F.col("most") + 1
    shares = full.join(mix, "mix_name").groupBy("mix_name").agg(F.count_if(off).alias("off"))
    out = targets.select("mix_name").distinct().join(shares, "mix_name", "left").join(wrong, "mix_name", "left")
    return out.select("mix_name", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("off", "repeated", "foreign")))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all pieces must hold, counted per piece size: texts that their pieces, without overlap, don't give again, pieces above the size, texts
    left in one piece, pieces whose overlap is longer than asked."""
    docs, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits").where("purpose = 'piece'")
    pieces = split_texts(docs, "doc_id", "text", limits).join(F.broadcast(limits.select("limit_name", "max_tokens", "overlap_tokens")), "limit_name")
    own = F.substr("text", F.col("own_start_char") - F.col("start_char") + 1)
    lap = F.substr("text", F.lit(1), F.col("own_start_char") - F.col("start_char"))
    checked = pieces.select("limit_name", "doc_id", F.struct("piece", "own_start_char", "end_char", own.alias("own")).alias("x"), (F.col("n_tokens") > F.col("max_tokens")).cast("int").alias("over"), (count_tokens(lap) > F.coalesce("overlap_tokens", F.lit(0))).cast("int").alias("long"))
    whole = checked.groupBy("limit_name", "doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("over").alias("over"), F.sum("long").alias("long"))
    whole = whole.select("limit_name", "doc_id", F.md5(F.array_join(F.transform("x", lambda p: p["own"]), "")).alias("mine"), F.size("x").alias("n"), "over", "long")
    whole = whole.join(docs.select("doc_id", F.md5("text").alias("theirs")), "doc_id", "left")
    counted = whole.groupBy("limit_name").agg(F.count_if(~F.col("mine").eqNullSafe(F.col("theirs"))).alias("lost"), F.sum("over").alias("over"), F.count_if(F.col("n") < 2).alias("uncut"), F.sum("long").alias("long"))
    out = limits.select("limit_name").join(counted, "limit_name", "left")
    return out.select("limit_name", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("lost", "over", "uncut", "long")))


_CANON_SQL = r"""
WITH c AS (
  SELECT question_row, text, answers, lower(upper(regexp_replace(text, '[\pP\pZ\x09-\x0d\x{85}]', '', 'g'))) AS t,
    list_sort(list_transform(answers, lambda x: lower(upper(regexp_replace(x, '[\pP\pZ\x09-\x0d\x{85}]', '', 'g'))))) AS a
  FROM questions WHERE answers IS NOT NULL AND regexp_matches(text, '[^\pZ\x09-\x0d\x{85}]'))
"""

QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p6_packing": p6_packing, "p6_fill": p6_fill, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_pieces": p8_pieces, "p6_invariants": p6_invariants, "p7_invariants": p7_invariants, "p8_invariants": p8_invariants}
ORACLES = {
    "p1_found": _CANON_SQL + "SELECT min(question_row) OVER w AS group_row, question_row FROM c WINDOW w AS (PARTITION BY t, a) QUALIFY count(*) OVER w > 1",
    "p1_groups": _CANON_SQL + "SELECT min(question_row) AS group_row, count(*) AS copies, count(DISTINCT (text, answers)) AS variants FROM c GROUP BY t, a",
    # Of packings, mixes and pieces SQL knows what must hold: every document packed, nothing wrong.
    "p6_invariants": "SELECT limit_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS broken, 0::BIGINT AS divided_in_vain FROM size_limits WHERE purpose = 'container'",
    "p7_invariants": "SELECT DISTINCT mix_name, 0::BIGINT AS off, 0::BIGINT AS repeated, 0::BIGINT AS foreign FROM mix_targets",
    "p8_invariants": "SELECT limit_name, 0::BIGINT AS lost, 0::BIGINT AS over, 0::BIGINT AS uncut, 0::BIGINT AS long FROM size_limits WHERE purpose = 'piece'",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b FROM entity_matches WHERE verdict AND left_id <> right_id),
  n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
  r AS (SELECT DISTINCT x AS id, x AS top FROM n UNION SELECT n.y, r.top FROM r JOIN n ON n.x = r.id WHERE r.top < n.y)
SELECT min(top) AS group_id, id FROM r GROUP BY id""",
}
