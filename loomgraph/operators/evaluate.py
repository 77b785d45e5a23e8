"""Answer quality: exact match, token F1, judged items, chapters, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def answer_tokens(c: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, split at white space."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.filter(F.split(bare, f"{SPACE}+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def exact_match(prediction: Column, golds: Column) -> Column:
    """1.0 if the prediction equals any gold once normalised; 0.0 without golds."""
    mine = F.array_join(answer_tokens(prediction), " ")
    return F.coalesce(F.exists(golds, lambda g: F.array_join(answer_tokens(g), " ") == mine).cast("double"), F.lit(0.0))


def token_f1(prediction: Column, golds: Column) -> Column:
    """Best F1 of the token bags over the golds; 0.0 where nothing is shared or there is no gold."""
    p = answer_tokens(prediction)

    def one(gold: Column) -> Column:
        g = answer_tokens(gold)
        count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
        return F.when(shared > 0, 2.0 * shared / (F.size(p) + F.size(g))).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))


def report_text(scores: DataFrame, group: str, overall: str = "all") -> DataFrame:
    """One row (report): number, EM and F1 overall and per group, in the order of the groups; ``scores``: em, f1 and a group, null groups as ``unknown``."""
    named = scores.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g"), "em", "f1")
    rows = named.groupingSets([["g"], []], "g").agg(F.grouping("g").alias("total"), F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    line = F.format_string("%s: n=%d EM=%.4f F1=%.4f", F.when(F.col("total") == 1, overall).otherwise(F.col("g")), F.col("n"), F.coalesce("em", F.lit(0.0)), F.coalesce("f1", F.lit(0.0)))
    lines = rows.select(F.struct((1 - F.col("total")).alias("o"), "g", line.alias("t")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("report"))


def truth_format(columns: list[str]) -> str:
    """Which form of truth a table of questions has: ``chapters`` or ``answers``; none of them is an error."""
    if "correct_answer_chapters" in columns:
        return "chapters"
    if "correct_answer" in columns:
        return "answers"
    raise ValueError("neither correct_answer nor correct_answer_chapters")


def judged(n_truth: Column, n_found: Column, total: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of judged items.  Nothing expected and nothing found is perfect; nothing found
    has no precision."""
    none, empty = n_truth == 0, n_found == 0
    precision = F.when(none & empty, 1.0).when(none, 0.0).when(empty, F.lit(None)).otherwise(total / n_found)
    recall = F.when(none & empty, 1.0).when(none | empty, 0.0).otherwise(total / n_truth)
    f1 = F.when(none & empty, 1.0).when(none | empty, 0.0).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return F.round(precision, 6), F.round(recall, 6), F.round(f1, 6)


def set_scores(truth: Column, found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of sets; two empty sets agree, one empty set scores 0."""
    t, f = F.array_distinct(truth), F.array_distinct(found)
    hit = F.size(F.array_intersect(t, f))
    both = (F.size(t) == 0) & (F.size(f) == 0)
    share = lambda n: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hit, n), F.lit(0.0)))
    p, r = share(F.size(f)), share(F.size(t))
    return F.round(p, 6), F.round(r, 6), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)


def compare_systems(scores: DataFrame, system: str, metric: str, base: str, other: str) -> DataFrame:
    """One row: means of two systems, their difference and the improvement in per cent (null over a base of 0)."""
    mean = lambda s: F.coalesce(F.round(F.avg(F.when(F.col(system) == s, F.col(metric))), 6), F.lit(0.0))
    out = scores.agg(mean(base).alias("base"), mean(other).alias("other"))
    return out.select("base", "other", F.round(F.col("other") - F.col("base"), 6).alias("difference"), F.round(100 * F.try_divide(F.col("other") - F.col("base"), F.nullif("base", F.lit(0.0))), 4).alias("improvement"))


def read_judgement(reply: Column) -> Column:
    """A judge's reply as (n_found, total, explanation, error).

    The reply is JSON as a whole, or what lies between its first and last brace is; else nothing was found and the error says so.
    ``identified_items_in_AI_answer`` are the found items; ``matching_score`` are objects of one key each whose numbers are added up;
    others don't count.
    """
    body = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    tree = F.try_parse_json(body)
    listed = lambda path: F.coalesce(F.try_variant_get(tree, path, "array<variant>"), F.array().cast("array<variant>"))
    pair = lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,string>"))
    number = lambda v: F.when(F.size(pair(v)) == 1, F.get(pair(v), F.lit(0)).try_cast("double"))
    total = F.aggregate(listed("$.matching_score"), F.lit(0.0), lambda s, v: s + F.coalesce(number(v), F.lit(0.0)))
    error = F.when(body.isNull(), "No JSON found in response").when(tree.isNull(), "Could not parse JSON")
    return F.struct(F.size(listed("$.identified_items_in_AI_answer")).alias("n_found"), total.alias("total"), F.try_variant_get(tree, "$.explanation", "string").alias("explanation"), error.alias("error"))


def judged_means(scores: DataFrame) -> DataFrame:
    """One row: number, errors and the means of precision (nulls left out), recall and F1."""
    mean = lambda x: F.coalesce(F.round(F.avg(x), 4), F.lit(0.0)).alias(x)
    return scores.agg(F.count("*").alias("n"), F.count("error").alias("errors"), mean("precision"), mean("recall"), mean("f1"))
