"""Duplicates that differ only in formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """A string without Unicode white space and punctuation (P*), in one letter case.

    Accents stay.  Upper, then lower case brings together what either alone keeps apart; letters are
    mapped one to one, so ß stays itself.
    """
    return F.lower(F.upper(F.regexp_replace(c, r"[\p{P}\p{IsWhite_Space}]+", "")))


def canonical_bag(c: Column) -> Column:
    """Strings as a bag: each canonical, order gone, repetitions kept; null items last."""
    return F.array_sort(F.transform(c, canonical))


def _digest(text: Column, items: Column) -> Column:
    """128 bits of a key, to carry instead of the texts; null items differ from any text."""
    flat = F.transform(items, lambda x: F.coalesce(F.concat(F.lit("1"), x), F.lit("0")))
    return F.struct(F.xxhash64(text, F.size(items), flat).alias("h"), F.xxhash64(F.lit(7919), flat, text, F.lit(104729)).alias("l"))


def collapse_formatting(df: DataFrame, row: str, text: str, items: str) -> tuple[DataFrame, DataFrame]:
    """Records that agree but for white space, letter case, punctuation and the order of the items.

    Returns groups (group_row, copies, variants) over all records, single ones included, and
    members (group_row, row) of the groups of two or more.  ``group_row`` is the smallest ``row``
    (bigint, unique) of a group; ``variants`` counts its byte-different forms.  Records whose text
    is null or blank, or whose items are null, are left out; empty lists and texts of punctuation
    only are values like others.  Other columns are ignored.

    Byte-identical rows are counted first (combined before the shuffle); only the distinct
    survivors are made canonical and grouped again on their full canonical text, adding the
    counts.  Members travel as 128-bit digests and meet one row per group, so the join splits
    when a group is huge.
    """
    rows = df.select(F.col(row).alias("_row"), F.col(text).alias("_text"), F.col(items).alias("_items"))
    rows = rows.where(F.col("_items").isNotNull() & F.col("_text").rlike(r"\P{IsWhite_Space}"))
    raw = rows.groupBy("_text", "_items").agg(F.count("*").alias("n"), F.min("_row").alias("first_row"))
    survivors = raw.select("n", "first_row", "_text", "_items", canonical(F.col("_text")).alias("ctext"), canonical_bag(F.col("_items")).alias("citems"))
    groups = survivors.groupBy("ctext", "citems").agg(F.sum("n").alias("copies"), F.min("first_row").alias("group_row"), F.count("*").alias("variants"))
    key = lambda t, i: _digest(F.col(t), F.col(i))
    several = groups.where(F.col("copies") > 1).select(key("ctext", "citems").alias("ck"), "group_row").select("ck.*", "group_row")
    forms = survivors.select(key("ctext", "citems").alias("ck"), key("_text", "_items").alias("rk"), "n", "first_row").select("ck.*", F.col("rk.h").alias("rh"), F.col("rk.l").alias("rl"), "n", "first_row")
    linked = forms.join(several, ["h", "l"])
    once = linked.where(F.col("n") == 1).select("group_row", F.col("first_row").alias(row))
    again = rows.select("_row", key("_text", "_items").alias("rk")).select("_row", F.col("rk.h").alias("rh"), F.col("rk.l").alias("rl"))
    again = again.join(linked.where(F.col("n") > 1).select("rh", "rl", "group_row"), ["rh", "rl"]).select("group_row", F.col("_row").alias(row))
    return groups.select("group_row", "copies", "variants"), once.unionByName(again)
