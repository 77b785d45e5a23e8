"""Column expressions on text.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Classes spelled out: several times faster than the flag for Unicode classes, and the same in every engine.
SPACE = r"[\s\x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Outer Unicode white space removed; ``trim`` would remove blanks only."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def name_key(c: Column | str) -> Column:
    """Key of exact name matching: ASCII letters, digits and white space, lower case."""
    return F.lower(F.regexp_replace(col(c), r"[^a-zA-Z0-9\s]", ""))


def words(c: Column | str) -> Column:
    """Lower-case words split at white space; an empty text has no word."""
    return F.filter(F.split(F.lower(col(c)), f"{SPACE}+"), lambda w: w != "")


def word_tokens(c: Column | str) -> Column:
    """Lower-case runs of word characters (Unicode)."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({WORD}+)"), 1)


def clean_reference(c: Column | str) -> Column:
    """A reference as compared: outer white space removed, lower case."""
    return F.lower(strip(c))


def exploded(df, keep: list, items: Column, name: str, pos: str | None = None):
    """``df`` with one row per item of a list that is dear to compute, empty and null lists left out.

    A plain explode makes Spark infer a filter on the list and push it to the scan, which computes the list
    again there, and twice; the outer form with the filter behind it computes it once.  Null items are lost.
    """
    gen = F.posexplode_outer(items).alias(pos, name) if pos else F.explode_outer(items).alias(name)
    return df.select(*keep, gen).where(F.col(name).isNotNull())
