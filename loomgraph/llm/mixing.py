"""Mixing sources to target weights."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash that are used in all, and those that a level of the histogram may resolve.
ALL_BITS, LEVELS = 60, (10, 6, 5, 4, 3)
#: Most rows of a table of targets, which is broadcast, and most sums that a level returns for all of them.
MOST_TARGETS, MOST_SUMS = 100_000, 1_000_000


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A selection per mix in which each source has its target share of all tokens.

    ``sizes``: doc_id, source, n_tokens, a stored table (it is read several times); ``targets``:
    mix_name, source, target_share, max_repeats.  Returns the selection (mix_name, doc_id, source,
    n_tokens, copies) and the report, one row per target (mix_name, source, target_share,
    max_repeats, documents, used_documents, tokens, actual_share, short).

    Without ``total_tokens`` a mix is as large as its scarcest source allows; with it, a source that
    cannot give its share is used up to max_repeats and marked ``short``, as are sources without
    documents.  Every document of a source is used equally often, but for those whose hash lies
    under a threshold, which are used once more.  So what a source gives is off by half a document
    at most.  All mixes use one hash: a smaller budget takes a subset of a larger one.  Documents
    without tokens or without source are never selected; rows of equal doc_id go together.
    Repeated (mix_name, source) targets and shares or repeats below zero are refused; null shares
    count as zero, null repeats as one.

    The threshold: tokens summed per source and hash bucket, then only the bucket in which the
    budget ends is divided again, until one document is left in it.  A step returns at most
    ``MOST_SUMS`` sums: the more targets, the fewer buckets each; the selection is a filter.
    """
    spark = sizes.sparkSession
    goals = [(r[0], r[1], float(r[2] or 0), 1 if r[3] is None else int(r[3])) for r in targets.select("mix_name", "source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()]
    if len(goals) > MOST_TARGETS or len({g[:2] for g in goals}) < len(goals) or any(g[2] < 0 or g[3] < 0 for g in goals):
        raise ValueError("targets: too many, repeated or negative")
    bits = next(b for b in LEVELS if len(goals) << b <= MOST_SUMS)
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ALL_BITS)
    docs = sizes.where(F.col("n_tokens") > 0).select("doc_id", "source", "n_tokens", key.alias("key"))
    wanted = spark.createDataFrame([(s,) for s in sorted({g[1] for g in goals if g[1] is not None})], "source string")
    docs = docs.join(F.broadcast(wanted), "source", "left_semi")

    first = docs.groupBy("source", F.shiftright("key", ALL_BITS - bits).alias("bucket")).agg(F.sum("n_tokens"), F.count("*")).collect()
    level: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
    for source, bucket, tokens, n in first:
        level[source][bucket] = (tokens, n)
    there = {s: sum(t for t, _ in b.values()) for s, b in level.items()}

    size_of: dict[str, float] = {}
    for mix, source, share, repeats in goals:
        if share > 0 and there.get(source):
            most = there[source] * repeats / share
            size_of[mix] = min(size_of.get(mix, most), most) if total_tokens is None else float(total_tokens)
    plan, open_ = {}, {}
    for mix, source, share, repeats in goals:
        have = there.get(source, 0)
        need = min(round(share * size_of.get(mix, 0)), have * repeats)
        full, rest = divmod(need, have) if have else (0, 0)
        plan[mix, source] = [full, 0]
        if rest:
            open_[mix, source] = (0, rest, level[source])  # prefix of the key so far, budget left, sums below it
    depth = bits
    while open_:
        ahead = {}
        for (mix, source), (prefix, rest, sums) in open_.items():
            for bucket in sorted(sums):
                tokens, n = sums[bucket]
                if tokens > rest:
                    break
                rest -= tokens
            else:
                bucket, tokens, n = max(sums) + 1, 0, 0
            at = (prefix << bits | bucket) if depth > bits else bucket
            if n > 1 and depth < ALL_BITS and rest > 0:
                ahead[mix, source] = (at, rest)
            else:
                plan[mix, source][1] = (at + (tokens > 0 and 2 * rest >= tokens)) << (ALL_BITS - depth)
        open_ = {}
        if ahead:
            edge = spark.createDataFrame([(m, s, p) for (m, s), (p, _) in ahead.items()], "mix_name string, source string, prefix long")
            below = (
                docs.withColumn("prefix", F.shiftright("key", ALL_BITS - depth)).join(F.broadcast(edge), ["source", "prefix"])
                .groupBy("mix_name", "source", (F.shiftright("key", ALL_BITS - depth - bits) % (1 << bits)).alias("bucket")).agg(F.sum("n_tokens"), F.count("*"))
            )
            finer: dict[tuple, dict] = defaultdict(dict)
            for mix, source, bucket, tokens, n in below.collect():
                finer[mix, source][bucket] = (tokens, n)
            open_ = {k: (p, rest, finer[k]) for k, (p, rest) in ahead.items()}
            depth += bits

    rows = [(m, s, share, reps, *plan[m, s]) for m, s, share, reps in goals]
    chosen = spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int, full_passes long, threshold long")
    copies = (F.col("full_passes") + (F.col("key") < F.col("threshold")).cast("long")).alias("copies")
    selection = docs.join(F.broadcast(chosen), "source").select("mix_name", "doc_id", "source", "n_tokens", copies).where("copies > 0")
    used = selection.groupBy("mix_name", "source").agg(F.count("*").alias("used_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    stock = spark.createDataFrame([(s, sum(n for _, n in b.values()), there[s]) for s, b in level.items()], "source string, documents long, stock long")
    budget = spark.createDataFrame(list(size_of.items()), "mix_name string, budget double")
    report = chosen.join(used, ["mix_name", "source"], "left").join(F.broadcast(stock), "source", "left").join(F.broadcast(budget), "mix_name", "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    report = report.select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.try_divide(F.coalesce("tokens", F.lit(0)), total).alias("actual_share"),
        (F.coalesce(F.col("stock"), F.lit(0)) * F.col("max_repeats") < F.floor(F.col("target_share") * F.coalesce("budget", F.lit(1.0)))).alias("short"),
    )
    return selection, report
