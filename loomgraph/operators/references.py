"""Orphan references: keys that no living record of another table answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

MISSES = "target string, ref_key string, ref_id long, ref_at long, reason string"


def parent_keys(df: DataFrame, target: str, key: str, arrived: str, deleted: str) -> DataFrame:
    """One row per key: earliest arrival, earliest deletion (microseconds, null where none).

    Rows with a null key answer no reference and are left out.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.unix_micros(arrived)).alias("arrived"), F.min(F.unix_micros(deleted)).alias("deleted"))
        .select(F.lit(target).alias("target"), "key", "arrived", "deleted")
    )


def _as_keys(parts: list) -> np.ndarray:
    """Keys as a byte array that compares as Spark sorts them (UTF-8 bytes).

    Long keys, and keys with the zero character, which fixed-width arrays would cut, stay objects.
    """
    keys = pa.concat_arrays([p.cast(pa.large_binary()) for p in parts]) if parts else pa.array([], pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, np.int64)
    data = np.frombuffer(keys.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    size = np.diff(ends)
    width = int(size.max(initial=1)) or 1
    if width <= 128 and data.all():
        cells = np.zeros((len(keys), width), np.uint8)
        cells[np.arange(width) < size[:, None]] = data
        return cells.view(f"S{width}").reshape(-1)
    out = np.empty(len(keys), dtype=object)
    out[:] = keys.to_pylist()
    return out


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one key range, per target first all parents in key order, then the references.

    The parents become sorted arrays; every batch of references is looked up by binary search.
    """
    names = MISSES.replace(",", "").split()[::2]
    held: dict[str, list] = {}
    arrays: dict[str, tuple] = {}

    def look_up(target: str, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        if target not in arrays:
            got = held.pop(target, [])
            cat = lambda c: np.concatenate([p.column(c).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) for p in got]) if got else np.empty(0, np.int64)
            arrays.clear()
            arrays[target] = (_as_keys([p.column("key") for p in got]), cat("arrived"), cat("deleted"))
        parents, arrived, deleted = arrays[target]
        keys, at = _as_keys([rows.column("key")]), rows.column("ref_at").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        timed = rows.column("ref_at").is_valid().to_numpy(zero_copy_only=False)
        if len(parents):
            if parents.dtype != keys.dtype and (parents.dtype == object or keys.dtype == object):
                parents, keys = parents.astype(object), keys.astype(object)
            i = np.searchsorted(parents, keys)
            i[i == len(parents)] = 0
            there = parents[i] == keys
            late = there & timed & (arrived[i] > at) & (arrived[i] != np.iinfo(np.int64).max)
            gone = there & timed & ~late & (deleted[i] <= at)
        else:
            there = late = gone = np.zeros(len(keys), bool)
        miss = ~there | late | gone
        if not miss.any():
            return None
        reason = np.where(~there, "missing", np.where(late, "late", "deleted"))[miss]
        picked = rows.filter(pa.array(miss))
        return pa.RecordBatch.from_arrays([picked.column("target"), picked.column("key"), picked.column("ref_id"), picked.column("ref_at"), pa.array(reason, pa.string())], names=names)

    for batch in batches:
        side, target = batch.column("side").to_numpy(), np.array(batch.column("target").to_pylist(), dtype=object)
        edges = [0, *(np.flatnonzero((side[1:] != side[:-1]) | (target[1:] != target[:-1])) + 1), len(side)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            rows, t = batch.slice(lo, hi - lo), target[lo]
            if side[lo] == 0:
                held.setdefault(t, []).append(rows)
            elif (out := look_up(t, rows)) is not None:
                yield out


def orphan_references(refs: DataFrame, parents: DataFrame, hot_share: float = 0.002) -> DataFrame:
    """References without a living parent, with the reason.

    ``refs``: target, key, ref_id, ref_at (microseconds); ``parents``: as ``parent_keys`` gives,
    keys unique per target.  Result: target, ref_key, ref_id, ref_at, reason, one row per orphan
    reference, repetitions included.  ``missing``: no parent; ``late``: the parent arrived after
    the reference; ``deleted``: it was deleted by then.  A parent without arrival is never late; a
    reference without time can only be missing; null keys are no references.  Empty inputs
    give an empty result.

    Both sides are range-partitioned together on (target, key, salt), so that one partition holds
    the parents of its ranges, in order, and their references; these are probed batch by batch.
    Keys holding more than ``hot_share`` of all references get salts, and their parents a copy per
    salt: there are at most 1 / hot_share such keys, whatever the size of the data.
    """
    refs = refs.where(F.col("key").isNotNull()).select("target", "key", "ref_id", "ref_at")
    parents = parents.select("target", "key", "arrived", "deleted")
    spark = refs.sparkSession
    scratch = Scratch(spark, "references")
    refs = scratch.cut(refs, "refs")
    # Few rows by construction: each stands for hot_share of all references.
    counts = scratch.cut(refs.groupBy("target", "key").count(), "counts")
    least = max(1.0, (counts.agg(F.sum("count")).first()[0] or 0) * hot_share)
    hot = [(r["target"], r["key"], int(r["count"] // least) + 1) for r in counts.where(F.col("count") > least).collect()]
    scratch.drop("counts")
    salts = spark.createDataFrame(hot, "target string, key string, salts int")
    parents = parents.join(F.broadcast(salts), ["target", "key"], "left").select(
        "target", "key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"),
        F.lit(0).alias("side"), "arrived", "deleted", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("long").alias("ref_at"),
    )
    refs = refs.join(F.broadcast(salts), ["target", "key"], "left").select(
        "target", "key", F.coalesce(F.pmod(F.xxhash64("ref_id"), F.col("salts").cast("long")).cast("int"), F.lit(0)).alias("salt"),
        F.lit(1).alias("side"), F.lit(None).cast("long").alias("arrived"), F.lit(None).cast("long").alias("deleted"), "ref_id", "ref_at",
    )
    both = parents.unionByName(refs).repartitionByRange("target", "key", "salt").sortWithinPartitions("target", "side", F.when(F.col("side") == 0, F.col("key")))
    return both.mapInArrow(_probe, MISSES)
