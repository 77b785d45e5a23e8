"""Items of varying length into containers of fixed capacity."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Items above 1 / SMALL of the capacity are large; they get GROUPS groups of equal cardinality.
SMALL, GROUPS = 8, 40
#: Containers that one task fills up with small items, and items that one task numbers.
BLOCK, RUN = 20_000, 50_000


def _best_pattern(values: np.ndarray, sizes: list[int], capacity: int) -> np.ndarray:
    """How often to take each size so that the value in one container is greatest (repetition allowed)."""
    best = np.zeros(capacity + 1)
    stages = []
    for i, s in enumerate(sizes):
        if values[i] <= 1e-12:
            continue
        for _ in range(capacity // s):
            with_one = best.copy()
            with_one[s:] = np.maximum(best[s:], best[: capacity + 1 - s] + values[i])
            if np.array_equal(with_one, best):
                break
            stages.append((i, s, with_one > best))
            best = with_one
    pattern, left = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for i, s, took in reversed(stages):
        if took[left]:
            pattern[i] += 1
            left -= s
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of few sizes and how often each is used, so that all demand is met with few containers.

    The fractional optimum by generating patterns (each new one is the best at the current prices
    of the sizes), rounded down; what remains, less than one container per pattern, goes first-fit.
    """
    k = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    for step in range(40 * k):
        prices = inverse.sum(axis=0)
        new = _best_pattern(prices, sizes, capacity).astype(float)
        if new @ prices <= 1 + 1e-7:
            break
        entering, have = inverse @ new, inverse @ need
        ratio = np.where(entering > 1e-9, have / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = new
        inverse = np.linalg.inv(basis)
    times = np.floor(inverse @ need + 1e-6).astype(np.int64).clip(0)
    rest = np.array(demand, np.int64)
    used: list[tuple[np.ndarray, int]] = []
    for j in range(k):
        pattern = basis[:, j].astype(np.int64)
        n = int(min([times[j], *(rest[i] // pattern[i] for i in np.flatnonzero(pattern))]))
        if n > 0:
            used.append((pattern, n))
            rest -= n * pattern
    while rest.any():
        pattern, left = np.zeros(k, np.int64), capacity
        for i in range(k):  # sizes descend
            n = min(int(rest[i]), left // sizes[i])
            pattern[i], left = n, left - n * sizes[i]
        n = int(min(rest[i] // pattern[i] for i in np.flatnonzero(pattern)))
        used.append((pattern, n))
        rest -= n * pattern
    return used


def _plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple[int, int, int, int, int]], int]:
    """From the number of items of each size: group of each large size, slots and containers.

    A slot (group, first, last, per container, first container) says which of a group's items,
    as numbered, go to which containers.
    """
    large = sorted((s for s in counts if s * SMALL > capacity), reverse=True)
    if not large:
        return {}, [], 0
    each = -(-sum(counts[s] for s in large) // GROUPS)
    group_of, tops, demand = {}, [], []
    for s in large:
        if not tops or demand[-1] + counts[s] // 2 >= each:
            tops.append(s)
            demand.append(0)
        group_of[s] = len(tops) - 1
        demand[-1] += counts[s]
    slots, done, containers = [], [0] * len(tops), 0
    for pattern, n in configurations(tops, demand, capacity):
        for g in np.flatnonzero(pattern):
            per = int(pattern[g])
            slots.append((int(g), done[g], done[g] + per * n, per, containers))
            done[g] += per * n
        containers += n
    return group_of, slots, containers


def _fill(capacities: dict[str, int]):
    """Put the small items of a block, largest first, where they fit best; open containers for the rest."""

    def run(block: pa.Table) -> pa.Table:
        size = block.column("n_tokens").to_numpy()
        names = block.column("container").to_pylist()
        capacity = capacities[block.column("limit_name")[0].as_py()]
        free: dict[str, int] = {}
        loose = []
        for i, name in enumerate(names):
            if name is None:
                loose.append(i)
            else:
                free[name] = free.get(name, capacity) - int(size[i])
        at: dict[int, list[str]] = defaultdict(list)
        for name in sorted(free):
            at[free[name]].append(name)
        mask = sum(1 << f for f in at)
        doc, part = block.column("doc_id").to_numpy(), block.column("part").to_numpy()
        loose.sort(key=lambda i: (-size[i], doc[i], part[i]))
        number, tag = 0, block.column("block")[0].as_py()
        for i in loose:
            s = int(size[i])
            fits = mask >> s
            if fits:
                f = s + (fits & -fits).bit_length() - 1
                name = at[f].pop()
                if not at[f]:
                    mask ^= 1 << f
            else:
                f, name = capacity, f"s{tag}.{number}"
                number += 1
            names[i] = name
            at[f - s].append(name)
            mask |= 1 << (f - s)
        return block.select(["limit_name", "doc_id", "part", "start_token", "n_tokens"]).add_column(1, "container", pa.array(names, pa.string()))

    return run


def pack_items(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """Items in containers of each capacity: limit_name, container, doc_id, part, start_token, n_tokens.

    ``sizes``: doc_id (bigint, unique), n_tokens (null counts as zero); ``limits``: limit_name, max_tokens, few rows
    read as parameters.  An item above the capacity is divided: parts of exactly the capacity fill
    containers of their own, the remainder is an item like others; no other item is divided.  Items
    of no tokens get a container too.  ``container`` is unique within a limit.

    Linear grouping: large items are grouped by size, about equally many in each group, and rounded
    up to the largest of the group.  The few-size problem is solved on the driver from
    counts alone (at most ``capacity`` of them).  Items are numbered within their group in runs, so a
    large group splits, and the number gives the container.  Then containers and small items are
    dealt to blocks of bounded size, in each of which the small items go where they fit best.
    """
    spark = sizes.sparkSession
    caps = {r[0]: int(r[1]) for r in limits.select("limit_name", "max_tokens").collect()}
    if not caps or min(caps.values()) < 1:
        raise ValueError("limits: none, or below 1")
    choice = F.explode(F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(caps.items()))))
    wide = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), choice.alias("x")).select("x.*", "doc_id", "n", F.floor(F.col("n") / F.col("capacity")).alias("whole"))
    full = wide.where("n > capacity").select("limit_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    full = full.select("limit_name", F.concat(F.lit("d"), "doc_id", F.lit("."), "k").alias("container"), "doc_id", F.col("k").cast("int").alias("part"), (F.col("k") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    divided = F.col("n") > F.col("capacity")
    items = wide.select(
        "limit_name", "doc_id", F.when(divided, F.col("whole")).otherwise(0).cast("int").alias("part"), F.when(divided, F.col("whole") * F.col("capacity")).otherwise(0).alias("start_token"),
        F.when(divided, F.col("n") % F.col("capacity")).otherwise(F.col("n")).alias("n_tokens"), divided.alias("divided"),
    ).where("not divided or n_tokens > 0").drop("divided")

    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for name, n, many in items.groupBy("limit_name", "n_tokens").count().collect():
        counts[name][n] = many
    groups, slots, blocks = [], [], {}
    for name, capacity in caps.items():
        group_of, found, containers = _plan(counts[name], capacity)
        groups += [(name, s, g) for s, g in group_of.items()]
        slots += [(name, *x) for x in found]
        small = sum(n for s, n in counts[name].items() if s not in group_of)
        blocks[name] = max(1, -(-(containers + small // SMALL) // BLOCK))
    runs = max(1, -(-sum(sum(c.values()) for c in counts.values()) // RUN))
    # One row per large size, at most the sum of the capacities; slots: groups times patterns.
    group = spark.createDataFrame(groups, "limit_name string, n_tokens long, grp int")
    slot = spark.createDataFrame(slots, "limit_name string, grp int, first long, last long, per long, base long")
    block_of = lambda what: F.pmod(F.xxhash64(*what), F.element_at(F.create_map(*(x for n, b in blocks.items() for x in (F.lit(n), F.lit(b).cast("long")))), F.col("limit_name")))

    marked = items.join(F.broadcast(group), ["limit_name", "n_tokens"], "left").withColumn("run", F.pmod(F.xxhash64("doc_id", "part"), F.lit(runs).cast("long")))
    large = marked.where("grp is not null")
    numbered = large.withColumn("i", F.row_number().over(Window.partitionBy("limit_name", "grp", "run").orderBy("doc_id", "part")))
    before = F.sum("many").over(Window.partitionBy("limit_name", "grp").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = large.groupBy("limit_name", "grp", "run").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(before, F.lit(0))).drop("many")
    placed = numbered.join(offsets, ["limit_name", "grp", "run"]).withColumn("i", F.col("i") - 1 + F.col("before"))
    placed = placed.join(F.broadcast(slot), ["limit_name", "grp"]).where("i >= first and i < last")
    placed = placed.withColumn("number", F.col("base") + F.floor((F.col("i") - F.col("first")) / F.col("per")))
    columns = ["limit_name", "block", "container", "doc_id", "part", "start_token", "n_tokens"]
    placed = placed.withColumn("container", F.concat(F.lit("c"), "number")).withColumn("block", block_of(["number"])).select(columns)
    loose = marked.where("grp is null").withColumn("container", F.lit(None).cast("string")).withColumn("block", block_of(["doc_id", "part"])).select(columns)
    kind = sizes.schema["doc_id"].dataType.simpleString()
    packed = placed.unionByName(loose).groupBy("limit_name", "block").applyInArrow(_fill(caps), f"limit_name string, container string, doc_id {kind}, part int, start_token long, n_tokens long")
    return full.unionByName(packed)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, items, tokens and the share of the room that is used."""
    room = F.broadcast(limits.select("limit_name", F.col("max_tokens").cast("long").alias("capacity")))
    boxes = packed.groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return boxes.join(room, "limit_name").groupBy("limit_name", "capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill"), F.max("tokens").alias("fullest")
    )
