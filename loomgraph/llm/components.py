"""Groups of records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _trees(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Hook every component (c) onto another and collapse the trees: (c, root).

    Edges (a < b) are totally ordered by (a, b).  A component's smallest edge leads to its
    smallest neighbour, so hooking makes trees whose only cycles are pairs; the smaller of a pair
    is the root, and it is the smallest component of its tree.  Pointer doubling carries only
    components whose pointer isn't a root yet, so the many that point at one root don't meet again.
    """
    ends = edges.select(F.col("a").alias("c"), F.col("b").alias("p")).unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("p")))
    hook = scratch.cut(ends.groupBy("c").agg(F.min("p").alias("p")), f"{tag}-hook")
    up = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    # Two steps up; a pair c <-> p makes the smaller one a root.
    step = hook.join(up, "p").select(
        "c", F.when(F.col("pp") != F.col("c"), F.col("p")).otherwise(F.least("c", "p")).alias("p"), ((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))).alias("is_root")
    )
    state = scratch.cut(step, f"{tag}-0")
    roots = state.where("is_root").select(F.col("c").alias("p"), F.lit(True).alias("hit"))
    marked = state.join(roots, "p", "left")
    reached = marked.where("hit or is_root").select("c", F.col("p").alias("root"))
    active = scratch.cut(marked.where("hit is null and not is_root").select("c", "p"), f"{tag}-active-0")
    k = 0
    while not active.isEmpty():
        # A pointer at a component that is done jumps to its root; one at an active one jumps to its pointer.
        ends = reached.select(F.col("c").alias("p"), F.col("root").alias("to"), F.lit(True).alias("end"))
        jump = ends.unionByName(active.select(F.col("c").alias("p"), F.col("p").alias("to"), F.lit(False).alias("end")))
        moved = scratch.cut(active.join(jump, "p").select("c", "to", "end"), f"{tag}-moved-{k}")
        reached = reached.unionByName(moved.where("end").select("c", F.col("to").alias("root")))
        k += 1
        active = scratch.cut(moved.where("not end").select("c", F.col("to").alias("p")), f"{tag}-active-{k}")
    out = scratch.cut(reached, f"{tag}-roots")
    scratch.drop(f"{tag}-hook", f"{tag}-0", *(f"{tag}-{what}-{i}" for what in ("active", "moved") for i in range(k)), f"{tag}-active-{k}")
    return out


def connected_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """(group_id, id) for every id in a link; group_id is the smallest id, in byte order, of its group.

    ``links`` may hold repeated pairs in either order, pairs of an id with itself and nulls; the
    last two link nothing.  No links give an empty result.  Other columns are ignored.

    Deterministic Borůvka rounds: every component takes its smallest outgoing edge, the trees
    collapse, edges are relabelled and deduplicated, until none is left.  Components at least halve
    in each round.  Edges at a hub are combined before the shuffle where they are aggregated and
    meet one row where they are joined, so a hot id splits.
    """
    scratch = Scratch(links.sparkSession, "groups")
    a, b = F.col(left), F.col(right)
    edges = links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = scratch.cut(edges, "edges-0")
    maps, k = [], 0
    while not edges.isEmpty():
        roots = _trees(scratch, edges, f"round-{k}")
        maps.append(roots)
        x = edges.join(roots.select(F.col("c").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("c").alias("b"), F.col("root").alias("rb")), "b")
        x = x.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        k += 1
        edges = scratch.cut(x, f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
    if not maps:
        return edges.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    # Later rounds rename the roots of earlier ones: compose from the last, smallest map backwards.
    last = maps[-1]
    for m in maps[-2::-1]:
        renamed = m.select("c", F.col("root").alias("mid")).join(last.select(F.col("c").alias("mid"), F.col("root").alias("top")), "mid", "left")
        last = renamed.select("c", F.coalesce("top", "mid").alias("root"))
    return last.select(F.col("root").alias("group_id"), F.col("c").alias("id"))
