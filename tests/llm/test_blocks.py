"""Candidates of the linkage: their number grows with the names, and planted things are found."""

import random

from pyspark.sql import functions as F

from loomgraph.llm import linkage as li
from loomgraph.session import Scratch


def names(spark, n, seed):
    rnd = random.Random(seed)
    common = [f"{a}{b}{c}" for a in ("bar", "kel", "tor", "min") for b in ("an", "os", "il") for c in ("dek", "sum", "vor", "lin")]
    rows = [("d1", sorted(rnd.sample(common, rnd.choice((1, 2, 3, 3, 3))))) for _ in range(n)]
    return spark.createDataFrame(rows, "doc string, words array<string>").withColumn("nm", F.array_join("words", " "))


def test_candidates_grow_with_the_names(spark):
    """Every word is common: however many names there are, a name has at most a block's edges per pair of its words, besides those of single words."""
    edges = []
    for n in (150, 1_500, 15_000):
        left, right = names(spark, n, 1), names(spark, n, 2)
        scratch = Scratch(spark, "test")
        rarity = left.select("nm", "words").unionByName(right.select("nm", "words")).dropDuplicates(["nm"]).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        distinct = lambda df: df.select("nm", "words").dropDuplicates(["nm"])
        members = li._word_blocks(scratch, distinct(left), distinct(right), rarity, float(n)).cache()
        found = members.where("side = 0").selectExpr("key", "nm as left_nm").join(members.where("side = 1").selectExpr("key", "nm as right_nm"), "key").select("left_nm", "right_nm").distinct().cache()
        count = distinct(left).count() + distinct(right).count()
        edges.append(found.count() / count)
        # All pairs of which one name holds the other are among the edges.
        want = distinct(left).selectExpr("nm as left_nm", "words as lw").crossJoin(distinct(right).selectExpr("nm as right_nm", "words as rw")).where("size(array_except(lw, rw)) = 0 or size(array_except(rw, lw)) = 0").select("left_nm", "right_nm")
        assert n > 1_500 or want.join(found, ["left_nm", "right_nm"], "left_anti").count() == 0
        found.unpersist()
    assert max(edges) < 3 * li.BLOCK, edges


def test_planted_things_are_found(spark):
    """Things in texts under spellings with a slip, a title or a part missing; the pairs are known."""
    rnd = random.Random(5)
    part = lambda: "".join(rnd.choice(("ba", "ke", "lo", "mi", "nu", "ra", "so", "te", "vi", "zu")) for _ in range(4))
    left, right, truth = [], [], set()
    for i in range(300):
        first, last = part(), part()
        doc = 1_000 + i // 6
        facts = [(f"role {i % 23}", [f"state {i}", f"state {i + 7}"], f"{doc}_0"), (f"role {i % 17 + 30}", [f"other {i}"], f"{doc}_1")]
        for k in range(2):
            left.append((f"{doc}_{k}::e{i}", (f"{first} {last}", f"Mr {first} {last.upper()}")[k].title(), facts[: k + 1], f"{doc}_{k}"))
            truth.add((f"{doc}_{k}::e{i}", f"x{i}"))
        slip = last[:3] + last[4:] if i % 3 == 0 else last
        right.append((f"x{i}", (f"{first} {slip}", f"Dr {first} {slip}", f"{first.upper()} {slip}")[i % 3].title(), facts, None if i % 10 == 0 else f"{doc}_3"))
    kind = "name string, roles array<struct<role:string,states:array<string>,chunk_id:string>>, chunk_id string"
    got = li.link_entities(spark.createDataFrame(left, "id string, " + kind), spark.createDataFrame(right, "alt_id string, " + kind))
    found = {(r["id"], r["alt_id"]) for r in got.collect()}
    assert len(found & truth) >= 0.97 * len(truth) and len(found & truth) >= 0.97 * len(found)


def test_slips_in_large_blocks_of_a_text(spark):
    """More names than a block holds share beginning and end of a word; two letters of each are wrong."""
    rnd = random.Random(7)
    left, right, truth = [], [], set()
    for i in range(li.BLOCK + 15):
        mid = [rnd.choice("abcdefghiklmnoprstuv") for _ in range(8)]
        slip = [*mid[:2], "z", *mid[3:5], "y", *mid[6:]]
        facts = [(f"role {i}", [f"state {i}", f"other {i}"], "7_0"), (f"role {i + 100}", [f"more {i}"], "7_0")]
        left.append((f"7_0::e{i}", "Marle" + "".join(mid) + "stone", facts, "7_0"))
        right.append((f"x{i}", "Marle" + "".join(slip) + "stone", facts, "7_1"))
        truth.add((f"7_0::e{i}", f"x{i}"))
    kind = "name string, roles array<struct<role:string,states:array<string>,chunk_id:string>>, chunk_id string"
    got = li.link_entities(spark.createDataFrame(left, "id string, " + kind), spark.createDataFrame(right, "alt_id string, " + kind))
    assert {(r["id"], r["alt_id"]) for r in got.collect()} == truth
