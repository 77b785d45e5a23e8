import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chains as c
from loomgraph.operators import evaluate as e


def one(spark, ddl, row, *cols):
    return list(spark.createDataFrame([row], ddl).select(*cols).first())


def test_chains_in_order():
    assert c.order_chains([0, 1, 2], [(1, 0)]) == [[0, 1]]
    assert c.order_chains([0, 1, 2, 3], [(3, 1), (3, 0), (1, 0)]) == [[0, 1, 3]]
    assert c.order_chains([0, 1], []) == []
    assert c.order_chains([0, 1, 2], [(0, 1), (1, 0), (2, 0)]) == [[]]
    assert c.order_chains([1], [(1, 0)]) == [[0, 1]]


def test_reasoning_chains(spark):
    steps = [(1, 0, "Who?", True), (1, 1, "Where is <ENTITY_Q1>?", True), (1, 2, "When?", True), (2, 0, "A?", True), (2, 1, "<ENTITY_Q9>", True), (3, 0, "x", False)]
    df = spark.createDataFrame(steps, "question_id long, q_idx int, template string, requires_retrieval boolean")
    assert [tuple(x) for x in c.reasoning_chains(df).collect()] == [(1, 0, [0, 1])]


def test_substitution(spark):
    ddl = "t string, b map<int,string>"
    sub = c.substitute(F.col("t"), F.col("b"))
    assert one(spark, ddl, ("of <ENTITY_Q1> and <ENTITY_Q2>, <ENTITY>", {1: "A", 2: "B"}), sub) == ["of A and B, B"]
    assert one(spark, ddl, ("of <ENTITY_Q1>", {}), sub) == ["of <ENTITY_Q1>"]


def test_scores(spark):
    ddl = "s array<double>"
    assert one(spark, ddl, ([1.0, 0.0],), c.cumulative(F.col("s")))[0] == pytest.approx(math.sqrt(0.5))
    assert one(spark, ddl, ([],), c.cumulative(F.col("s")))[0] == pytest.approx(1e-6)
    assert one(spark, ddl, ([0.5, 1.0],), c.harmonic(F.col("s")))[0] == pytest.approx(2 / 3)
    assert one(spark, ddl, ([0.0],), c.harmonic(F.col("s")))[0] == pytest.approx(1e-6)
    with pytest.raises(ValueError):
        c.chain_score("other", F.lit(1.0), F.lit(1.0))


def test_prune_ties(spark):
    rows = [(1, "a", 0.5, 0.1, 1), (1, "b", 0.5, 0.9, 2), (1, "c", 0.5, 0.9, 0), (1, "d", 0.4, 1.0, 3)]
    df = spark.createDataFrame(rows, "q long, e string, chain_score double, last_hop double, tie long")
    assert [x.e for x in c.prune(df, "q", 3, "tie").orderBy("rank").collect()] == ["c", "b", "a"]


def test_multi_hop_against_brute_force(spark):
    rnd = random.Random(5)
    names = "abcdef"
    facts = sorted({(rnd.choice(names), f"q{rnd.randrange(12)}", rnd.choice(["who sold it", "who was it", "when"]), rnd.choice(names)) for _ in range(40)})
    start = [(i, rnd.choice(names), "Who sold it") for i in range(6)]
    got = {}
    for x in c.multi_hop(spark.createDataFrame(start, "question_id long, entity_id string, asked string"), spark.createDataFrame(facts, "entity_id string, q_id string, question string, next_entity string"), 2, 3).collect():
        got.setdefault((x.question_id, x.hop), []).append((x.rank, x.entity_id, x.chain_score, x.evidence))
    for q, ent, asked in start:
        beam = [(ent, [], [])]
        for hop in (1, 2):
            best = {}
            for at, ev, sc in beam:
                for a, qid, text, nxt in facts:
                    if a == at and nxt != a and qid not in ev:
                        s = round(len(set(asked.lower().split()) & set(text.split())) / 3, 6)
                        scores = [*sc, s]
                        chain = round(math.exp(sum(math.log(0.5 * (x + 1)) for x in scores) / len(scores)), 6)
                        key = (-chain, -s, " ".join([*ev, qid]))
                        if nxt not in best or key < best[nxt][0]:
                            best[nxt] = (key, [*ev, qid], scores)
            order = sorted(best, key=lambda n: (best[n][0][0], best[n][0][1], n))[:3]
            want = [(i + 1, n, -best[n][0][0], " ".join(best[n][1])) for i, n in enumerate(order)]
            have = sorted(got.get((q, hop), []))
            assert [(x[0], x[1], x[3]) for x in have] == [(x[0], x[1], x[3]) for x in want]
            assert [x[2] for x in have] == pytest.approx([x[2] for x in want], abs=2e-6)
            beam = [(n, best[n][1], best[n][2]) for n in order]


def test_answers_are_extracted(spark):
    for text, want in (("x Answer: 1862.", "1862"), ("Answer: Paris.", "Paris."), ("no mark", "no mark"), ("Answer: a Answer: 1, 2.\n", "1, 2"), ("Answer: .", ".")):
        assert one(spark, "t string", (text,), c.extract_answer(F.col("t"))) == [want]


@pytest.mark.parametrize("pred,golds,em,f1", [("beatles", ["The Beatles"], 1, 1), ("a", ["the"], 1, 0), ("b c", ["a b b c"], 0, 0.8), ("x", [], 0, 0), ("x y", ["z", "x"], 0, 2 / 3), ("", ["x"], 0, 0)])
def test_em_and_f1(spark, pred, golds, em, f1):
    got = one(spark, "p string, g array<string>", (pred, golds), e.exact_match(F.col("p"), F.col("g")), e.token_f1(F.col("p"), F.col("g")))
    assert got == pytest.approx([em, f1])


def test_judged_cases(spark):
    rows = [(0, 0, 0.0), (2, 0, 0.0), (0, 3, 0.0), (2, 4, 1.0)]
    df = spark.createDataFrame(rows, "t int, f int, s double")
    got = [tuple(x) for x in df.select(*e.judged(F.col("t"), F.col("f"), F.col("s"))).collect()]
    assert got == [(1.0, 1.0, 1.0), (None, 0.0, 0.0), (0.0, 0.0, 0.0), (0.25, 0.5, round(1 / 3, 6))]


def test_comparison_over_a_base_of_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "system string, f1 double")
    assert tuple(e.compare_systems(df, "system", "f1", "a", "b").first()) == (0.0, 0.5, 0.5, None)
