import random
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_groups
from loomgraph.llm.duplicates import canonical, collapse_formatting

DDL = "question_row long, text string, answers array<string>, n long, h string, copies int"


def canon(s):
    return "".join(c for c in s if not c.isspace() and not unicodedata.category(c).startswith("P")).replace("ß", "\ue000").upper().lower()


def brute(rows):
    groups = defaultdict(list)
    for i, t, a, *_ in rows:
        if a is not None and t is not None and t.strip():
            bag = sorted((x is None, canon(x) if x is not None else "") for x in a)
            groups[canon(t), tuple(bag)].append(i)
    return groups


def check(spark, rows):
    groups, members = collapse_formatting(spark.createDataFrame(rows, DDL), "question_row", "text", "answers")
    want = brute(rows)
    assert sorted((g.group_row, g.copies) for g in groups.collect()) == sorted((min(v), len(v)) for v in want.values())
    assert sorted(map(tuple, members.collect())) == sorted((min(v), i) for v in want.values() if len(v) > 1 for i in v)


def test_copies_against_brute_force(spark):
    rnd = random.Random(2)
    texts = ["Who sold it?", "who  sold it", "WHO SOLD IT？", "whö sold it", "?!", "…", "", " 　", None, "x" * 50_000, "X" * 50_000, "Straße", "STRASSE", "a b"]
    answers = [["a", "B"], ["b.", "A"], ["a", "a"], ["a"], [], None, [None], [None, "a"], ["É"], ["e"], [""], ["\u0000null"]]
    check(spark, [(i, rnd.choice(texts), rnd.choice(answers), 5, "x", 1) for i in range(900)])


def test_one_group_holds_a_third(spark):
    rows = [(i, "Who?" if i % 3 == 0 else f"q{i % 400}", ["a"], 1, "", 1) for i in range(3000)] + [(9000 + i, "wh o" + "!" * i, ["A"], 1, "", 1) for i in range(300)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None, None, 1, "", 1)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x1c\x1d\x1e\x1f\x00", exclude_categories=("Cs", "Cn", "Co")), max_size=6), min_size=1, max_size=20))
def test_canonical_drops_space_and_punctuation(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical(F.col("t"))).collect()]
    for t, g in zip(texts, got):
        known = [c for c in t if unicodedata.category(c) != "Cn"]
        assert not any(c.isspace() or unicodedata.category(c).startswith("P") for c in g)
        assert len(g) >= sum(not c.isspace() and not unicodedata.category(c).startswith("P") for c in known) - t.count("ͅ") - t.count("̇")


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((find(x), x) for x in up)


def groups(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in pairs], "left_id string, right_id string, a int, c string")
    return sorted(map(tuple, connected_groups(df, "left_id", "right_id").collect()))


def test_groups_of_random_links(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}") for _ in range(200)] + [("a", "a"), (None, "b"), ("c", None), ("é", "z"), ("z", "é")]
    assert groups(spark, pairs) == union_find(pairs)


def test_long_path_and_hub(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    path = [(f"p{order[i]:03}", f"p{order[i + 1]:03}") for i in range(199)] + [(f"m{i:03}", f"m{i + 1:03}") for i in range(60)]
    hub = [("hub", f"h{i}") for i in range(400)] * 2
    assert groups(spark, path + hub) == union_find(path + hub)


def test_no_links(spark):
    assert groups(spark, []) == [] and groups(spark, [("a", "a"), (None, None)]) == []
