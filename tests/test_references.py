import random

from loomgraph.operators.references import orphan_references

REFS = "target string, key string, ref_id long, ref_at long, salts int"
PARENTS = "target string, key string, arrived long, deleted long, side int"


def brute(refs, parents):
    known = {(t, k): (a, d) for t, k, a, d, _ in parents}
    out = []
    for t, k, i, at, _ in refs:
        if k is None:
            continue
        if (t, k) not in known:
            out.append((t, k, i, at, "missing"))
        elif at is not None:
            a, d = known[t, k]
            if a is not None and a > at:
                out.append((t, k, i, at, "late"))
            elif d is not None and d <= at:
                out.append((t, k, i, at, "deleted"))
    return sorted(out, key=str)


def found(spark, refs, parents, **more):
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), **more).collect()
    return sorted(((r.target, r.ref_key, r.ref_id, r.ref_at, r.reason) for r in got), key=str)


def test_reasons_against_brute_force(spark):
    rnd = random.Random(3)
    keys = ["", "a", "a\0", "é", "zz", "x" * 300, *(f"k{i}" for i in range(60))]
    parents = [(t, k, rnd.choice([None, 1, 5, 9]), rnd.choice([None, 2, 6]), 7) for t in ("p", "q") for k in keys if rnd.random() < 0.7]
    refs = [(rnd.choice("pqr"), rnd.choice([*keys, None]), i, rnd.choice([None, 0, 5, 10]), 3) for i in range(3000)]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_hot_key_is_salted_and_whole(spark):
    refs = [("p", "hot", i, i, 0) for i in range(2000)] + [("p", f"k{i}", i, 5, 0) for i in range(500)]
    parents = [("p", "hot", 1000, None, 0), ("p", "k3", None, 1, 0)]
    assert found(spark, refs, parents, hot_share=0.02) == brute(refs, parents)


def test_empty_sides(spark):
    one = [("p", "a", 1, 1, 0)]
    assert found(spark, [], [("p", "a", 1, None, 0)]) == []
    assert found(spark, one, []) == [("p", "a", 1, 1, "missing")]
    assert found(spark, [], []) == []
