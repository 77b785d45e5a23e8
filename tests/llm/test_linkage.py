from pyspark.sql import functions as F

from loomgraph.llm import linkage as li

ROLES = "roles array<struct<role:string,states:array<string>,chunk_id:string>>"
LEFT = f"id string, name string, {ROLES}, chunk_id string, card long, score double"
RIGHT = f"alt_id string, name string, {ROLES}, chunk_id string, words string"


def roles(*names):
    return [(n, [], None) for n in names]


def left(i, name, *r, chunk=None):
    return (i, name, roles(*r), chunk or i.split("::")[0], 1, 0.5)


def right(i, name, chunk, *r):
    return (i, name, roles(*r), chunk, "x")


def link(spark, a, b):
    return {(r.id, r.alt_id) for r in li.link_entities(spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT)).collect()}


PEOPLE = [
    left("1_0::e0", "Jorlan Phitortisk", "mayor", "baker"), left("1_1::e0", "Phitortisk", "mayor", "baker"), left("1_1::e1", "Kolvane Phitortisk", "clerk"), left("1_2::e0", "Phitortisk Ridge", "landmark"),
    left("2_0::e0", "Jorlan Phitortisk", "pilot", "tenant"), left("3_0::e0", "Selvick Banunmar", "heir"), left("3_1::e0", "Banunmar Medical Institute", "employer"),
    left("4_0::e0", None, "clerk"), left("4_0::e1", "", "clerk"), left("4_0::e2", "the of", "clerk"), ("5_0::e0", "Selvick Banunmar", None, None, 1, 0.5),
]


def test_spellings_in_one_text(spark):
    alts = [right("n1", "PHITORTISK, Jorlan", "1_3", "mayor"), right("n2", "Prof. Jorlan Phitotrisk", "1_0", "baker"), right("n3", "Banunmar Medical Inst.", "3_1", "employer"), right("n4", "Ridge of Phitortisk", "1_0")]
    got = link(spark, PEOPLE, alts)
    assert {("1_0::e0", "n1"), ("1_0::e0", "n2"), ("3_1::e0", "n3"), ("1_2::e0", "n4")} <= got
    assert not {i for i, a in got if a in ("n1", "n2")} - {"1_0::e0", "1_1::e0"}
    assert ("1_1::e0", "n1") in got


def test_relatives_and_namesakes_are_others(spark):
    alts = [right("n1", "Kolvane Phitortisk", "1_0", "clerk"), right("n2", "Jorlan Phitortisk", "2_0", "pilot"), right("n3", "Jorlan Phitortisk", None, "pilot", "tenant"), right("n4", "Tolvane Phitortisk", "1_0", "heir")]
    got = link(spark, PEOPLE, alts)
    assert {i for i, a in got if a == "n1"} == {"1_1::e1"}
    assert {i for i, a in got if a == "n2"} == {"2_0::e0"}
    assert {i for i, a in got if a == "n3"} == {"2_0::e0"}


def test_every_id_of_the_thing(spark):
    many = [left(f"7_{i}::e0", "Ixa Wotedal", "author") for i in range(5)] + [left("7_0::e0", "Ixa Wotedal", "author")]
    assert link(spark, many, [right("n1", "Ixa Wotedal", "7_0", "author"), right("n1", "Ixa Wotedal", "7_0", "author")]) == {(f"7_{i}::e0", "n1") for i in range(5)}


def test_empty_and_unusable(spark):
    assert link(spark, [], [right("n1", "A B", None)]) == set() and link(spark, PEOPLE, []) == set()
    assert link(spark, PEOPLE, [right("n1", None, "1_0"), right("n2", "", "1_0"), ("n3", "Mr.", None, None, "")]) == set()
    assert link(spark, [left("1_0::e0", "Ixa " + "long" * 5000)], [right("n1", "Ixa", "1_0")]) == set()


def test_words(spark):
    rows = [("The Captain Jorlan D. Févovunmar's,",), ("Glass Comp.",), ("Hestia-May O'Brien",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(li.name_words(F.col("n"))).collect()]
    assert got == [["fevovunmar", "jorlan"], ["comp.", "glass"], ["hestiamay", "obrien"]]


def test_repeated_rows_are_no_further_evidence(spark):
    a = [left("7_0::e0", "Ixa Wotedal", "author"), left("8_0::e0", "Ixa Wotedal", "clerk")]
    once, twice = [right("n1", "Ixa Wotedal", None, "author")], [right("n1", "Ixa Wotedal", None, "author")] * 3
    score = lambda b: {(r.id, r.alt_id, r.confidence) for r in li.link_entities(spark.createDataFrame(a * 2, LEFT), spark.createDataFrame(b, RIGHT)).collect()}
    one, more = score(once), score(twice)
    assert {x[:2] for x in one} == {x[:2] for x in more} == {("7_0::e0", "n1")}
