from loomgraph.llm import linkage as li

ROLES = "roles array<struct<role:string,states:array<string>,chunk_id:string>>"
LEFT, RIGHT = f"id string, name string, {ROLES}, chunk_id string", f"alt_id string, name string, {ROLES}, chunk_id string"


def link(spark, a, b):
    return {(r.id, r.alt_id) for r in li.link_entities(spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT)).collect()}


def said(*cells):
    return [(role, states, None) for role, *states in cells]


def left(i, name, *cells):
    return (i, name, said(*cells), i.split("::")[0])


def test_part_of_a_name_in_an_unknown_text(spark):
    a = [left("1_0::e0", "Perrune Bamomegliberg", ("mayor", "ill"), ("baker", "late")), left("2_0::e0", "Kolvane Bamomegliberg", ("clerk", "ill")), left("3_0::e0", "Selvick Banunmar", ("heir", "absent"))]
    b = [("n1", "Bamomegliberg", said(("mayor", "ill"), ("baker",)), None), ("n2", "Dr. Banunmar", said(("heir", "absent")), None), ("n3", "Banunmar", said(("heir", "rich")), None)]
    assert link(spark, a, b) == {("1_0::e0", "n1"), ("3_0::e0", "n2")}


def test_whole_name_passes_to_parts_of_its_text(spark):
    a = [left("1_0::e0", "Selvick Banunmar", ("heir", "absent"), ("tenant",)), left("1_1::e0", "Banunmar", ("tenant",)), left("2_0::e0", "Banunmar", ("tenant",)), left("1_2::e0", "Jorlan Banunmar", ("tenant",))]
    assert link(spark, a, [("n1", "Selvick Banunmar", said(("heir", "absent")), None)]) == {("1_0::e0", "n1"), ("1_1::e0", "n1")}
