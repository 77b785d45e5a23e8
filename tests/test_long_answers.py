from loomgraph.plans import retrieval


def test_long_answers_stay_whole(spark, tmp_path):
    rows = [(0, "Who?", ["TEXT:" + "x" * 1500]), (20, "When?", ["e1"]), (40, None, ["TEXT:a"])]
    spark.createDataFrame(rows, "question_row long, text string, answers array<string>").write.parquet(f"{tmp_path}/questions.parquet")
    got = {x.question_row: (x.answer, x.tokens) for x in retrieval.compiled_results(spark, str(tmp_path)).collect()}
    assert got == {0: ("x" * 1500, 375), 20: ("NA", 0)}
