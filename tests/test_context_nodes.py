from pyspark.sql import functions as F

from loomgraph.operators import memory as m
from loomgraph.plans import graph


def test_many_sources_of_one_target(spark):
    nodes = spark.createDataFrame([("a", "1", {"1": "x"}, "x"), ("b", "2", {"1": "no", "2": "y"}, "y"), ("c", "3", {"2": "no", "3": "z"}, "z"), ("d", "3", {"3": "late"}, "late"), ("e", "5", {"5": "e"}, "e")], "node_id string, chunk_id string, name_history map<string,string>, current_name string")
    merges = spark.createDataFrame([("d", "a", 3), ("c", "a", 2), ("b", "a", 1), ("gone", "a", 0), ("b", "e", 9)], "source_id string, target_id string, place int")
    out = [(x.node_id, x.chunk_id, x.h, x.current_name) for x in m.merge_context_nodes(nodes, merges).withColumn("h", m.history_text(F.col("name_history"))).orderBy("node_id").collect()]
    assert out == [("a", "3", "Chunk1:x, Chunk2:y, Chunk3:z", "z"), ("e", "5", "Chunk5:e", "e")]
    edges = spark.createDataFrame([("p", "b"), ("p", "c"), ("q", "a"), ("q", "e"), ("r", "gone")], "entity_id string, node_id string")
    assert sorted(tuple(x) for x in m.redirect_edges(edges, nodes, merges).collect()) == [("p", "a"), ("q", "a"), ("q", "e"), ("r", "gone")]


def test_one_node_of_a_name_is_left(spark, sf):
    nodes, _ = graph._context(m.load(spark, sf))
    groups = m.load(spark, sf).entities.select("doc_id", graph.name_key("name").alias("k")).where("k is not null and k <> ''").distinct().count()
    assert graph.context_nodes_merged(spark, sf).count() == groups < nodes.count()
