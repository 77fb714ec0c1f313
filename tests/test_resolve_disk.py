"""Shuffle files of stored tables and tables that only resolution needs do not stay on disk."""

import os
import time

from pyspark.sql import functions as F

from codeloom.plans import resolve as rs
from codeloom.session import DROP_SHUFFLES, cut, shared_dir
from registry.resolve_queries import fixture


def shuffles(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_of_a_stored_table_are_dropped(spark):
    held, was = shuffles(spark), spark.conf.get(DROP_SHUFFLES)
    table, n = cut(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        left = shuffles(spark) - held
        if not left:
            break
        time.sleep(0.1)
    assert n == 7 and table.count() == 7 and not left and spark.conf.get(DROP_SHUFFLES) == was


def test_resolution_leaves_what_it_returns(spark):
    graph = fixture(spark, "/root/testdata/sf0.001")
    folder = shared_dir(spark).removeprefix("file:")

    def tables() -> set[str]:
        return {f for f in os.listdir(folder) if f.startswith("codeloom-") and not f.endswith(".zip")}

    held = tables()
    found = rs.resolve(graph)
    assert len(tables() - held) == 2
    assert found.resolved.count() + found.refs.count() == graph.ref_rows and found.edges.count() > 0


def test_references_without_id_or_with_one_id_are_kept_apart(spark):
    """Looked up by row, not by ``ref_id``, which may be null or repeat."""
    nodes = spark.createDataFrame(
        [("c", "class", "A", "p::A", "A.java", 1, None), ("m", "method", "go", "p::A::go", "A.java", 2, None),
         ("v", "variable", "x", "p::A::go::x", "A.java", 3, "B"), ("b", "class", "B", "p::B", "B.java", 1, None),
         ("r", "method", "run", "p::B::run", "B.java", 2, None), ("o", "method", "run", "p::O::run", "A0.java", 1, None)],
        "id string, kind string, name string, qualified_name string, file_path string, seq int, return_type string")
    edges = spark.createDataFrame([("c", "m", "contains"), ("b", "r", "contains")], "source string, target string, kind string")
    refs = spark.createDataFrame(
        [(i, "m", "A.java", "calls", name, line) for i, name, line in
         [(None, "x.run", 1), (None, "go", 2), ("q", "x.run", 3), ("q", "run", 4), ("q", "nothing", 5)]],
        "ref_id string, from_node_id string, file_path string, reference_kind string, reference_name string, line int")
    refs = refs.selectExpr("*", "cast(null as int) col", "'java' language", "'pending' status", "cast(null as string) name_tail")
    found = rs.resolve(rs.Graph(nodes, edges, refs), keep_self_loops=True).resolved.collect()
    assert {(r.line, r.target, r.resolved_by) for r in found} == {
        (1, "r", "inferred-method-call"), (2, "m", "exact-match"), (3, "r", "inferred-method-call"), (4, "o", "cross-file-match")}
    assert len(found) == 4
