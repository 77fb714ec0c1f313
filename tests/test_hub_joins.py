"""Checks of edge ends and cascades where one node owns most edges, with every key forced to be hot."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import dml, skew
from codeloom.operators.skew import ends_join
from codeloom.session import cut

HUB = 4000


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame([(f"n{i}", "class", f"N{i}", f"f{i % 5}") for i in range(200)], "id string, kind string, name string, file_path string")
    rows = [(f"n{i % 210}", "n1" if i < HUB else f"n{i % 230}", "calls", i) for i in range(HUB + 600)]
    rows += [("n1", f"n{i % 250}", "uses", i) for i in range(1500)] + [(None, "n1", "calls", 0), ("n1", None, "calls", 0)]
    return nodes, spark.createDataFrame(rows, "source string, target string, kind string, line int")


@pytest.fixture(params=["shuffled", "broadcast"])
def sizes(spark, request):
    hot = {"spark.codeloom.hotKeyRows": "10", "spark.codeloom.broadcastRows": "0" if request.param == "shuffled" else "500000"}
    for k, v in hot.items():
        spark.conf.set(k, v)
    yield request.param
    for k in hot:
        spark.conf.unset(k)


def rows(df):
    return sorted(map(str, df.collect()))


def test_ends_and_cascade(spark, tables, sizes):
    nodes, edges = tables
    path = {r.id: r.file_path for r in nodes.collect()}
    all_edges = edges.collect()
    assert rows(dml.filter_dangling(edges, nodes)) == sorted(str(e) for e in all_edges if e.source in path and e.target in path)
    gone = spark.createDataFrame([("f2",), ("f3",), ("f2",)], "file_path string")
    refs = edges.select(F.col("source").alias("from_node_id"), "line")
    dead = {i for i, p in path.items() if p in ("f2", "f3")}
    left, kept, kept_refs = dml.delete_files(nodes, edges, refs, gone)
    assert rows(kept) == sorted(str(e) for e in all_edges if e.source not in dead and e.target not in dead)
    assert left.count() == len(path) - len(dead) and kept_refs.count() == sum(e.source not in dead for e in all_edges)
    into = dml.cross_file_incoming(nodes, edges, spark.createDataFrame([("f1",)], "file_path string"))
    assert sorted((r.source, r.target, r.kind, r.line) for r in into.collect()) == sorted(
        (e.source, e.target, e.kind, e.line) for e in all_edges
        if path.get(e.target) == "f1" and path.get(e.source) not in (None, "f1"))


def test_no_task_holds_a_hub(spark, tables):
    nodes, edges = tables
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.codeloom.broadcastRows": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        most = {}
        for hot in (1_000_000, 10):
            spark.conf.set("spark.codeloom.hotKeyRows", str(hot))
            out = ends_join(edges, nodes, "left_semi", ends=("target",))
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            most[hot] = max(sizes)
        assert most[1_000_000] >= HUB * 0.9 and most[10] < sum(sizes) / 4
    finally:
        for k in [*conf, "spark.codeloom.hotKeyRows"]:
            spark.conf.unset(k)


def test_only_keys_of_full_buckets_are_counted(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(skew, "cut", lambda df: counted.append(df) or cut(df))
    edges = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("source")).union(
        spark.range(500).select(F.lit("hub").alias("source"))).union(spark.range(90).select(F.lit(None).cast("string").alias("source")))
    assert skew.hot_keys(edges, ["source"], 1000)[1] == 0 and len(counted) == 1
    hot, n = skew.hot_keys(edges, ["source"], 80)
    assert n == 2 and {(r.source, r._spread) for r in hot.collect()} == {("hub", 7), (None, 2)}


def test_targets_are_not_written_with_the_edges(spark, tables, sizes, monkeypatch):
    nodes, edges = tables
    written = []
    for module in (skew, dml):
        monkeypatch.setattr(module, "cut", lambda df: written.append(set(df.columns)) or cut(df))
    dml.cross_file_incoming(nodes, edges, spark.createDataFrame([("f1",)], "file_path string"))
    assert sum({"source", "target"} <= c for c in written) == 1
    assert not any({"source", "target_name"} <= c for c in written)
