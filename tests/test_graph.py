"""Traversal, lookup and write operators on small graphs."""

import random

import pytest

from codeloom.graph import Graph
from codeloom.operators import dml
from codeloom.operators.lookup import lookup
from codeloom.operators.skew import lookup_join
from codeloom.operators.traverse import callees, callers, impact

NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, seq int"
EDGE = "source string, target string, kind string, line int"


def make(spark, edges, kinds=None):
    kinds = kinds or {}
    ids = sorted({x for e in edges for x in e[:2]} | set(kinds))
    nodes = [(i, kinds.get(i, "method"), i, i, f"{i}.java", 1, 0) for i in ids]
    full = [(e[0], e[1], e[2] if len(e) > 2 else "calls", None) for e in edges]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(full, EDGE))


def ids(df):
    return {r.id for r in df.collect()}


def test_callers_minimum_distance(spark):
    g = make(spark, [("x", "t"), ("y", "x"), ("y", "t"), ("z", "y")])
    assert ids(callers(g, "t", 2)) == {"x", "y", "z"}
    assert ids(callers(g, "t", 1)) == {"x", "y"}


def test_container(spark):
    g = make(spark, [("C", "m1", "contains"), ("C", "m2", "contains"), ("m2", "m1"), ("k", "m2")], {"C": "class"})
    assert ids(callers(g, "C", 1)) == {"m2", "k"}
    result = impact(g, "C", 3)
    assert {(r.id, r.distance) for r in result.nodes.collect()} == {("C", 0), ("m1", 0), ("m2", 0), ("k", 1)}
    assert result.edges.count() == 4


def test_depths_cycles_and_misses(spark):
    chain = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert ids(impact(chain, "e", 3).nodes) == {"e", "d", "c", "b"}
    assert ids(callees(chain, "a", 2)) == {"b", "c"}
    assert ids(callers(make(spark, [("a", "b"), ("b", "a"), ("a", "a")]), "a", 5)) == {"b"}
    assert ids(impact(chain, "nope").nodes) == set() and impact(chain, "nope").edges.count() == 0
    g = make(spark, [("r", "m", "decorates"), ("u", "m"), ("K", "m", "contains")], {"K": "class", "r": "route"})
    assert ids(callers(g, "m", 1)) == {"u"} and ids(impact(g, "m", 1).nodes) == {"m", "r", "u"}
    assert ids(impact(make(spark, [("N", "K", "contains"), ("K", "m", "contains")], {"N": "namespace", "K": "class"}), "N").nodes) == {"N"}


@pytest.mark.parametrize("broadcast", ["500000", "0"])
def test_random_impact(spark, broadcast):
    spark.conf.set("spark.codeloom.broadcastRows", broadcast)
    spark.conf.set("spark.codeloom.hotKeyRows", "3")
    try:
        rng = random.Random(3)
        names = [f"n{i}" for i in range(14)]
        kinds = {n: rng.choice(["class", "method", "method"]) for n in names}
        edges = list({(rng.choice(names), rng.choice(names), rng.choice(["calls", "contains", "uses"])) for _ in range(30)})
        seen, frontier = {"n0": 0}, {("n0", 0)}
        while frontier:
            nxt = set()
            for node, d in frontier:
                if d < 3:
                    for s, t, k in edges:
                        if k == "contains" and s == node and kinds[node] == "class":
                            nxt.add((t, d))
                        if k != "contains" and t == node:
                            nxt.add((s, d + 1))
            frontier = {(n, d) for n, d in nxt if d < seen.get(n, 99)}
            for n, d in frontier:
                seen[n] = min(d, seen.get(n, 99))
        got = {r.id: r.distance for r in impact(make(spark, edges, kinds), "n0", 3).nodes.collect()}
        assert got == seen
    finally:
        spark.conf.unset("spark.codeloom.broadcastRows")
        spark.conf.unset("spark.codeloom.hotKeyRows")


def test_lookup_join_on_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(400)]
    left = spark.createDataFrame(rows, "i int, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3)], "key string, v int")
    spark.conf.set("spark.codeloom.hotKeyRows", "20")
    try:
        for how in ("left", "inner"):
            got = sorted(map(tuple, lookup_join(left, right, ["key"], how).select("i", "v").collect()))
            assert got == sorted(map(tuple, left.join(right, "key", how).select("i", "v").collect()))
    finally:
        spark.conf.unset("spark.codeloom.hotKeyRows")


def test_edges_are_checked_and_unique(spark):
    g = make(spark, [("a", "b"), ("a", "b")])
    more = spark.createDataFrame([("a", "ghost", "calls", None)], EDGE)
    assert g.with_edges(more).edges.count() == 1
    assert dml.filter_dangling(more, g.nodes).count() == 0


def test_lookup_tiers(spark):
    rows = [("import:1234567", "import", "com.x.Foo", "p::com.x.Foo", "a.java", 1, 0), ("class:12345678", "class", "Foo", "com.x::Foo", "b.java", 9, 0),
            ("method:1234567", "method", "bar", "com.x::Foo::bar", "b.java", 10, 1), ("field:12345678", "field", "Foo", "q::Foo", "a.java", 2, 1)]
    nodes = spark.createDataFrame(rows, NODE)
    find = lambda s: [r.id for r in lookup(nodes, s).collect()]
    assert find("com.x.Foo") == ["class:12345678"] and find("com.x.Foo.bar") == ["method:1234567"]
    assert find("Foo.bar") == ["method:1234567"] and find("Foo") == ["class:12345678"] and find("FOO") == ["class:12345678"]
    assert find("field:12345678") == ["field:12345678"] and find("zip") == []


def test_upsert_and_failed(spark):
    a = spark.createDataFrame([("p", 1, "old")], "path string, at int, v string")
    b = spark.createDataFrame([("p", 1, "new"), ("q", 1, "x")], "path string, at int, v string")
    assert sorted(map(tuple, dml.upsert(a, b, ["path"], "at").collect())) == [("p", 1, "new"), ("q", 1, "x")]
    refs = spark.createDataFrame([("1", "nope.zip", "pending", None)], "ref_id string, reference_name string, status string, name_tail string")
    assert tuple(dml.mark_failed(refs, refs.select("ref_id")).first())[2:] == ("failed", "zip")
    bad = spark.createDataFrame([("", "class", "n", None, "f", "java"), ("i", "class", "n", None, "f", "java")],
                                "id string, kind string, name string, qualified_name string, file_path string, language string")
    assert [tuple(r)[:4] for r in dml.valid_nodes(bad).collect()] == [("i", "class", "n", "n")]


def test_derived_edges_of_a_walk_are_made_once(spark, monkeypatch):
    from codeloom.operators import traverse
    from codeloom.sources.tables import order_graph

    calls, made = [], traverse._containment
    monkeypatch.setattr(traverse, "_containment", lambda g: calls.append(g) or made(g))
    graph = order_graph(spark, "/root/testdata/sf0.001")
    got = traverse.impact(graph, "class:3", 2).edges.collect()
    assert len(calls) == 1
    assert sorted(map(str, got)) == sorted(map(str, traverse.impact(graph.store(), "class:3", 2).edges.collect()))


def test_impact_of_a_stored_graph_copies_no_other_edges(spark, monkeypatch):
    from codeloom.operators import traverse
    from codeloom.sources.tables import order_graph

    graph = order_graph(spark, "/root/testdata/sf0.001")
    want = {tuple(r) for r in traverse.impact(graph, "class:3").ids.collect()}
    graph = graph.store()
    real, kinds = traverse.cut, set()

    def seen(df):
        out = real(df)
        kinds.update(r.kind for r in out[0].select("kind").distinct().collect()) if "kind" in df.columns else None
        assert not {"src", "dst"} <= set(df.columns)
        return out

    monkeypatch.setattr(traverse, "cut", seen)
    assert {tuple(r) for r in traverse.impact(graph, "class:3").ids.collect()} == want and kinds == {"contains"}


def test_explore_makes_each_list_once(spark):
    from codeloom.plans.explore import explore
    from codeloom.sources.tables import order_graph

    sections = explore(order_graph(spark, "/root/testdata/sf0.001"), "NATION_3", spark.range(10))
    assert sections.count() and "Join" not in sections._jdf.queryExecution().optimizedPlan().toString()
