"""Builds, incremental updates, snapshots, streams and git."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.plans import repository
from codeloom.plans import sync as sy
from codeloom.plans.explore import budget, explore, report
from codeloom.plans.search import search
from codeloom.sources import git, java_tree, snapshot
from codeloom.streaming.changes import follow
from tests.java_sources import SPRING

A = {
    "src/service/PayService.java": "package p.service;\npublic class PayService {\n    public void pay(int n) { }\n    void rest() { }\n}\n",
    "src/web/Shop.java": "package p.web;\nimport p.service.PayService;\n@Service public class Shop extends Base {\n    PayService svc;\n"
                         "    void buy() { svc.pay(1); PayService q = new PayService(); q.rest(); gone.fetch(); }\n    void open() { }\n}\n",
    "src/web/Base.java": "package p.web;\npublic class Base { void open() { help(); } void help() { } }\n",
    "src/Old.java": "class Old { void old() { new Shop().buy(); } }\n",
}
B = {
    "src/service/PayService.java": "package p.service;\n\npublic class PayService {\n    public void pay(int n) { }\n    void pause() { }\n}\n",
    "src/web/Shop.java": A["src/web/Shop.java"],
    "src/web/Base.java": A["src/web/Base.java"],
    "src/New.java": "class New { void fetch() { } }\n",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def shape(index):
    key = index.nodes.select("id", F.concat_ws("|", "file_path", "kind", "qualified_name").alias("k"))
    e = index.edges.join(key.withColumnRenamed("id", "source").withColumnRenamed("k", "s"), "source").join(
        key.withColumnRenamed("id", "target").withColumnRenamed("k", "t"), "target")
    return {r.k for r in key.collect()}, {(r.s, r.t, r.kind) for r in e.select("s", "t", "kind").collect()}, {
        (r.reference_name.split(".")[-1], r.status) for r in index.refs.collect()}


@pytest.fixture(scope="module")
def first(spark):
    return sy.build(frame(spark, A))


def test_incremental_equals_fresh_build(spark, first):
    updated = sy.reconcile(first, frame(spark, B))
    fresh = sy.build(frame(spark, B))
    assert shape(updated) == shape(fresh)
    assert first.files.count() == 4 and updated.files.count() == 4
    pay = [(s, t) for s, t, k in shape(updated)[1] if k == "calls" and t.endswith("PayService::pay")]
    assert len(pay) == 1  # the line shift gave ``pay`` a new id, the call followed it
    assert ("rest", "failed") in shape(updated)[2]
    assert any(k == "calls" and t.endswith("New::fetch") for _, t, k in shape(updated)[1])  # retried
    assert sy.reconcile(first, frame(spark, A)) is first


def test_counters_are_stored_with_the_version(spark, first, tmp_path):
    want = {"files_indexed": 4, "files_skipped": 0, "files_errored": 0, "nodes_created": first.nodes.count(),
            "edges_created": first.edges.filter("kind in ('contains', 'decorates')").count(), "edges_stored": first.edges.count()}
    assert first.counters() == want
    folder = str(tmp_path / "graph")
    snapshot.save(first, folder)
    loaded = snapshot.load(spark, folder)
    assert loaded.counters() == want and loaded.metadata[sy.LAST_INDEXED] == first.metadata[sy.LAST_INDEXED]
    more = frame(spark, {**A, "src/Blank.java": "", "src/Half.java": "class Half {"})
    updated = sy.apply_changes(loaded, more, loaded.files.select("path").filter("path = 'src/Old.java'"), oversized=2)
    assert updated.counters()["files_skipped"] == 2 and updated.counters()["nodes_created"] == updated.nodes.count()
    assert updated.counters()["files_indexed"] + updated.counters()["files_errored"] == updated.files.count()
    assert int(updated.metadata[sy.LAST_INDEXED]) >= int(loaded.metadata[sy.LAST_INDEXED])


def test_edges_of_first_build(first):
    _, edges, refs = shape(first)
    kinds = {k for _, _, k in edges}
    assert {"contains", "calls", "imports", "extends", "instantiates", "type_of", "overrides"} <= kinds
    assert ("fetch", "failed") in refs


def test_wiring(spark):
    index = sy.build(frame(spark, SPRING))
    name = {r.id: r.qualified_name for r in index.nodes.collect()}
    got = {(name[r.source], name[r.target], r.metadata["spring"]) for r in index.edges.filter("kind = 'uses'").collect()}
    assert ("com.acme.config::Wiring", "com.acme.other::B", "bean-param") in got
    assert ("com.acme::App", "com.acme.config::Wiring", "boot-context") in got
    assert ("com.acme::App", "com.acme.service::Use", "boot-context") in got
    assert ("com.acme.service::Use", "com.acme.config::Wiring", "bean-return") in got
    assert ("com.acme.impl::Impl", "com.acme.config::Wiring", "bean-implements") in got
    assert not any(s == t for s, t, _ in got)


def test_snapshot_and_queries(spark, first, tmp_path):
    folder = str(tmp_path / "graph")
    assert snapshot.current_version(spark, folder) == 0
    assert snapshot.save(first, folder) == 1 and snapshot.save(first, folder) == 2
    index = snapshot.load(spark, folder)
    assert shape(index) == shape(first)
    # A save that died leaves a folder, or an entry without content: neither is read, neither blocks the next save.
    (tmp_path / "graph" / "data-dead" / "nodes").mkdir(parents=True)
    (tmp_path / "graph" / "log" / "00000003").touch()
    assert snapshot.current_version(spark, folder) == 2 and snapshot.save(first, folder) == 4
    index = snapshot.load(spark, folder)
    assert index.rows["nodes"] == index.nodes.count() and index.graph().stored
    graph = index.graph()
    assert [r.name for r in search(graph, "pay*").collect()][:1] != []
    sections = explore(graph, "PayService", index.files)
    names = {(r.section, r.name) for r in sections.collect()}
    assert {("focal", "PayService"), ("callers", "buy"), ("ancestor", "p.service")} <= names
    text = report(sections, frame(spark, A), graph.nodes, budget(index.files).first())
    assert "## Focal" in text and "public class PayService" in text
    assert {r.section for r in explore(graph, "payServ", index.files).collect()} == {"candidates"}


def test_scan(spark, tmp_path):
    for path, text in {"a/A.java": "class A { }", "build/B.java": "x", ".hid/C.java": "x", "gen/D.java": "x", "a/big.java": "y" * (2 * 1024 * 1024 + 1),
                       "note.txt": "n", ".gitignore": "# no\ngen/\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "a" / "bad.java").write_bytes(b"class \xff Bad { @Service }")
    root = str(tmp_path)
    got = {r.path: r.text for r in java_tree.scan(spark, root).collect()}
    assert got == {"a/A.java": "class A { }", "a/bad.java": "class  Bad { @Service }"}
    assert [r.path for r in java_tree.skipped(spark, root).collect()] == ["a/big.java"]
    routes = {r.path: (r.route, r.severity) for r in java_tree.routed(spark, root).collect()}
    assert routes == {"a/A.java": ("parsed", None), "a/bad.java": ("undecodable", "warning"), "a/big.java": ("oversized", "warning"),
                      "note.txt": ("unsupported", "error")}
    assert java_tree.routed(spark, root).filter("route in ('parsed', 'undecodable')").count() == len(got)
    assert java_tree.detect_frameworks(spark, root, java_tree.scan(spark, root)) == ["spring"]
    assert java_tree.detect_frameworks(spark, None, frame(spark, {"x": "class X"})) == []
    (tmp_path / "pom.xml").write_text("<a>spring-boot</a>")
    assert java_tree.detect_frameworks(spark, root, frame(spark, {"x": "class X"})) == ["spring"]


def test_stream(spark, tmp_path):
    changes, folder = str(tmp_path / "changes"), str(tmp_path / "graph")
    rows = [("A", p, t, 1) for p, t in A.items()]
    spark.createDataFrame(rows, "status string, path string, text string, at long").coalesce(1).write.parquet(changes)
    follow(spark, changes, folder, str(tmp_path / "ck"), once=True).awaitTermination()
    huge = "class Huge { /* " + "x" * (2 * 1024 * 1024) + " */ }"
    later = [("A", "src/Huge.java", huge, 2)] + [("M", p, B[p], 2) for p in ("src/service/PayService.java",)] + [("A", "src/New.java", B["src/New.java"], 2), ("D", "src/Old.java", None, 2)]
    spark.createDataFrame(later, "status string, path string, text string, at long").coalesce(1).write.mode("append").parquet(changes)
    follow(spark, changes, folder, str(tmp_path / "ck"), once=True).awaitTermination()
    assert snapshot.current_version(spark, folder) == 2
    assert shape(snapshot.load(spark, folder)) == shape(sy.build(frame(spark, B)))
    assert snapshot.load(spark, folder).metadata["oversized_in_last_batch"] == "1"


def test_git_sync(spark, tmp_path):
    root, folder = tmp_path / "repo", str(tmp_path / "graph")

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def write(files):
        for path, text in files.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(text)

    root.mkdir()
    assert git.current_commit(str(root)) is None
    run("init")
    write(A)
    run("add", "-A")
    run("commit", "-m", "a")
    assert repository.sync(spark, str(root), folder) == "full"
    assert repository.sync(spark, str(root), folder) == "none"
    run("rm", "-q", "src/Old.java")
    write(B)
    run("add", "-A")
    run("commit", "-m", "b")
    assert repository.sync(spark, str(root), folder) == "incremental"
    assert shape(snapshot.load(spark, folder)) == shape(sy.build(frame(spark, B)))
    assert git.branch_name(str(root))
    assert git.change_rows("M\ta\nR100\tb\tc\nD\td") == [("M", "a"), ("D", "b"), ("A", "c"), ("D", "d")]
