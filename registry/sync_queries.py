"""Incremental operators and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import dml
from codeloom.plans import sync as sy
from codeloom.plans.explore import budget, explore
from codeloom.sources.tables import order_graph, table
from registry.graph_queries import EDGES_SQL, KINDS_CALL, KINDS_CONTAINER, NODES_SQL, impact_cte


def _changed(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("path"), "text")
    known = docs.filter(F.col("doc_id") % 13 != 5).select("path", dml.content_hash(F.col("text")).alias("content_hash"))
    now = docs.filter(F.col("doc_id") % 11 != 3).withColumn(
        "text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    touched = sy.changed_only(now, known).select("path", F.lit("touched").alias("status"))
    return touched.unionByName(known.join(now, "path", "left_anti").select("path", F.lit("deleted").alias("status")))


def _cascade(s, d):
    g = order_graph(s, d)
    refs = g.edges.filter(F.col("kind") == "uses").select(
        F.col("source").alias("from_node_id"), F.col("target").alias("reference_name"))
    paths = table(s, d, "nation").filter(F.col("n_regionkey") == 2).select(
        F.concat(F.lit("src/n"), "n_nationkey", F.lit(".java")).alias("file_path")).union(s.sql("SELECT 'src/economy.java'"))
    nodes, edges, left = dml.delete_files(g.nodes, g.edges, refs, paths)
    return (
        nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("node_"), "kind").alias("what"), "n")
        .unionByName(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edge_"), "kind").alias("what"), "n"))
        .unionByName(left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("refs").alias("what"), "n")))


CASCADE_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL},
gone AS (SELECT id FROM nodes WHERE file_path='src/economy.java' OR file_path IN (SELECT 'src/n'||n_nationkey||'.java' FROM nation WHERE n_regionkey=2))
SELECT 'node_'||kind AS what, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1
UNION ALL SELECT 'edge_'||kind, count(*) FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) GROUP BY 1
UNION ALL SELECT 'refs', count(*) FROM edges WHERE kind='uses' AND source NOT IN (SELECT id FROM gone)"""


def _upsert(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("path"), "doc_id", F.col("n_chars").alias("size"),
                                           (F.col("doc_id") % 50).alias("indexed_at"))
    newer = docs.withColumns({"size": F.col("size") + 1, "indexed_at": (F.col("doc_id") * 7) % 50,
                              "path": F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("new"), "doc_id")).otherwise(F.col("path"))})
    return dml.upsert(docs.drop("doc_id"), newer.drop("doc_id"), ["path"], "indexed_at")


UPSERT_SQL = """WITH a AS (SELECT 'doc'||doc_id AS path, n_chars AS size, doc_id % 50 AS indexed_at, 0 AS src FROM documents
 UNION ALL SELECT CASE WHEN doc_id % 9 = 0 THEN 'new' ELSE 'doc' END||doc_id, n_chars+1, (doc_id*7) % 50, 1 FROM documents)
SELECT path, size, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, src DESC) AS rn FROM a) WHERE rn=1"""


def _incoming(s, d):
    g = order_graph(s, d)
    paths = g.nodes.filter(F.col("kind") == "interface").select("file_path").distinct()
    return g, dml.cross_file_incoming(g.nodes, g.edges, paths)


def _resurrect(s, d):
    g, incoming = _incoming(s, d)
    parts = g.nodes.filter(F.col("kind") == "interface")
    renamed = parts.withColumns({
        "id": F.concat(F.lit("new:"), "seq"),
        "name": F.when(F.col("seq") % 5 == 0, F.concat("name", F.lit("X"))).otherwise(F.col("name"))})
    edges, refs = sy.resurrect(incoming, renamed)
    return edges.select("source", "target", "kind", "line").unionByName(refs.select(
        F.col("from_node_id").alias("source"), F.col("reference_name").alias("target"),
        F.concat(F.lit("pending "), "reference_kind").alias("kind"), "line"))


RESURRECT_SQL = f"""WITH {NODES_SQL}, {EDGES_SQL},
fresh AS (SELECT file_path, nname, min_by(nid, seq) AS nid FROM (SELECT file_path, seq, 'new:'||seq AS nid, name||CASE WHEN seq%5=0 THEN 'X' ELSE '' END AS nname
  FROM nodes WHERE kind='interface') GROUP BY 1,2)
SELECT e.source, coalesce(f.nid, t.name) AS target, CASE WHEN f.nid IS NULL THEN 'pending ' ELSE '' END||e.kind AS kind, e.line
FROM edges e JOIN nodes t ON t.id=e.target AND t.kind='interface' LEFT JOIN fresh f ON f.file_path=t.file_path AND f.nname=t.name"""


def _explore(symbol):
    def run(s, d):
        files = table(s, d, "documents")
        return explore(order_graph(s, d), symbol, files).select("section", "id", "name", "start_line", "total")
    return run


def explore_sql(seed: str) -> str:
    """Sections of a found symbol, from the parts' own SQL."""
    def walk(near: str, far: str) -> str:
        return f"""SELECT n.*, 1 AS distance FROM nodes n WHERE n.id<>'{seed}' AND n.id IN
 (SELECT e.{far} FROM edges e WHERE e.{near} IN (SELECT id FROM seeds) AND e.kind IN {KINDS_CALL} AND e.source<>e.target)"""
    def show(section: str, body: str, order: str, take: str) -> str:
        return f"""(SELECT '{section}' AS section, id, name, start_line, total FROM (SELECT *, count(*) OVER () AS total,
  row_number() OVER (ORDER BY {order}) AS rn FROM ({body})) WHERE rn<={take})"""
    by = "distance, file_path, seq, id"
    take = "(SELECT CASE WHEN count(*)<500 THEN 6 WHEN count(*)<5000 THEN 13 WHEN count(*)<15000 THEN 20 ELSE 26 END FROM documents)"
    return impact_cte(seed) + f""",
seeds AS (SELECT id FROM nodes WHERE id='{seed}' UNION SELECT m.id FROM edges e JOIN nodes f ON f.id=e.source JOIN nodes m ON m.id=e.target
  WHERE f.id='{seed}' AND f.kind IN {KINDS_CONTAINER} AND e.kind='contains' AND m.kind='method'),
ins AS ({walk('target', 'source')}), outs AS ({walk('source', 'target')}),
near AS (SELECT *, 0 AS turn FROM ins UNION ALL SELECT *, 1 FROM outs WHERE id NOT IN (SELECT id FROM ins))
{show('focal', f"SELECT * FROM nodes WHERE id='{seed}'", 'id', '1')}
UNION ALL {show('callers', 'SELECT * FROM ins', by, take)} UNION ALL {show('callees', 'SELECT * FROM outs', by, take)}
UNION ALL {show('impact', f"SELECT n.*, x.distance FROM reached x JOIN nodes n USING (id) WHERE id<>'{seed}'", by, take)}
UNION ALL {show('ancestor', f"SELECT n.* FROM nodes n JOIN edges e ON e.source=n.id WHERE e.kind='contains' AND e.target='{seed}'", 'id', '1')}
UNION ALL {show('related', 'SELECT * FROM near', 'turn, file_path, seq, id', '4')}"""


QUERIES = {
    "changed_files": (_changed, """WITH k AS (SELECT * FROM documents WHERE doc_id % 13 <> 5), n AS (SELECT doc_id, text||CASE WHEN doc_id%7=0 THEN '!' ELSE '' END AS text
  FROM documents WHERE doc_id % 11 <> 3)
 SELECT 'doc'||n.doc_id AS path, 'touched' AS status FROM n LEFT JOIN k USING (doc_id) WHERE k.text IS DISTINCT FROM n.text
 UNION ALL SELECT 'doc'||doc_id, 'deleted' FROM k WHERE doc_id NOT IN (SELECT doc_id FROM n)"""),
    "delete_cascade": (_cascade, CASCADE_SQL),
    "upsert_files": (_upsert, UPSERT_SQL),
    "cross_file_edges": (
        lambda s, d: _incoming(s, d)[1].select("source", "target", "kind", "target_kind", "target_name"),
        f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT e.source, e.target, e.kind, t.kind AS target_kind, t.name AS target_name FROM edges e
 JOIN nodes t ON t.id=e.target JOIN nodes x ON x.id=e.source WHERE t.kind='interface' AND x.file_path<>t.file_path"""),
    "resurrect_edges": (_resurrect, RESURRECT_SQL),
    "explore_budget": (lambda s, d: budget(table(s, d, "documents")), """SELECT count(*) AS file_count,
 CASE WHEN count(*)<500 THEN 20 WHEN count(*)<5000 THEN 40 WHEN count(*)<15000 THEN 60 ELSE 80 END AS max_nodes,
 CASE WHEN count(*)<500 THEN 8000 WHEN count(*)<5000 THEN 15000 WHEN count(*)<15000 THEN 20000 ELSE 25000 END AS max_chars,
 CASE WHEN count(*)<500 THEN 1 WHEN count(*)<5000 THEN 2 WHEN count(*)<15000 THEN 3 WHEN count(*)<25000 THEN 4 ELSE 5 END AS calls FROM documents"""),
    "explore_summary": (_explore("NATION_3"), explore_sql("class:3")),
    "explore_miss": (_explore("redWidget"), f"""WITH {NODES_SQL},
 hit AS (SELECT *, contains(lower(name),'red')::INT + contains(lower(name),'widget')::INT AS n FROM nodes WHERE kind='interface' AND (contains(name,'Red') OR contains(name,'Widget')))
 SELECT 'candidates' AS section, id, name, start_line, least((SELECT count(*) FROM hit), 8) AS total FROM (SELECT * FROM hit ORDER BY round(n*0.2+0.4,6) DESC, file_path, seq, id LIMIT 8)"""),
}
