"""Graph reads over the order-entry graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import dml
from codeloom.operators.lookup import lookup
from codeloom.operators.traverse import callees, callers, impact
from codeloom.sources.tables import order_graph, table

CAMEL = """array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1:1])||w[2:]),'')
 || upper(p_type[1:1])||lower(p_type[2:]) || '_' || replace(p_brand,'#','')"""

NODES_SQL = f"""
nodes AS (
 SELECT 'module:'||r_regionkey AS id, 'module' AS kind, r_name AS name, 'world::'||r_name AS qualified_name,
        'src/world.java' AS file_path, (r_regionkey % 1000 + 1)::INT AS start_line, r_regionkey::INT AS seq FROM region
 UNION ALL SELECT 'class:'||n_nationkey, 'class', n_name, 'world::'||n_name, 'src/world.java',
        (n_nationkey % 1000 + 1)::INT, n_nationkey::INT FROM nation
 UNION ALL SELECT 'method:'||c_custkey, 'method', c_name, 'n'||c_nationkey||'::'||c_name,
        'src/n'||c_nationkey||'.java', (c_custkey % 1000 + 1)::INT, c_custkey::INT FROM customer
 UNION ALL SELECT 'field:'||s_suppkey, 'field', s_name, 'n'||s_nationkey||'::'||s_name,
        'src/n'||s_nationkey||'.java', (s_suppkey % 1000 + 1)::INT, s_suppkey::INT FROM supplier
 UNION ALL SELECT 'route:'||o_orderkey, 'route', 'order_'||o_orderkey, 'orders::order_'||o_orderkey,
        'src/orders.java', (o_orderkey % 1000 + 1)::INT, o_orderkey::INT FROM orders
 UNION ALL SELECT 'interface:'||p_partkey, 'interface', {CAMEL}, lower(p_type)||'::'||{CAMEL},
        'src/'||lower(p_type)||'.java', (p_partkey % 1000 + 1)::INT, p_partkey::INT FROM part)"""

EDGES_SQL = """
edges AS (
 SELECT 'module:'||n_regionkey AS source, 'class:'||n_nationkey AS target, 'contains' AS kind, NULL::INT AS line FROM nation
 UNION ALL SELECT 'class:'||c_nationkey, 'method:'||c_custkey, 'contains', NULL FROM customer
 UNION ALL SELECT 'class:'||s_nationkey, 'field:'||s_suppkey, 'contains', NULL FROM supplier
 UNION ALL SELECT 'method:'||o_custkey, 'route:'||o_orderkey, 'calls', NULL FROM orders
 UNION ALL SELECT DISTINCT 'route:'||l_orderkey, 'interface:'||l_partkey, 'references', l_linenumber::INT FROM lineitem
 UNION ALL SELECT DISTINCT 'route:'||l_orderkey, 'field:'||l_suppkey, 'uses', l_linenumber::INT FROM lineitem)"""

KINDS_CONTAINER = "('class','interface','struct','trait','protocol','module','enum')"
KINDS_CALL = "('calls','references','imports','instantiates','uses')"
RANK_SQL = """CASE WHEN kind IN ('class','interface','enum','struct','trait','type_alias','method','function','module','namespace')
 THEN 0 ELSE 1 END"""


def impact_cte(seed: str) -> str:
    return f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL},
w AS (SELECT e.source AS src, e.target AS dst, 0 AS cost FROM edges e JOIN nodes n ON n.id=e.source
        WHERE e.kind='contains' AND n.kind IN {KINDS_CONTAINER}
      UNION ALL SELECT target, source, 1 FROM edges WHERE kind<>'contains'),
r(id,d) AS (SELECT id, 0 FROM nodes WHERE id='{seed}' UNION SELECT w.dst, r.d+w.cost FROM r JOIN w ON w.src=r.id WHERE r.d<3),
reached AS (SELECT id, min(d) AS distance FROM r GROUP BY id)"""


def impact_sql(seed: str) -> str:
    return impact_cte(seed) + " SELECT n.id, n.kind, n.name, reached.distance::INT AS distance FROM reached JOIN nodes n USING (id)"


def impact_edges_sql(seed: str) -> str:
    return impact_cte(seed) + f"""
 SELECT e.source, e.target, e.kind, e.line FROM edges e JOIN reached x ON x.id=e.source JOIN nodes n ON n.id=e.source
  WHERE e.kind='contains' AND n.kind IN {KINDS_CONTAINER} AND x.distance<3
 UNION ALL SELECT e.source, e.target, e.kind, e.line FROM edges e JOIN reached x ON x.id=e.target
  WHERE e.kind<>'contains' AND x.distance<3"""


def walk_sql(seed: str, depth: int, forward: bool) -> str:
    near, far = ("source", "target") if forward else ("target", "source")
    return f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL},
seeds AS (SELECT id FROM nodes WHERE id='{seed}'
  UNION SELECT m.id FROM edges e JOIN nodes f ON f.id=e.source JOIN nodes m ON m.id=e.target
  WHERE f.id='{seed}' AND f.kind IN {KINDS_CONTAINER} AND e.kind='contains' AND m.kind='method'),
r(id,d) AS (SELECT id,0 FROM seeds UNION
  SELECT e.{far}, r.d+1 FROM r JOIN edges e ON e.{near}=r.id WHERE e.kind IN {KINDS_CALL} AND e.source<>e.target AND r.d<{depth})
SELECT n.id, n.kind, n.name, x.distance FROM
 (SELECT id, min(d)::INT AS distance FROM r WHERE d>0 AND id<>'{seed}' GROUP BY id) x JOIN nodes n USING (id)"""


def lookup_sql(symbol: str) -> str:
    tiers = []
    if ":" in symbol and len(symbol) > 10:
        tiers.append(f"WHEN id='{symbol}' THEN 1")
    if "." in symbol:
        head, _, tail = symbol.rpartition(".")
        tiers.append(f"WHEN qualified_name='{head}::{tail}' THEN 2")
        tiers.append(f"WHEN ends_with(lower(replace(qualified_name,'::','.')), '{symbol.lower().replace('::', '.')}') THEN 3")
    tiers += [f"WHEN name='{symbol}' THEN 4", f"WHEN lower(name)=lower('{symbol}') THEN 5"]
    return f"""SELECT '{symbol}' AS symbol, id, kind, name, qualified_name FROM (
 SELECT *, row_number() OVER (ORDER BY tier, {RANK_SQL}, start_line, file_path, seq, id) AS rn FROM (
  SELECT *, CASE {' '.join(tiers)} END AS tier FROM nodes) WHERE tier IS NOT NULL) WHERE rn=1"""


SYMBOLS = ["route:1000000", "method:100", "interface:77", "world.NATION_3", "n2.Customer#000000000",
           "customer#000000017", "order_12", "ORDER_12", "NATION_7", "no.such.symbol", "small", "Supplier#000000003"]


def _lookup(s, d):
    nodes = order_graph(s, d).nodes
    out = None
    for symbol in SYMBOLS:
        hit = lookup(nodes, symbol).select(F.lit(symbol).alias("symbol"), "id", "kind", "name", "qualified_name")
        out = hit if out is None else out.unionByName(hit)
    return out


LOOKUP_SQL = f"WITH {NODES_SQL} " + " UNION ALL ".join(f"({lookup_sql(x)})" for x in SYMBOLS)

IMPACT_COLS = ["id", "kind", "name", "distance"]


def _impact(seed):
    return lambda s, d: impact(order_graph(s, d), seed, 3).nodes.select(*IMPACT_COLS)


def _walk(fn, seed, depth):
    return lambda s, d: fn(order_graph(s, d), seed, depth).select(*IMPACT_COLS)


def _dedupe(s, d):
    raw = table(s, d, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey")).alias("source"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("target"),
        F.lit("uses").alias("kind"),
        F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).cast("int").alias("line"),
        F.lit(None).cast("int").alias("col"))
    return dml.dedupe_edges(raw).select("source", "target", "kind", "line")


def _fk(s, d):
    g = order_graph(s, d)
    big = table(s, d, "part").filter(F.col("p_size") > 25).select(F.concat(F.lit("interface:"), F.col("p_partkey")).alias("id"))
    routes = g.nodes.filter(F.col("kind") == "route").select("id")
    return dml.filter_dangling(g.edges, routes.union(big)).select("source", "target", "kind", "line")


def _edges(s, d):
    g = order_graph(s, d)
    cols = ["source", "target", "kind", "line"]
    return (g.edges_out("route:7").select(*cols, F.lit("out").alias("side"))
            .unionByName(g.edges_in("interface:5", ["references"]).select(*cols, F.lit("in").alias("side")))
            .unionByName(g.edges_in("field:3", ["uses", "contains"]).select(*cols, F.lit("in").alias("side"))))


QUERIES = {
    "impact_part": (_impact("interface:5"), impact_sql("interface:5")),
    "impact_nation": (_impact("class:3"), impact_sql("class:3")),
    "impact_region": (_impact("module:1"), impact_sql("module:1")),
    "impact_edges": (lambda s, d: impact(order_graph(s, d), "class:3", 3).edges.select("source", "target", "kind", "line"),
                     impact_edges_sql("class:3")),
    "callers_d1": (_walk(callers, "field:3", 1), walk_sql("field:3", 1, False)),
    "callers_d2": (_walk(callers, "interface:5", 2), walk_sql("interface:5", 2, False)),
    "callees_d1": (_walk(callees, "method:4", 1), walk_sql("method:4", 1, True)),
    "callees_d2": (_walk(callees, "method:4", 2), walk_sql("method:4", 2, True)),
    "callers_container": (_walk(callers, "class:3", 2), walk_sql("class:3", 2, False)),
    "callees_container": (_walk(callees, "class:3", 2), walk_sql("class:3", 2, True)),
    "lookup_node": (_lookup, LOOKUP_SQL),
    "edges_in_out": (_edges, f"""WITH {EDGES_SQL}
 SELECT source,target,kind,line,'out' AS side FROM edges WHERE source='route:7'
 UNION ALL SELECT source,target,kind,line,'in' FROM edges WHERE target='interface:5' AND kind='references'
 UNION ALL SELECT source,target,kind,line,'in' FROM edges WHERE target='field:3' AND kind IN ('uses','contains')"""),
    "contained_nodes": (
        lambda s, d: order_graph(s, d).contained("class:3", ["method"]).select("id", "kind", "name", "start_line"),
        f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT n.id, n.kind, n.name, n.start_line FROM nodes n JOIN edges e ON e.target=n.id
 WHERE e.kind='contains' AND e.source='class:3' AND n.kind='method'"""),
    "ancestor": (
        lambda s, d: order_graph(s, d).ancestor("method:4").select("id", "kind", "name"),
        f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT n.id, n.kind, n.name FROM nodes n
 WHERE n.id = (SELECT min(source) FROM edges WHERE kind='contains' AND target='method:4')"""),
    "file_nodes": (
        lambda s, d: order_graph(s, d).file_nodes("src/n3.java").select("id", "name", "start_line", "seq"),
        f"WITH {NODES_SQL} SELECT id, name, start_line, seq FROM nodes WHERE file_path='src/n3.java'"),
    "graph_stats": (
        lambda s, d: order_graph(s, d).stats(),
        f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node_count' AS metric, count(*) AS value FROM nodes
 UNION ALL SELECT 'edge_count', count(*) FROM edges
 UNION ALL SELECT 'edge_'||kind, count(*) FROM edges GROUP BY kind"""),
    "dedupe_edges": (_dedupe, """SELECT DISTINCT 'part:'||l_partkey AS source, 'supplier:'||l_suppkey AS target, 'uses' AS kind,
 CASE WHEN l_linenumber>3 THEN l_linenumber END::INT AS line FROM lineitem"""),
    "fk_filter_edges": (_fk, f"""WITH {NODES_SQL}, {EDGES_SQL},
 ok AS (SELECT id FROM nodes WHERE kind='route' UNION ALL SELECT 'interface:'||p_partkey FROM part WHERE p_size>25)
 SELECT source,target,kind,line FROM edges WHERE source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok)"""),
    "node_ids": (
        lambda s, d: table(s, d, "part").select(
            "p_partkey", dml.node_id(F.lit("class"), F.concat(F.lit("src/"), F.col("p_type")), F.col("p_name"), F.col("p_size")).alias("node_id")),
        """SELECT p_partkey, 'class:'||substr(sha256('src/'||p_type||':class:'||p_name||':'||p_size),1,32) AS node_id FROM part"""),
    "content_hash": (
        lambda s, d: table(s, d, "documents").select("doc_id", dml.content_hash(F.col("text")).alias("content_hash")),
        "SELECT doc_id, sha256(text) AS content_hash FROM documents"),
}
