"""Walks and point reads over the order-entry graph with its edges stored by either end."""

from __future__ import annotations

import uuid
from dataclasses import replace

from codeloom.operators.traverse import callees, callers, impact
from codeloom.session import shared_dir
from codeloom.sources import edge_layout
from codeloom.sources.tables import order_graph
from registry.graph_queries import IMPACT_COLS, impact_edges_sql, impact_sql, walk_sql


def laid_out(s, d):
    graph = order_graph(s, d).store()
    folder = f"{shared_dir(s)}/codeloom-{uuid.uuid4().hex}"
    return replace(graph, layouts=edge_layout.write(graph.edges, graph.nodes, folder, graph.edge_rows))


QUERIES = {
    "stored_impact_region": (lambda s, d: impact(laid_out(s, d), "module:1", 3).nodes.select(*IMPACT_COLS), impact_sql("module:1")),
    "stored_impact_edges": (lambda s, d: impact(laid_out(s, d), "class:3", 3).edges.select("source", "target", "kind", "line"),
                            impact_edges_sql("class:3")),
    "stored_callers": (lambda s, d: callers(laid_out(s, d), "interface:5", 2).select(*IMPACT_COLS), walk_sql("interface:5", 2, False)),
    "stored_callees": (lambda s, d: callees(laid_out(s, d), "class:3", 2).select(*IMPACT_COLS), walk_sql("class:3", 2, True)),
}
