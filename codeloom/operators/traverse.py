"""Callers, callees and impact as level-by-level frontier joins.

Distances are minimal ones. A walk runs over a step table (src, dst, cost):
each round is one join of the frontier (unique ids) with the steps, so a step
row is read once per round and can match at most one frontier row. A frontier
is broadcast only after its rows were counted; a larger one is joined by a
shuffle in which the steps of a hub node are spread over several tasks. On a
graph with edge layouts a round scans only the directories, and for a small
frontier only the row groups, that hold edges of its nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.graph import Graph
from codeloom.operators.skew import lookup_join
from codeloom.session import broadcast_rows, cut


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a counted table when it is small enough."""
    return F.broadcast(df) if rows <= broadcast_rows(df.sparkSession) else df


def _store_steps(graph: Graph, steps: DataFrame) -> tuple[DataFrame, int | None]:
    """Steps read once per round: write derived ones to a table first."""
    return (steps, graph.edge_rows) if graph.stored else cut(steps)


def _expand(steps: DataFrame, step_rows: int | None, frontier: DataFrame, rows: int) -> DataFrame:
    """One round: (id, distance) of everything a frontier row leads to."""
    near = frontier.select(F.col("id").alias("src"), "distance")
    if rows <= broadcast_rows(frontier.sparkSession):
        joined = steps.join(F.broadcast(near), "src")
    else:
        joined = lookup_join(steps, near, ["src"], "inner", step_rows, stored=True)
    return (
        joined.groupBy(F.col("dst").alias("id"))
        .agg(F.min(F.col("distance") + F.col("cost")).alias("distance"))
    )


def _unseen(found: DataFrame, known: list[tuple[DataFrame, int]]) -> DataFrame:
    """Drop ids already known at the same or a smaller distance."""
    for ids, rows in known:
        k = _bounded(ids.select(F.col("id").alias("_id"), F.col("distance").alias("_d")), rows)
        found = found.join(k, (F.col("id") == F.col("_id")) & (F.col("_d") <= F.col("distance")), "left_anti")
    return found


def _seeds(graph: Graph, node_id: str) -> DataFrame:
    """The focal node, and its methods when it is a container."""
    focal = graph.node(node_id).select("id", "kind")
    is_container = focal.filter(F.col("kind").isin(schema.CONTAINERS)).select(F.col("id").alias("source"))
    members = (
        graph.edges_out(node_id, ["contains"]).join(is_container, "source", "left_semi")
        .select(F.col("target").alias("id"))
    )
    methods = graph.nodes.filter(F.col("kind") == "method").select("id").join(members, "id", "left_semi")
    return focal.select("id").union(methods).distinct().withColumn("distance", F.lit(0))


def _round(graph: Graph, frontier: DataFrame, rows: int, calls: str | None = None):
    """The steps one round has to read from the edge layouts: call-like ones with ``calls`` as the near end, or those of
    an impact walk."""
    edges = graph.layouts.near(frontier, rows)
    if calls:
        return _call_steps(edges(calls), calls), graph.layouts.rows
    return _impact_steps(edges("source").where("holder"), edges("target").where("kind <> 'contains'")), graph.layouts.rows


def _call_steps(edges: DataFrame, near: str) -> DataFrame:
    far = "source" if near == "target" else "target"
    return (
        edges.filter(F.col("kind").isin(schema.CALL_LIKE) & (F.col("source") != F.col("target")))
        .select(F.col(near).alias("src"), F.col(far).alias("dst"), F.lit(1).alias("cost"))
    )


def _impact_steps(inside: DataFrame, inward: DataFrame) -> DataFrame:
    return (
        inside.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("cost"))
        .unionByName(inward.select(F.col("target").alias("src"), F.col("source").alias("dst"), F.lit(1).alias("cost")))
    )


def _walk(graph: Graph, node_id: str, max_depth: int, near: str) -> DataFrame:
    steps, step_rows = None, graph.edge_rows
    if not graph.layouts:
        steps = _call_steps(graph.edges, near)
        if max_depth > 1:
            steps, step_rows = _store_steps(graph, steps)
    frontier, rows = cut(_seeds(graph, node_id))
    known, hits = [(frontier, rows)], []
    for depth in range(1, max_depth + 1):
        if graph.layouts:
            steps, step_rows = _round(graph, frontier, rows, near)
        found = _expand(steps, step_rows, frontier, rows)
        if depth == max_depth:
            hits.append(found)
            break
        found, rows = cut(found)
        if rows == 0:
            break
        hits.append(found)
        frontier = _unseen(found, known)
        known.append((found, rows))
    if not hits:
        return frontier.limit(0)
    # A seed method is reported when another seed or caller reaches it.
    return (
        reduce(DataFrame.unionByName, hits).filter(F.col("id") != node_id)
        .groupBy("id").agg(F.min("distance").alias("distance"))
    )


def _describe(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.nodes.join(ids, "id")


def callers(graph: Graph, node_id: str, max_depth: int = 1) -> DataFrame:
    """Nodes that reach the focal node (or a method of a focal container) over
    call-like edges, with their distance; the focal node itself is left out."""
    return _describe(graph, _walk(graph, node_id, max_depth, "target"))


def callees(graph: Graph, node_id: str, max_depth: int = 1) -> DataFrame:
    """Mirror of :func:`callers` along outgoing edges."""
    return _describe(graph, _walk(graph, node_id, max_depth, "source"))


def _containment(graph: Graph) -> DataFrame:
    """``contains`` edges that leave a container."""
    holders = graph.nodes.filter(F.col("kind").isin(schema.CONTAINERS)).select(F.col("id").alias("source"))
    return graph.edges.filter(F.col("kind") == "contains").join(holders, "source", "left_semi").select(*graph.edges.columns)


class Impact:
    """Blast radius of a node: ``nodes`` with distances and the ``edges`` walked.

    Going from a container to its content costs nothing, going from an edge's
    target to its source costs one. Nodes at the greatest distance are reported
    but not followed further.
    """

    def __init__(self, graph: Graph, node_id: str, max_depth: int = 3):
        self.graph = graph
        self.max_depth = max_depth
        self._walked = None
        if graph.stored and not graph.layouts:
            # Only the steps inward from a container are derived: written once. The others are read as they are stored.
            steps, step_rows = _impact_steps(cut(_containment(graph))[0], graph.edges.filter(F.col("kind") != "contains")), graph.edge_rows
        elif not graph.layouts:
            # Edges that are derived themselves are written whole, so that ``edges`` reads them again.
            others = graph.edges.filter(F.col("kind") != "contains")
            self._walked, step_rows = cut(_containment(graph).unionByName(others))
            steps = _impact_steps(self._walked.filter(F.col("kind") == "contains"), self._walked.filter(F.col("kind") != "contains"))
        frontier = graph.node(node_id).select("id", F.lit(0).alias("distance"))
        self._known: list[tuple[DataFrame, int]] = []
        while True:
            frontier, rows = cut(frontier)
            if rows == 0:
                break
            self._known.append((frontier, rows))
            open_ends = frontier.filter(F.col("distance") < max_depth)
            if graph.layouts:
                steps, step_rows = _round(graph, open_ends, rows)
            frontier = _unseen(_expand(steps, step_rows, open_ends, rows), self._known)

    @property
    def ids(self) -> DataFrame:
        if not self._known:
            return self.graph.nodes.select("id", F.lit(0).alias("distance")).limit(0)
        return (
            reduce(DataFrame.unionByName, [ids for ids, _ in self._known])
            .groupBy("id").agg(F.min("distance").alias("distance"))
        )

    @property
    def nodes(self) -> DataFrame:
        return _describe(self.graph, self.ids)

    @property
    def edges(self) -> DataFrame:
        """``contains`` edges out of, and all other edges into, followed nodes."""
        graph = self.graph
        followed = self.ids.filter(F.col("distance") < self.max_depth).select("id")
        rows = sum(rows for _, rows in self._known)
        if graph.layouts:
            near = graph.layouts.near(followed, rows)
            inside, into = near("source").where("holder"), near("target")
        elif self._walked is not None:
            inside, into = self._walked.filter(F.col("kind") == "contains"), self._walked
        else:
            inside, into = _containment(graph), graph.edges
        followed = _bounded(followed, rows)
        inward = into.filter(F.col("kind") != "contains").withColumn("id", F.col("target"))
        both = inside.withColumn("id", F.col("source")).unionByName(inward)
        return both.join(followed, "id", "left_semi").select(*graph.edges.columns)


def impact(graph: Graph, node_id: str, max_depth: int = 3) -> Impact:
    return Impact(graph, node_id, max_depth)
