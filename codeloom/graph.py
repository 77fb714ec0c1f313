"""The code graph: nodes and edges as DataFrames, plus what queries need."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import dml
from codeloom.session import cut

if TYPE_CHECKING:
    from codeloom.sources.edge_layout import EdgeLayouts


@dataclass
class Graph:
    """A snapshot of the graph.

    ``node_rows``, ``edge_rows`` and ``ref_rows`` are upper bounds on the row counts where the
    caller knows them (Parquet footers); they let joins skip the search for hot
    keys when no key can be hot. ``stored`` says that the relations are plain
    table scans, so reading them repeatedly costs no recomputation. ``layouts``
    holds the same edges by either end, for reads that touch few of them.
    """

    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame | None = None
    files: DataFrame | None = None
    sources: DataFrame | None = None
    frameworks: list[str] = field(default_factory=list)
    node_rows: int | None = None
    edge_rows: int | None = None
    ref_rows: int | None = None
    stored: bool = False
    layouts: "EdgeLayouts | None" = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def store(self) -> "Graph":
        """Write derived relations to the shared folder once, so that plans that
        read them several times do not recompute them; row counts come along."""
        if self.stored:
            return self
        nodes, node_rows = cut(self.nodes)
        edges, edge_rows = cut(self.edges)
        refs, ref_rows = cut(self.refs) if self.refs is not None else (None, None)
        return replace(self, nodes=nodes, edges=edges, refs=refs, node_rows=node_rows,
                       edge_rows=edge_rows, ref_rows=ref_rows, stored=True)

    # -- point reads ------------------------------------------------------
    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def _edges_at(self, end: str, node_id: str) -> DataFrame:
        if self.layouts:
            return self.layouts.at(end, node_id).select(*self.edges.columns)
        return self.edges.filter(F.col(end) == node_id)

    def edges_out(self, node_id: str, kinds: list[str] | None = None) -> DataFrame:
        hit = self._edges_at("source", node_id)
        return hit.filter(F.col("kind").isin(kinds)) if kinds else hit

    def edges_in(self, node_id: str, kinds: list[str] | None = None) -> DataFrame:
        hit = self._edges_at("target", node_id)
        return hit.filter(F.col("kind").isin(kinds)) if kinds else hit

    def contained(self, node_id: str, kinds: list[str] | None = None) -> DataFrame:
        """Direct members of a container, optionally of some kinds."""
        ids = self.edges_out(node_id, ["contains"]).select(F.col("target").alias("id")).distinct()
        nodes = self.nodes.filter(F.col("kind").isin(kinds)) if kinds else self.nodes
        return nodes.join(ids, "id", "left_semi")

    def ancestor(self, node_id: str) -> DataFrame:
        """The node that contains ``node_id`` (the first one by id order)."""
        parent = self.edges_in(node_id, ["contains"]).agg(F.min("source").alias("id"))
        return self.nodes.join(parent, "id", "left_semi")

    def file_nodes(self, path: str) -> DataFrame:
        return self.nodes.filter(F.col("file_path") == path).orderBy("start_line", "seq")

    def pending_refs(self, name: str | None = None) -> DataFrame:
        pending = self.refs.filter(F.col("status") == "pending")
        return pending.filter(F.col("reference_name") == name) if name else pending

    # -- writes -----------------------------------------------------------
    def with_edges(self, new: DataFrame) -> "Graph":
        """Add edges: endpoints must exist, duplicates are ignored."""
        kept = dml.filter_dangling(new, self.nodes)
        merged = dml.dedupe_edges(self.edges.unionByName(kept, allowMissingColumns=True))
        return replace(self, edges=merged, edge_rows=None, stored=False, layouts=None)

    # -- counts -----------------------------------------------------------
    def stats(self) -> DataFrame:
        """One row per counter: node_count, edge_count, edge_<kind>, ref_<status>."""
        def counter(name, df):
            return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")

        by_kind = self.edges.rollup("kind").agg(F.count(F.lit(1)).alias("value")).select(
            F.when(F.col("kind").isNull(), F.lit("edge_count"))
            .otherwise(F.concat(F.lit("edge_"), F.col("kind"))).alias("metric"), "value")
        out = counter("node_count", self.nodes).unionByName(by_kind)
        if self.refs is not None:
            by_status = self.refs.groupBy("status").agg(F.count(F.lit(1)).alias("value")).select(
                F.concat(F.lit("ref_"), F.col("status")).alias("metric"), "value")
            out = out.unionByName(by_status)
        return out


CONTAINERS = schema.CONTAINERS
