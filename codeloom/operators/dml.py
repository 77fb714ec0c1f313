"""Write-side operators: upserts, identity, endpoint checks, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import ends_join, lookup_join
from codeloom.session import broadcast_rows, cut

EDGE_KEY = ["source", "target", "kind"]


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    """``kind:`` plus the first 32 hex digits of SHA-256 of ``path:kind:name:line``."""
    text = F.concat_ws(":", path, kind, name, line.cast("string"))
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(text, 256), 1, 32))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Drop nodes without id, kind, name, path or language; default the
    qualified name to the name."""
    ok = None
    for c in ("id", "kind", "name", "file_path", "language"):
        test = F.col(c).isNotNull() & (F.col(c) != "")
        ok = test if ok is None else ok & test
    return nodes.filter(ok).withColumn(
        "qualified_name", F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")),
                                     F.col("name")))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write wins per key: the row with the greatest ``version`` is kept,
    ``incoming`` before ``current`` at equal versions."""
    cols = current.columns
    both = current.withColumn("_src", F.lit(0)).unionByName(incoming.select(*cols).withColumn("_src", F.lit(1)))
    best = F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_src"))).alias("_r")
    return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best).select("_r.*")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, kind, line, col); null positions compare equal.

    The survivor among equal keys is the smallest by provenance and metadata."""
    key = [c for c in EDGE_KEY + ["line", "col"] if c in edges.columns]
    rest = [c for c in edges.columns if c not in key]
    if not rest:
        return edges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    # A map cannot be compared, its JSON text can.
    text = [F.coalesce(F.to_json(c) if c == "metadata" else F.col(c).cast("string"), F.lit("")) for c in sorted(rest, reverse=True)]
    order = F.struct(*text)
    return (
        edges.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
        .select(*key, "_r.*")
        .select(*edges.columns)
    )


def filter_dangling(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Keep edges whose both ends exist; ``rows`` is the row count of ``edges`` where that is a stored table."""
    return ends_join(edges, nodes, "left_semi", rows)


def delete_files(nodes: DataFrame, edges: DataFrame, refs: DataFrame, paths: DataFrame, edge_rows: int | None = None):
    """Delete the nodes of some files; edges at either end and references go too.

    ``paths`` has one column ``file_path``; ``edge_rows`` is the row count of ``edges`` where that is a stored table.
    Returns (nodes, edges, refs).
    """
    gone = nodes.join(paths, "file_path", "left_semi").select("id")
    kept_nodes = nodes.join(paths, "file_path", "left_anti").select(*nodes.columns)
    kept_edges = ends_join(edges, gone, "left_anti", edge_rows)
    kept_refs = refs.join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti")
    return kept_nodes, kept_edges, kept_refs.select(*refs.columns)


def cross_file_incoming(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges into the given files that start in another file, with the target's
    kind and name (what survives a re-index of the target file)."""
    target = nodes.join(paths, "file_path", "left_semi").select(
        F.col("id").alias("target"), F.col("kind").alias("target_kind"),
        F.col("name").alias("target_name"), F.col("file_path").alias("target_path"))
    target, n = cut(target)
    source = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_path"))
    if n <= broadcast_rows(nodes.sparkSession):
        # Only the edges' own columns are written and shuffled; the target's are added at the end.
        into = edges.join(F.broadcast(target.select("target")), "target", "left_semi").select(*edges.columns)
        found = lookup_join(into, source, ["source"], "inner").join(F.broadcast(target), "target")
    else:
        # A hub may own many of the edges: its one row is repeated instead. The edges are written once for both ends.
        edges, rows = cut(edges)
        into = lookup_join(edges, target, ["target"], "inner", rows, stored=True)
        found = lookup_join(into, source, ["source"], "inner", rows, stored=True, keys_of=edges)
    return found.filter(F.col("source_path") != F.col("target_path"))


def mark_failed(refs: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """Set status ``failed`` and the name tail on the given ``ref_id`` rows."""
    flag = failed_ids.select("ref_id").distinct().withColumn("_failed", F.lit(True))
    hit = F.col("_failed").isNotNull()
    return (
        refs.join(flag, "ref_id", "left")
        .withColumn("name_tail", F.when(hit, F.substring_index("reference_name", ".", -1))
                    .otherwise(F.col("name_tail")))
        .withColumn("status", F.when(hit, F.lit("failed")).otherwise(F.col("status")))
        .select(*refs.columns)
    )
