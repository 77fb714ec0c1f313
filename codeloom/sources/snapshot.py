"""Graph snapshots on shared storage: one folder per save and a version log.

A save writes its relations under a name of its own and becomes visible with one
entry of the log, created last and only if no entry of that version exists yet. A
save that dies before leaves a folder nobody reads and blocks nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.sync import Index
from codeloom.session import cut
from codeloom.sources import edge_layout

# How each relation is laid out: range partitions on a key that no hot value can
# fill alone, sorted so that point reads skip row groups. Edges have two layouts of
# their own (edge_layout).
LAYOUT = {
    "nodes": ["file_path", "seq"],
    "refs": ["reference_name", "ref_id"],
    "annotations": ["file_path", "node_id"],
    "bases": ["reference_name", "ref_id"],
    "files": ["path"],
}
COUNT, PARTS = "rows.", "parts.edges"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> dict[int, bool]:
    """Versions in the log; False for an entry whose writer died before it wrote the name of its folder."""
    path, fs = _path(spark, f"{folder}/log")
    if not fs.exists(path):
        return {}
    return {int(s.getPath().getName()): s.getLen() > 0 for s in fs.listStatus(path) if s.getPath().getName().isdigit()}


def current_version(spark: SparkSession, folder: str) -> int:
    """The last committed version, 0 before the first."""
    return max((v for v, done in _versions(spark, folder).items() if done), default=0)


class ConcurrentCommit(RuntimeError):
    """Another writer committed after the version that a change was based on."""


def _publish(spark: SparkSession, folder: str, name: str, base: int | None = None) -> int:
    """Create the next log entry. Creation fails where the entry exists, so two writers never share a version. With
    ``base``, the version the content was derived from, the entry is only made while that is the last committed one: of
    two changes to one base the second fails and can be derived anew, so neither is lost."""
    while True:
        entries = _versions(spark, folder)
        if base is not None and max((v for v, done in entries.items() if done), default=0) != base:
            raise ConcurrentCommit(f"{folder} has moved on from version {base}")
        version = max(entries, default=0) + 1
        path, fs = _path(spark, f"{folder}/log/{version:08d}")
        try:
            out = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                if base is not None:  # its writer may not have written the name yet
                    raise ConcurrentCommit(f"{folder} is being moved on from version {base}") from None
                continue
            raise
        if base is not None and any(done and base < v < version for v, done in _versions(spark, folder).items()):
            out.close()  # stays empty, as a dead writer's entry does
            raise ConcurrentCommit(f"{folder} has moved on from version {base}")
        out.write(bytearray(name, "utf-8"))
        out.close()
        return version


def save(index: Index, folder: str, base: int | None = None) -> int:
    """Write the next version and commit it; with ``base``, only if that is still the current version."""
    spark = index.nodes.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    meta = dict(index.metadata)
    for relation, keys in LAYOUT.items():
        df: DataFrame = getattr(index, relation)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
            "errorifexists").parquet(f"{folder}/{name}/{relation}")
        rows = index.rows[relation] if index.rows else seen.get["rows"]
        meta[COUNT + relation] = str(rows)
    edges, rows = (index.edges, index.rows["edges"]) if index.rows else cut(index.edges)
    layouts = edge_layout.write(edges, index.nodes, f"{folder}/{name}", rows)
    meta |= {COUNT + "edges": str(rows), PARTS: str(layouts.parts)}
    spark.createDataFrame(list(meta.items()), "key string, value string").withColumn(
        "updated_at", F.unix_millis(F.current_timestamp())).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{name}/metadata")
    return _publish(spark, folder, name, base)


def load(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """A saved version, the current one by default. Its relations are tables with known row counts."""
    version = version or current_version(spark, folder)
    name = spark.read.text(f"{folder}/log/{version:08d}").first()[0]
    frames = {relation: spark.read.parquet(f"{folder}/{name}/{relation}") for relation in LAYOUT}
    meta = {r.key: r.value for r in spark.read.parquet(f"{folder}/{name}/metadata").collect()}
    rows = {k.removeprefix(COUNT): int(v) for k, v in meta.items() if k.startswith(COUNT)}
    layouts = edge_layout.load(spark, f"{folder}/{name}", int(meta.pop(PARTS)), rows["edges"]) if PARTS in meta else None
    frames["edges"] = layouts.edges() if layouts else spark.read.parquet(f"{folder}/{name}/edges")  # saved before there were layouts
    return Index(**frames, metadata={k: v for k, v in meta.items() if not k.startswith(COUNT)}, rows=rows, layouts=layouts)
