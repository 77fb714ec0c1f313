"""Everything about one symbol: detail, source, neighbours, blast radius."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import source_block
from codeloom.graph import Graph
from codeloom.operators.lookup import lookup
from codeloom.operators.traverse import callees, callers, impact
from codeloom.plans.search import search
from codeloom.session import cut

# File count limits with node and character budgets and advised calls.
TIERS = [(500, 20, 8000), (5000, 40, 15000), (15000, 60, 20000), (None, 80, 25000)]
CALLS = [(500, 1), (5000, 2), (15000, 3), (25000, 4), (None, 5)]
SOURCE_LINES, RELATED_SHOWN, MISS_CANDIDATES = 100, 4, 8


def _tier(files: Column, rows: list[tuple], at: int) -> Column:
    out = None
    for row in rows:
        value = F.lit(row[at])
        if row[0] is None:
            return out.otherwise(value)
        test = files < row[0]
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def budget(files: DataFrame) -> DataFrame:
    """One row: file_count, max_nodes, max_chars, calls."""
    count = files.agg(F.count(F.lit(1)).alias("file_count"))
    n = F.col("file_count")
    return count.select(n, _tier(n, TIERS, 1).alias("max_nodes"), _tier(n, TIERS, 2).alias("max_chars"), _tier(n, CALLS, 1).alias("calls"))


def _show(df: DataFrame, section: str, order: list[str], take: int, rows: int | None = None) -> DataFrame:
    """The first ``take`` rows of a section with the total beside them, which are the ``rows`` of a stored list."""
    cols = ["id", "kind", "name", "file_path", "start_line"]
    top = df.select(*cols, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]).orderBy(*[f"_o{i}" for i in range(len(order))]).limit(take)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar() if rows is None else F.lit(rows).cast("long")
    return top.select(F.lit(section).alias("section"), *cols, total.alias("total"))


def explore(graph: Graph, symbol: str, files: DataFrame) -> DataFrame:
    """(section, id, kind, name, file_path, start_line, total) of the sections
    focal, callers, callees, impact, ancestor and related, or of ``candidates``
    when no node has that name. Lists are cut to a third of the node budget."""
    graph = graph.store()
    focal, one = cut(lookup(graph.nodes, symbol))
    hit = focal.select("id").first()  # at most one row
    order = ["distance", "file_path", "seq", "id"]
    if hit is None:
        found = search(graph, symbol, MISS_CANDIDATES)
        return _show(found, "candidates", ["score", "file_path", "seq", "id"], MISS_CANDIDATES)
    take = budget(files).first()["max_nodes"] // 3
    # Each list is made once: the sections and their totals would walk the edges a dozen times.
    ins, n_ins = cut(callers(graph, hit["id"], 1))
    outs, n_outs = cut(callees(graph, hit["id"], 1))
    blast, n_blast = cut(impact(graph, hit["id"], 3).nodes.filter(F.col("id") != hit["id"]))
    above, n_above = cut(graph.ancestor(hit["id"]))
    near, n_near = cut(related(ins, outs))
    return reduce(DataFrame.unionByName, [
        _show(focal, "focal", ["id"], 1, one), _show(ins, "callers", order, take, n_ins), _show(outs, "callees", order, take, n_outs),
        _show(blast, "impact", order, take, n_blast), _show(above, "ancestor", ["id"], 1, n_above),
        _show(near, "related", ["turn", *order[1:]], RELATED_SHOWN, n_near)])


def related(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """Direct callers, then callees, each node once; no imports or packages."""
    both = ins.withColumn("turn", F.lit(0)).unionByName(outs.withColumn("turn", F.lit(1)))
    turns = both.groupBy("id").agg(F.min("turn").alias("_turn"))
    return both.join(turns, "id").filter((F.col("turn") == F.col("_turn")) & ~F.col("kind").isin("import", "namespace")).drop("_turn")


def with_source(nodes: DataFrame, sources: DataFrame, max_lines: int = SOURCE_LINES) -> DataFrame:
    """Add the source lines of each node; ``sources`` has (path, text)."""
    text = sources.select(F.col("path").alias("file_path"), "text")
    return nodes.join(text, "file_path", "left").withColumn(
        "source", source_block(F.col("text"), F.col("start_line"), F.col("end_line"), max_lines)).drop("text")


def report(sections: DataFrame, sources: DataFrame | None, nodes: DataFrame, budget_row) -> str:
    """The sections as markdown. All lists are already cut to the budget."""
    shown = sections
    if sources is not None:
        ends = nodes.select("id", "end_line").join(sections.select("id").distinct(), "id", "left_semi")
        quoted = sections.filter(F.col("section").isin("focal", "related")).join(ends, "id")
        shown = sections.join(with_source(quoted, sources).select("section", "id", "source"), ["section", "id"], "left")
    lines: list[str] = []
    last = None
    for row in shown.collect():
        if row["section"] != last:
            lines.append(f"\n## {row['section'].capitalize()} ({row['total']} total)")
            last = row["section"]
        lines.append(f"- `{row['file_path']}:{row['start_line']}` **{row['name']}** ({row['kind']})")
        if sources is not None and row["source"]:
            lines.append(f"```java\n{row['source']}\n```")
    lines.append(f"\n---\n*{budget_row['file_count']} files, about {budget_row['calls']} calls advised, {budget_row['max_chars']} characters.*")
    return "\n".join(lines).strip()
