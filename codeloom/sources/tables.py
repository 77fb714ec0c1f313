"""A code-graph view of order-entry tables.

Regions are modules, nations classes, customers methods, suppliers fields,
orders routes and parts interfaces; lineitems give the references and uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.graph import Graph


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def part_symbol() -> Column:
    """``small ring`` of type ECONOMY becomes ``smallRingECONOMY``-style camel case."""
    words = F.split("p_name", " ")
    camel = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), "")
    return F.concat(camel, F.initcap(F.lower("p_type")), F.lit("_"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in
         ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def key(prefix: str, col: str) -> Column:
        return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))

    def node(df: DataFrame, kind: str, k: str, name: Column, path: Column) -> DataFrame:
        return df.select(
            key(kind, k).alias("id"), F.lit(kind).alias("kind"), name.alias("name"),
            F.concat(path, F.lit("::"), name).alias("qualified_name"),
            F.concat(F.lit("src/"), path, F.lit(".java")).alias("file_path"),
            (F.col(k) % 1000 + 1).cast("int").alias("start_line"), F.col(k).cast("int").alias("seq"))

    def nation_path(col: str) -> Column:
        return F.concat(F.lit("n"), F.col(col).cast("string"))

    nodes = reduce(DataFrame.unionByName, [
        node(t["region"], "module", "r_regionkey", F.col("r_name"), F.lit("world")),
        node(t["nation"], "class", "n_nationkey", F.col("n_name"), F.lit("world")),
        node(t["customer"], "method", "c_custkey", F.col("c_name"), nation_path("c_nationkey")),
        node(t["supplier"], "field", "s_suppkey", F.col("s_name"), nation_path("s_nationkey")),
        node(t["orders"], "route", "o_orderkey",
             F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.lit("orders")),
        node(t["part"], "interface", "p_partkey", part_symbol(), F.lower(F.col("p_type"))),
    ])

    def edge(df: DataFrame, kind: str, src: Column, dst: Column, line: Column | None = None) -> DataFrame:
        return df.select(src.alias("source"), dst.alias("target"), F.lit(kind).alias("kind"),
                         (line if line is not None else F.lit(None)).cast("int").alias("line"))

    li = t["lineitem"]
    refs = li.select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    uses = li.select("l_orderkey", "l_suppkey", "l_linenumber").distinct()
    edges = reduce(DataFrame.unionByName, [
        edge(t["nation"], "contains", key("module", "n_regionkey"), key("class", "n_nationkey")),
        edge(t["customer"], "contains", key("class", "c_nationkey"), key("method", "c_custkey")),
        edge(t["supplier"], "contains", key("class", "s_nationkey"), key("field", "s_suppkey")),
        edge(t["orders"], "calls", key("method", "o_custkey"), key("route", "o_orderkey")),
        edge(refs, "references", key("route", "l_orderkey"), key("interface", "l_partkey"), F.col("l_linenumber")),
        edge(uses, "uses", key("route", "l_orderkey"), key("field", "l_suppkey"), F.col("l_linenumber")),
    ])
    return Graph(nodes, edges)
