"""Find one node by id, qualified name or name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schema


def definition_rank(kind: Column) -> Column:
    return F.when(kind.isin(schema.DEFINITIONS), F.lit(0)).otherwise(F.lit(1))


def lookup(nodes: DataFrame, symbol: str) -> DataFrame:
    """At most one row: the best match of the first tier that matches.

    Tiers: id; qualified name with ``.`` before the last part; qualified-name
    suffix with ``.`` and ``::`` taken as equal; exact name; name in any case.
    Within a tier definitions come first, then start line, path and ordinal.
    """
    tests: list[tuple[int, Column]] = []
    if ":" in symbol and len(symbol) > 10:
        tests.append((1, F.col("id") == symbol))
    if "." in symbol:
        head, _, tail = symbol.rpartition(".")
        tests.append((2, F.col("qualified_name") == f"{head}::{tail}"))
        dotted = F.lower(F.replace(F.col("qualified_name"), F.lit("::"), F.lit(".")))
        tests.append((3, dotted.endswith(symbol.lower().replace("::", "."))))
    tests.append((4, F.col("name") == symbol))
    tests.append((5, F.lower("name") == symbol.lower()))

    matched = reduce(lambda a, b: a | b, [t for _, t in tests])
    tier = reduce(lambda acc, t: acc.when(t[1], F.lit(t[0])), tests[1:], F.when(tests[0][1], F.lit(tests[0][0])))
    cols = nodes.columns
    path = F.col("file_path") if "file_path" in cols else F.lit("")
    seq = F.col("seq") if "seq" in cols else F.lit(0)
    # One pass and one reduced row, however many nodes share the name.
    order = F.struct(tier.alias("tier"), definition_rank(F.col("kind")).alias("rank"),
                     F.col("start_line").alias("line"), path.alias("path"), seq.alias("seq"), F.col("id").alias("id"))
    best = nodes.filter(matched).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return best.filter(F.col("_r").isNotNull()).select("_r.*")
