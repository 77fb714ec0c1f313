"""Joins and reductions that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import broadcast_rows, cut, hot_key_rows


def _row_hash(df: DataFrame) -> Column:
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*[F.col(c) for c in cols])


#: Hash buckets whose rows are counted before any keys are.
BUCKETS = 4096


def hot_keys(df: DataFrame, on: list[str], least: int) -> tuple[DataFrame, int]:
    """(on..., _spread) of the keys with at least ``least`` rows, and their number.

    A hot key fills its hash bucket, so rows are counted by bucket first, which shuffles at most BUCKETS rows a task; keys are
    counted in full buckets only."""
    bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    full, n = cut(df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("_b"))
    if n == 0:
        return full, 0
    return cut(
        df.join(F.broadcast(full), bucket == F.col("_b"), "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= least).select(*on, F.ceil(F.col("_n") / least).cast("int").alias("_spread")))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int | None = None,
    stored: bool = False,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has at most one row per key.

    Keys that hold many ``left`` rows are spread over several tasks: their rows
    get a salt from a hash of the row, and the single matching ``right`` row is
    repeated once per salt. When the caller knows ``left`` has fewer rows than
    one hot key needs, no key can be hot and the plain join is used. Otherwise
    ``left`` is written to a table (unless it is ``stored``), so that counting
    its keys does not compute it twice and nested calls do not double the plan.
    Where ``left`` is a part of a stored table with the same keys, ``keys_of`` names that table: its keys are counted instead.
    The table of hot keys is counted before it is broadcast.
    """
    spark = left.sparkSession
    hot_min = hot_key_rows(spark)
    if max_rows is not None and max_rows < hot_min:
        return left.join(right, on, how)
    if not stored:
        left, rows = cut(left)
        if rows < hot_min:
            return left.join(right, on, how)
    hot, keys = hot_keys(left if keys_of is None else keys_of, on, hot_min)
    if keys == 0:
        return left.join(right, on, how)
    if keys <= broadcast_rows(spark):
        hot = F.broadcast(hot)
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    # A row with a null key matches nothing, so any salt is right for it.
    salted_left = left.join(hot, on, "left").withColumn(
        "_salt",
        F.when(has_null, F.pmod(_row_hash(left), F.lit(1024)).cast("int"))
        .when(F.col("_spread").isNotNull(),
              F.pmod(_row_hash(left), F.col("_spread").cast("long")).cast("int"))
        .otherwise(F.lit(0)),
    ).drop("_spread")
    salted_right = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1))
    ).drop("_spread")
    return salted_left.join(salted_right, on + ["_salt"], how).drop("_salt")


def ends_join(edges: DataFrame, ids: DataFrame, how: str, rows: int | None = None, ends: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Semi or anti join of both ends of ``edges`` with ``ids`` (id, unique).

    Few ids are counted and broadcast: no edge moves. Otherwise each end is a shuffle in which the edges of a hub are spread
    over several tasks and only the hub's id is repeated. ``edges`` is written once unless its ``rows`` are known, which means
    that it is a stored table."""
    ids, n = cut(ids.select("id"))
    cols = edges.columns
    if n <= broadcast_rows(edges.sparkSession):
        for end in ends:
            edges = edges.join(F.broadcast(ids.withColumnRenamed("id", end)), end, how)
        return edges.select(*cols)
    if rows is None:
        edges, rows = cut(edges)
    out = edges
    for end in ends:
        out = lookup_join(out, ids.withColumnRenamed("id", end), [end], how, rows, stored=True, keys_of=edges)
    return out.select(*cols)


def first_by(df: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """First row per key. ``min`` of a struct combines map-side, so a key that
    owns a third of the rows still reaches the reducer as one row per task."""
    picked = F.min(F.struct(*[F.col(c) for c in order + value])).alias("_m")
    return df.groupBy(*keys).agg(picked).select(
        *keys, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys(order + value)]
    )
