"""Sharding: a reproducible shuffle by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut

ROUNDS = 6
#: Multiplier of the round function; products of two 31-bit numbers stay inside 64 bits in Spark, numpy and SQL.
FACTOR = 1_103_515_245
#: Added to a half block in each round.
ROUND_KEYS = [(k + 1) * 97_555_123 % (1 << 31) for k in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of half a block, so that the domain 4 ** bits covers n rows and is less than 4 n + 4."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, bits: int) -> np.ndarray:
    mask, m31 = np.int64((1 << bits) - 1), np.int64((1 << 31) - 1)
    left, right = x >> bits, x & mask
    for key in ROUND_KEYS:
        t = ((right + key) & m31) * np.int64(FACTOR) & m31
        t = ((t ^ (t >> 15)) & m31) * np.int64(FACTOR) & m31
        left, right = right, left ^ ((t >> 9) & mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: int) -> np.ndarray:
    """The place of each row number in a permutation of 0 .. n - 1. A value that leaves the range is sent through the
    Feistel network again until it is inside (cycle walking), which keeps the map one-to-one."""
    bits = half_bits(n)
    y = _once(x.astype(np.int64), bits)
    while (out := y >= n).any():
        y[out] = _once(y[out], bits)
    return y


def number_rows(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``df`` with ``row_no``, its place in the given order from 0, and the number of rows.

    Rows are range partitioned and sorted, stored, and numbered by the partition's offset, which is joined. The read position breaks ties, so equal rows are split over partitions too."""
    width = [F.col(f"_k{i}") for i in range(len(order))]
    keyed = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("_tie"))
    keyed = cut(keyed)[0]  # the tie must not change between the sampling and the sort
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *width, F.col("_tie")).sortWithinPartitions(*width, "_tie")
    placed, n = cut(ranged.drop("_tie", *[f"_k{i}" for i in range(len(order))]).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    # A row per partition of the sort: numbered by one running sum, and few enough to be broadcast.
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("_p").count().select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_p").withColumn("row_no", row.cast("long")).drop("_at", "_p", "_before"), n


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row by the law ``rows``: counts differ by one at most.

    Rows are numbered by (doc_id, nulls first; text checksum; size); row r goes to place p = permutation(r), shard
    p mod shards, slot p div shards, so both can be computed from the row number alone. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard, row_no. A null text counts as empty (crc32 0, size 16). Repeated rows
    each get a place of their own; equal rows are interchangeable. An empty table gives no rows. Other columns are
    not looked at. Equal texts are not kept together: this law balances counts, and a group may be larger than a shard."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n))

    return numbered.withColumn("_p", place("row_no")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")
