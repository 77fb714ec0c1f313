"""What several operators need: tables, stored intermediates, Arrow text buffers, 64-bit hashing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codeloom.session import cut, ship, spread

#: Text bytes one Python step holds at a time; longer batches are taken in pieces, a longer text alone.
STEP_BYTES = 4 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in at least one split per core."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    return cut(df)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every task and run."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each; kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 borders; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``limit`` bytes, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = (np.cumsum(sizes) - sizes) // limit
        borders = [0, *(np.flatnonzero(np.diff(step)) + 1), len(step)]
        for a, b in zip(borders, borders[1:]):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """All columns of ``df`` and those that ``make`` computes from batches of whole texts."""
    out = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[x if isinstance(x, pa.Array) else pa.array(x) for x in make(batch)]],
                names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, out)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never split a group of rows with equal keys; the rows come sorted by those keys."""
    held: list[pa.RecordBatch] = []

    def changes(t):
        diff = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            diff |= v[1:] != v[:-1]
        return np.flatnonzero(diff) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = changes(t)
        if len(at):
            yield t.slice(0, int(at[-1]))
            held = t.slice(int(at[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def vocabulary(path: str) -> dict:
    """The tokenizer file as a dictionary, read where it is asked for (driver or task)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]
