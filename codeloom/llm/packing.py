"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.base import byte_letters, pieces, vocabulary
from codeloom.session import cut

#: Longer texts are left to the tokenizer library: a long run of white space exceeds the stack of the other's patterns.
LONG_TEXT = 100_000

_encoders: dict = {}


def encoder(path: str):
    """The worker's encoder for a byte-level BPE file, by the tiktoken library: ids in a byte-level file follow the
    merge order, so they serve as its ranks. Special tokens in a text become their ids, as the file says."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        spec = vocabulary(path)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text, with special tokens recognised and none added."""
    if len(text) <= LONG_TEXT:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    if (path, "long") not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path, "long"] = whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
    return np.array(_encoders[path, "long"].encode(text, add_special_tokens=False).ids, np.uint32)


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: only a document longer than ``size`` is cut, and then the first piece takes
    what is left over."""
    whole, rest = divmod(n, size)
    return [rest] * (rest > 0) + [size] * whole


class SegmentTree:
    """Which remaining capacities have open bins, with the smallest one >= a length in logarithmic time."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces: (length, first rank, first sequence, offset), each entry up
    to the next rank of its length. Pieces of one length go in runs: bins that have the same capacity left and
    neighbouring numbers are one stack entry, so the work depends on the number of lengths, not of documents. The
    tightest bin stays the tightest until it takes no more, so whole bins are filled first and one bin gets the rest."""
    tree, open_bins, made, new = SegmentTree(size), {}, [], 0

    def leave(room: int, first: int, last: int) -> None:
        if room and last > first:
            open_bins.setdefault(room, []).append((first, last))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = size, new
                last = new = first + -(-left // (size // length))
            else:
                first, last = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per_bin = room // length
            full = min(last - first, left // per_bin)
            for j in range(per_bin if full else 0):
                made.append((length, rank, first, size - room + j * length))
                rank += full
            leave(room - per_bin * length, first, first + full)
            left -= full * per_bin
            first += full
            if left and first < last:  # fewer than per_bin pieces
                made.extend((length, rank + j, first, size - room + j * length) for j in range(left))
                leave(room - left * length, first, first + 1)
                left, first = 0, first + 1
            leave(room, first, last)
    return made


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its rank among the pieces of its length that
    the task made (task number, local rank)."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in pieces(batches, "text"):
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "local_rank")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = np.append(encode(text, path), end_id).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), size)):
                    for name, v in zip(rows, (doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes()), seen[n])):
                        rows[name].append(v)
                    seen[n] += 1
                    start += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()),
                 *[pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32", "local_rank")],
                 pa.array([task] * len(rows["piece"]), pa.int32())], names=[*rows, "task"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long, task int")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Each text (null: empty) is its ids and ``end_id``. Pieces of equal length are interchangeable for best-fit
    decreasing, so it runs exactly on the counts per length (at most ``size`` numbers on the driver); a piece finds its
    place by its length and its rank among the pieces of that length. The rank is the task's offset, a running sum of
    counts per task and length, plus the rank inside the task; nothing is sorted and no length gathers in one task.
    Repeated rows are packed as often as they occur; an empty table gives no rows; other columns are not looked at."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made, _ = cut(pieces_of(rows, path, size, end_id))
    per_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = plan(counts, size)
    order = sorted(entries)
    keys = np.array([(n << 44) + rank for n, rank, _, _ in order], np.int64)
    to = np.array([(rank, first, offset) for _, rank, first, offset in order], np.int64).reshape(-1, 3)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            rank = rank.astype(np.int64)
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(to[at, 1] + rank - to[at, 0]), pa.array(to[at, 2])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(before.drop("n"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
