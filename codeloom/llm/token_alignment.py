"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked id pairs.

A link joins the A token and the B token that end at the same byte. One of the two then ends with the other, so a pair
is fixed by the longer token and the length of the shorter one: the two vocabularies alone bound the number of distinct
pairs (``pair_bound``), whatever the corpus. Everything held whole or broadcast here is under that bound.

Texts are encoded once and their ids stored in the shared folder (two bytes an id: about as large as the texts). First
pass: tasks align the documents and write partial counts per pair. The distinct pairs get a minimal perfect hash; partial
counts become dense vectors indexed by it, which are summed in a tree. Second pass: documents are aligned again and every
link looks its count up; the stored key of each place is compared, so no foreign pair gets a count.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.base import append, byte_letters, mix, pieces, stored, vocabulary

#: Distinct pairs a task holds before it writes them out, and vectors that one task sums.
HELD_PAIRS, FAN_IN = 1 << 20, 16
#: A long run of white space or of one kind of letter is left to the other library: it exceeds the stack of this one's patterns.
LONG_TEXT = 100_000

_loaded: dict = {}


class Tokenizers:
    """Both encoders of a worker with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        spec, byte_of = vocabulary(path_a), {letter: b for b, letter in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.path_a, self.whole = path_a, None
        self.a = tiktoken.Encoding(path_a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.kind = np.dtype("<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4")
        # Ids as text with what may follow them: another one of the group, or the end of the side or group.
        self.text_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path_a)
                self.whole.encode_special_tokens = True
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)
        return self.a.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def pair_bound(both: Tokenizers) -> int:
    """More distinct pairs than this cannot occur: of two tokens that end together one is a suffix of the other. Ids with
    equal bytes (a byte and its letter) count as often as they occur."""
    same = max(max(Counter(x).values()) for x in (both.bytes_a, both.bytes_b))
    return int(same * (both.size_a.sum() + both.size_b.sum()))


class Alignment(NamedTuple):
    """Ids of both sides, and for every link the place of its A and of its B token."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray


def encode(texts: list[str | None], both: Tokenizers) -> list[tuple[bytes, bytes]]:
    """Ids of both sides as bytes; none where a text is null, empty or not given back by one of the sides."""
    out, ids_b = [], both.b.encode([t or "" for t in texts], num_threads=1)
    for text, b in zip(texts, ids_b):
        raw = (" " + text).encode() if text else b""
        a = both.encode_a(" " + text) if text else np.zeros(0, np.int64)
        if int(both.size_a[a].sum()) != len(raw) or b"".join(map(both.bytes_b.__getitem__, b)) != raw:
            a, b = a[:0], []  # the A side is lossless by construction, so its size tells; the B side may normalise
        out.append((a.astype(both.kind).tobytes(), np.array(b, both.kind).tobytes()))
    return out


def align(ids: list[tuple[bytes, bytes]], both: Tokenizers) -> list[Alignment]:
    out = []
    for a, b in ids:
        a, b = (np.frombuffer(x, both.kind).astype(np.int64) for x in (a, b))
        _, at_a, at_b = np.intersect1d(np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b]), assume_unique=True, return_indices=True)
        out.append(Alignment(a, b, at_a, at_b))
    return out


def encoded(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b): the stored ids of every row."""

    def run(batches):
        both = tokenizers(path_a, path_b)
        for batch in pieces(batches, "text"):
            ids = encode(batch.column("text").to_pylist(), both)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.binary()) for x in zip(*ids)]], names=["doc_id", "a", "b"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, a binary, b binary"))


def _ids(batch: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
    return [*zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]


def pairs(x: Alignment) -> np.ndarray:
    return x.a[x.at_a] << 32 | x.b[x.at_b]


def groups_text(x: Alignment, both: Tokenizers) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, A before B."""
    if not len(x.at_a):
        return ""
    n, m = len(x.a), len(x.b)
    end_a, end_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    end_a[x.at_a] = end_b[x.at_b] = 1
    out = np.empty(n + m, object)
    # An A token comes after all B tokens of earlier groups, a B token after all A tokens of its group and earlier ones.
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    to_a = np.arange(n) + np.r_[0, x.at_b + 1][group_a]
    to_b = np.arange(m) + (x.at_a + 1)[group_b]
    out[to_a] = both.text_a[x.a + end_a * len(both.bytes_a)]
    out[to_b] = both.text_b[x.b + end_b * len(both.bytes_b)]
    return "".join(out.tolist())[:-1]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by levels: keys that are alone in their place of a level's bit field
    stay there, the others go on to the next level; the number of set bits before a key's bit is its hash. ``keys[h]``
    verifies; a key that is not in the set gives -1."""

    def __init__(self, keys: np.ndarray):
        self.levels, base, rest = [], 0, keys
        self.keys = np.zeros(len(keys), np.int64)
        while len(rest):
            size = 2 * len(rest)
            at = self.place(rest, len(self.levels), size)
            once = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(once) - once
            self.levels.append(np.where(once, rank, -1).astype(np.int32))
            mine = once[at]
            self.keys[rank[at[mine]]] = rest[mine]
            base += int(mine.sum())
            rest = rest[~mine]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix(np.array([level + 1], np.uint64))
        return (mix(keys.view(np.uint64) ^ salt) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ranks in enumerate(self.levels):
            got = ranks[self.place(keys[open_], level, len(ranks))]
            out[open_] = got
            open_ = open_[got < 0]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def partial_counts(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): links counted by task; a task writes what it holds whenever that exceeds HELD_PAIRS."""

    def rows(held):
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        keys, to = np.unique(keys, return_inverse=True)
        return keys, np.bincount(to, n, len(keys)).astype(np.int64)

    def run(batches):
        both, held, size = tokenizers(path_a, path_b), [], 0
        for batch in pieces(batches, "a"):
            found = [pairs(x) for x in align(_ids(batch), both)]
            held.append(np.unique(np.concatenate(found), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [rows(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows(held))], names=["pair", "n"])

    return ids.select("a", "b").mapInArrow(run, "pair long, n long")


def summed(partial: DataFrame, hashed: PerfectHash, fan_in: int = FAN_IN) -> np.ndarray:
    """Counts of all pairs in the order of their hash: one dense vector a task, then sums of ``fan_in`` vectors a task
    until one is left. A vector has one place per distinct pair."""
    spark, size = partial.sparkSession, len(hashed.keys)
    shared = spark.sparkContext.broadcast(hashed)

    def dense(batches):
        from pyspark import TaskContext

        vector = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(vector, shared.value.find(batch.column("pair").to_numpy()), batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([vector.tobytes()])], names=["node", "body"])

    def added(key, t):
        vector = sum(np.frombuffer(b.as_py(), np.int64) for b in t.column("body"))
        return pa.table({"node": [key[0].as_py()], "body": pa.array([vector.tobytes()], pa.binary())})

    vectors = stored(partial.mapInArrow(dense, "node long, body binary"))
    while vectors.count() > 1:
        up = vectors.select(F.floor(F.col("node") / fan_in).cast("long").alias("node"), "body")
        vectors = stored(up.groupBy("node").applyInArrow(added, "node long, body binary"))
    top = vectors.first()
    return np.frombuffer(bytes(top.body), np.int64) if top else np.zeros(0, np.int64)


class PairCounts(NamedTuple):
    hashed: PerfectHash
    counts: np.ndarray
    best: np.ndarray  # by B id: its highest count

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs (0 for one that was never linked), and whether they are their B id's highest."""
        at = self.hashed.find(keys)
        n = np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(keys), np.int64)
        return n, (n > 0) & (n == self.best[keys & 0xFFFFFFFF]) if len(self.best) else n > 0


def count_pairs(ids: DataFrame, path_a: str, path_b: str) -> PairCounts:
    """Counts of all pairs that are linked in ``encoded`` documents."""
    both = tokenizers(path_a, path_b)
    partial = stored(partial_counts(ids, path_a, path_b))
    distinct = stored(partial.select("pair").distinct())
    bound = pair_bound(both)
    if (n := distinct.count()) > bound:
        raise ValueError(f"{n} distinct pairs, but the vocabularies allow {bound} at most")
    hashed = PerfectHash(np.sort(distinct.toArrow().column("pair").to_numpy().astype(np.int64)))
    counts = summed(partial, hashed)
    best = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(best, hashed.keys & 0xFFFFFFFF, counts)
    return PairCounts(hashed, counts, best)


def pair_table(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, n, best) of every linked pair of ids; under ``pair_bound`` rows."""
    found, spark = count_pairs(encoded(docs.withColumn("doc_id", F.lit(0)), path_a, path_b, text=text), path_a, path_b), docs.sparkSession
    keys = found.hashed.keys
    _, best = found.of(keys)
    table = pa.table({"a_id": keys >> 32, "b_id": keys & 0xFFFFFFFF, "n": np.asarray(found.counts, np.int64), "best": best})
    return spark.createDataFrame(table, "a_id long, b_id long, n long, best boolean")


GROUP = "struct<a_ids: array<long>, b_ids: array<long>, start: long, stop: long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` with ``groups``: the smallest runs of A and B ids over the same bytes of blank + text, with that range. A
    text that is null, empty or not given back by one side has none. An existing column of that name is replaced."""
    docs = docs.drop("groups")
    kind = pa.struct([("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("start", pa.int64()), ("stop", pa.int64())])

    def make(batch):
        both, out = tokenizers(path_a, path_b), []
        for x in align(encode(pc.cast(batch.column(text), pa.string()).to_pylist(), both), both):
            stop = np.cumsum(both.size_a[x.a])[x.at_a]
            cut_a, cut_b = np.split(x.a, x.at_a + 1), np.split(x.b, x.at_b + 1)
            out.append([{"a_ids": a, "b_ids": b, "start": int(s), "stop": int(e)} for a, b, s, e in zip(cut_a, cut_b, np.r_[0, stop], stop)])
        return [pa.array(out, pa.list_(kind))]

    return append(docs, text, [T.StructField("groups", T.ArrayType(T.StructType.fromDDL(GROUP[7:-1])))], make)


def digests(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A group ends with one link, as every token has a byte. Repeated rows count as often as they occur; null ids stay; an
    empty table gives no rows; other columns are not looked at."""
    ids = encoded(docs, path_a, path_b, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(count_pairs(ids, path_a, path_b))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        both, known = tokenizers(path_a, path_b), shared.value
        for batch in pieces(batches, "a"):
            found = align(_ids(batch), both)
            links = [len(x.at_a) for x in found]
            n, best = known.of(np.concatenate([pairs(x) for x in found]))
            upto = np.cumsum([0, *links])
            total, top = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(best)]
            made = [groups_text(x, both) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, pa.int64()) for v in (
                    [len(x.a) for x in found], [len(x.b) for x in found], links, links,
                    top[upto[1:]] - top[upto[:-1]], total[upto[1:]] - total[upto[:-1]])],
                 pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made], pa.string())],
                names=["doc_id", *names, "groups_sha256"])

    return ids.mapInArrow(run, f"doc_id long, {', '.join(f'{x} long' for x in names)}, groups_sha256 string")
