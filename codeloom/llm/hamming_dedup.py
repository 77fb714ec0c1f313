"""MinHash near-duplicates by a multi-index join on b-bit signatures.

A signature has SYMBOLS symbols of BITS bits. Texts with word-shingle similarity s differ in a symbol with probability
about 1 - s, so at 0.75 they differ in 16 of 64 on average and in more than RADIUS = 31 once in about 10**5 pairs. The
signature is split into 16 chunks of 4 symbols: two signatures that differ in at most 31 places differ in at most one
place of some chunk (pigeonhole: 16 * 2 > 31). Each chunk is indexed under its 4 values with one symbol left out (the
allowed chunk errors, enumerated), so every pair within the radius meets under at least one of 64 keys.
Candidates are confirmed exactly on their full shingle sets, but for those that a parity sketch refuses: the sketch holds
per slot whether an odd number of shingles falls there, so two sketches differ in at most as many bits as the sets differ
in shingles. A pair whose sketches differ in more bits than the similarity allows is refused for certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import constants, flat, mix, pieces, powers, stored, whole_groups
from codeloom.llm.components import components
from codeloom.session import broadcast_rows, cut

SYMBOLS, BITS, CHUNK, RADIUS = 64, 16, 4, 31
WORDS = 5
#: Least similarity in hundredths.
LEAST = 75
#: Slots of the parity sketch.
SLOTS = 512
#: Text bytes whose shingles are made at a time; a step takes about 40 times as much memory.
STEP_BYTES = 1 << 20
#: Rows of a bucket that are compared at a time; larger buckets are split into pairs of blocks.
BLOCK = 256

_FACTORS = constants(SYMBOLS, 11)
_PLACES = constants(WORDS, 12)
_LETTERS = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text: 5 words each, or all words of a text with fewer."""
    n = len(at) - 1
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * n
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    borders = at[1:-1][at[1:-1] < len(data)]
    first[borders] = word[borders]  # a word never goes on into the next text
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_LETTERS[data] * up[:len(data)], dtype=np.uint64)]
        h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        rows = np.searchsorted(begin, at)  # words of text i: rows[i] to rows[i + 1]
        five = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            five += h[k:len(h) - WORDS + 1 + k] * _PLACES[k] if len(five) else five
        five = mix(five)
        out = []
        for a, b in zip(rows[:-1], rows[1:]):
            if b - a >= WORDS:
                out.append(np.unique(five[a:b - WORDS + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(none)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a shingle set, independent of order; equal sets are one class."""
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=np.uint64), (mix(s ^ np.uint64(0xABCDEF)) * np.uint64(len(s) | 1)).sum(dtype=np.uint64)]).tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        least = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(s), 4096):
            least = np.minimum(least, (s[i:i + 4096, None] * _FACTORS).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def parity(s: np.ndarray) -> bytes:
    """One bit per slot: whether an odd number of shingles falls there. The top bits of a shingle's hash are its slot."""
    slot = (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=SLOTS) & 1).tobytes()


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """False where two parity sketches prove the sets too different; ``sizes`` are the sums of the set sizes. With
    symmetric difference d and size sum t the similarity is (t - d) / (t + d)."""
    least = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 + LEAST) * least <= (100 - LEAST) * sizes


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """n x 64 keys: chunk and left-out place in the high bits, the three symbols that stay below; injective."""
    chunks = signatures.reshape(len(signatures), -1, CHUNK).astype(np.int64)
    out = np.empty((len(signatures), chunks.shape[1], CHUNK), np.int64)
    name = np.arange(chunks.shape[1], dtype=np.int64) * CHUNK
    for m in range(CHUNK):
        a, b, c = [chunks[:, :, k] for k in range(CHUNK) if k != m]
        out[:, :, m] = ((name + m) << 48) | (a << 32) | (b << 16) | c
    return out.reshape(len(signatures), -1)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures: number of the first key that both have, -1 where they share none."""
    same = (a == b).reshape(len(a), SYMBOLS // CHUNK, CHUNK)
    hit = np.stack([same.sum(2) - same[:, :, m] == CHUNK - 1 for m in range(CHUNK)], axis=2).reshape(len(a), SYMBOLS)
    return np.where(hit.any(1), hit.argmax(1), -1)


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(doc_id, n_shingles, fp), classes(id, fp, n, sig, odd)) of ``docs(doc_id, text)``: one class per distinct
    non-empty shingle set, whose id is the smallest doc_id (a negative number from the fingerprint if all are null)."""

    def run(batches):
        for batch in pieces(batches, "text", STEP_BYTES):
            sets = shingles(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([parity(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "fp", "sig", "odd"])

    rows = stored(docs.mapInArrow(run, "doc_id long, n long, fp binary, sig binary, odd binary"))
    made = rows.where("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", "sig", "odd")])
    unnamed = -1 - F.shiftrightunsigned(F.xxhash64("fp"), 1)
    return rows.drop("sig", "odd"), stored(made.select(F.coalesce("doc_id", unnamed).alias("id"), "fp", "n", "sig", "odd"))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id, n_bucket) of the keys that two classes or more share."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            for i in range(0, len(sig), 2048):
                k = keys_of(sig[i:i + 2048])
                ids = batch.column("id").to_numpy(zero_copy_only=False)[i:i + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(ids, k.shape[1]))], names=["key", "id"])

    rows = classes.select("id", "sig").mapInArrow(run, "key long, id long")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_bucket")).where("n_bucket > 1")
    return stored(rows.join(shared, "key"))


def compared(buckets: DataFrame, classes: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs of classes in different components whose signatures are within the radius and whose set sizes and
    parity sketches allow the similarity: one row (key, bi, bj, ids, pairs) per bucket cell that has any, with the pairs packed.

    A pair belongs to the first key that it shares, so it is given out once. A bucket of over BLOCK rows is split into
    blocks, and every pair of blocks is a cell of its own, so no task gathers a bucket and no pair is a row. ``nearest``:
    a block meets only itself and the bucket's first block, and a class gives only its nearest partner there, which is
    linear in the bucket; else all blocks meet and all pairs are given."""
    rows = buckets.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(apart, "key", "left_semi").join(classes.select("id", "n", "sig", "odd"), "id")
    blocks = F.ceil(F.col("n_bucket") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    few = F.when(F.col("blk") == 0, every).otherwise(F.array(F.lit(0), F.col("blk")))
    rows = rows.withColumn("other", F.explode(few if nearest else every))
    rows = rows.select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "id", "comp", "n", "sig", "odd")

    def run(batches):
        for t in whole_groups(batches, ["key", "bi", "bj"]):
            key, bi, bj, blk, ids, comp, size = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "bi", "bj", "blk", "id", "comp", "n"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(-1, SLOTS // 64)
            same = (key[1:] == key[:-1]) & (bi[1:] == bi[:-1]) & (bj[1:] == bj[:-1])
            group = np.r_[0, np.cumsum(~same)]
            best, partner = np.full(len(ids), SYMBOLS + 1), np.full(len(ids), -1)
            found: list[np.ndarray] = []
            left = np.arange(len(ids) - 1)
            d = 0
            while len(left):
                d += 1
                left = left[left < len(ids) - d]
                left = left[group[left] == group[left + d]]
                for s in range(0, len(left), 1 << 16):
                    i = left[s:s + (1 << 16)]
                    j = i + d
                    ok = (comp[i] != comp[j]) & ((blk[i] != blk[j]) | (bi[i] == bj[i]))
                    ok &= 100 * np.minimum(size[i], size[j]) >= LEAST * np.maximum(size[i], size[j])
                    i, j = i[ok], j[ok]
                    ok = may_link(odd[i], odd[j], size[i] + size[j])
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    a, b = sig[i], sig[j]
                    dist = (a != b).sum(1)
                    ok = dist <= RADIUS
                    ok[ok] = first_key(a[ok], b[ok]) == (key[i[ok]] >> 48)
                    i, j, dist = i[ok], j[ok], dist[ok]
                    if nearest:
                        for x, y in ((i, j), (j, i)):
                            closer = (dist < best[x]) | ((dist == best[x]) & (ids[y] < ids[partner[x]]))
                            best[x[closer]], partner[x[closer]] = dist[closer], y[closer]
                    else:
                        found.append(np.stack([i, j], axis=1))
            if nearest:
                x = np.flatnonzero(partner >= 0)
                found = [np.unique(np.sort(np.stack([x, partner[x]], axis=1), axis=1), axis=0)]
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            pairs = pairs[np.argsort(group[pairs[:, 0]], kind="stable")]
            turn = np.flatnonzero(np.r_[True, np.diff(group[pairs[:, 0]]) != 0, True]) if len(pairs) else np.zeros(1, int)
            cells = [pairs[x:y] for x, y in zip(turn[:-1], turn[1:])]
            at = np.array([c[0, 0] for c in cells], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(key[at]), pa.array(bi[at]), pa.array(bj[at]), pa.array([ids[np.unique(c)] for c in cells], pa.list_(pa.int64())),
                pa.array([ids[c].astype(np.int64).tobytes() for c in cells], pa.binary())], names=["key", "bi", "bj", "ids", "pairs"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(
        run, "key long, bi int, bj int, ids array<long>, pairs binary")


def confirmed(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose full sets have 100 * intersection >= 75 * union. ``sets(id, n, set)``.

    A set is sent once to each cell that has pairs of it; a cell holds the sets of two blocks at most."""
    at = ["key", "bi", "bj"]
    who = cells.select(*at, F.explode("ids").alias("id"))
    given = who.join(sets.select("id", "set"), "id").select(*at, F.lit(0).alias("kind"), "id", F.col("set").alias("body"))
    asked = cells.select(*at, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("pairs").alias("body"))

    def run(batches):
        cell, held = None, {}
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in at)))
            kind, ids, body = batch.column("kind").to_pylist(), batch.column("id").to_pylist(), batch.column("body")
            links = []
            for i in range(batch.num_rows):
                if where[i] != cell:
                    cell, held = where[i], {}
                if kind[i] == 0:
                    held[ids[i]] = np.frombuffer(body[i].as_py(), np.uint64)
                    continue
                for a, b in np.frombuffer(body[i].as_py(), np.int64).reshape(-1, 2).tolist():
                    p, q = held[a], held[b]
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= LEAST * (len(p) + len(q) - common):
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return given.unionByName(asked).repartition(n, *at).sortWithinPartitions(*at, "kind").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, set) of the classes in ``wanted(id)``, read again from the text of one document each. The wanted ids are
    broadcast only where their count is small; otherwise texts and ids are shuffled."""
    chosen, n = cut(classes.join(wanted, "id", "left_semi").select("id", "fp"))
    few = n <= broadcast_rows(docs.sparkSession)
    named = docs.join((F.broadcast if few else lambda x: x)(chosen.where("id >= 0").select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    unnamed = docs.where("doc_id is null")

    def run(batches):
        for batch in pieces(batches, "text", STEP_BYTES):
            sets = [s for s in shingles(*flat(batch.column("text"))) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "n", "set"])

    made = named.unionByName(unnamed).select("text").mapInArrow(run, "fp binary, n long, set binary")
    # A document id may stand on several rows, so the fingerprint decides; equal fingerprints are equal sets.
    return stored(made.groupBy("fp").agg(F.first("n").alias("n"), F.first("set").alias("set")).join(chosen, "fp").select("id", "n", "set"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows(doc_id, n_shingles, fp) per document and labels(fp, component_id) per class of equal sets.

    First every class meets its nearest partner in two blocks of each of its buckets, which joins most of a group by few
    comparisons; then all pairs that are still in different components and within the radius are confirmed or refused,
    so what the first step leaves out is not lost."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, classes = classes_of(docs)
    buckets = bucket_rows(classes)
    sets = sets_of(docs, classes, buckets.select("id").distinct())
    nobody = docs.sparkSession.createDataFrame([], "id long, component long")
    links = stored(confirmed(stored(compared(buckets, classes, nobody, True)), sets))
    labels = components(links)
    rest = confirmed(stored(compared(buckets, classes, labels, False)), sets)
    joined = components(links.unionByName(rest))
    out = classes.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return rows, out.select("fp", F.col("component").alias("component_id"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are runs of bytes other than blank and 0x09-0x0D, A-Z counted as a-z. A text without words (or null) has an
    empty set, links with nothing and is its own component. Rows with equal sets are one class, whatever their ids;
    null ids are rows like others, and where all ids of a class are null a negative number stands for them and they are
    kept. An empty table gives no rows; other columns are not looked at."""
    rows, labels = near_duplicates(docs, doc_id, text)
    found = rows.join(labels, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
