"""Removal of long repeated byte strings with suffix arrays of content-defined shards.

Every window of ``length`` bytes has an anchor, the string of about a third of that inside it with the smallest hash
(the leftmost of equal ones), so equal windows have equal anchors at equal places. Neighbouring windows with the same
anchor form a segment. Segments are dealt to shards by anchor: windows that are equal meet in one shard, whatever
documents they come from. Equal segments fall together beforehand by hash; a shard's suffix array (induced sorting) and
permuted common prefixes then show which windows of different segments are equal. In a stretch that repeats itself (one
line over and over, a run of one letter) every period is a segment like the one before; together they are one row.

An anchor in over CROWD different segments is dealt again: windows are halved by the place of the anchor in them, and
each half goes by the core, the bytes that all its windows would share. Equal windows have equal cores, so they still
meet; a core is longer in each round, and halves that are equal throughout fall together by hash. A segment gives at
most two halves a round, and only where its half is still crowded: about two logarithms of its windows, not one row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import flat, mix, pieces, powers, stored, whole_groups
from codeloom.llm.suffix_array import permuted_lcp, suffix_array
from codeloom.session import broadcast_rows, cut, cut_counted, scratch

LENGTH, CROWD = 400, 200
#: Bytes of text one step holds (also of one very long text), and bytes of segments one suffix array is built over.
STEP, SHARD = 1 << 20, 1 << 20
_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(4242))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(_CODES[data] * up[:len(data)], dtype=np.uint64)]


def hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the strings from a to b; equal strings have equal ones."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def anchor_length(length: int) -> int:
    return max(1, length * 8 // 25)


def segments(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, reach, bytes before the anchor in the first window, anchor hash, segment hash) of all
    segments; windows count inside the text. Equal segments that follow each other, as the periods of a text that repeats
    itself, are one: the first, with the last window of all of them as its reach, which else is its own last window."""
    wide = anchor_length(length)
    n, width = len(data), length - wide + 1
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 5 + (np.uint64,) * 2)
    if n < length:
        return none
    where = np.arange(n - length + 1)
    text = np.searchsorted(at, where, "right") - 1
    where = where[where + length <= at[text + 1]]
    if not len(where):
        return none
    sums = prefix_sums(data)
    k = np.arange(n - wide + 1)
    h = hashes(sums, k, k + wide)
    bits = np.uint64(27)
    keyed = (h >> bits << bits) | k.astype(np.uint64)  # the position breaks ties: leftmost
    pad = -len(keyed) % width
    block = np.r_[keyed, np.full(pad, ~np.uint64(0))].reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[where], ahead[where + width - 1])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1] + 1)])
    first, last = where[new], where[np.r_[new[1:], len(where)] - 1]
    owner = np.searchsorted(at, first, "right") - 1
    off, name, content = anchor[new] - first, h[anchor[new]], hashes(sums, first, last + length)
    again = (name[1:] == name[:-1]) & (content[1:] == content[:-1]) & (owner[1:] == owner[:-1])
    one = np.flatnonzero(np.r_[True, ~again])
    reach = last[np.r_[one[1:] - 1, len(first) - 1]]
    return tuple(x[one] for x in (owner, first - at[owner], last - at[owner])) + (reach - at[owner[one]],) + tuple(x[one] for x in (off, name, content))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the text (null: empty) and its 128-bit key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def all_segments(texts: DataFrame, length: int) -> DataFrame:
    """(key, s0, s1, reach, off, anchor, h) of every segment of ``texts(key, text)``. A text over STEP bytes is taken in steps that share
    length - 1 bytes, so every window lies in one step; a segment may end with a step."""

    def run(batches):
        for batch in pieces(batches, "text", STEP):
            data, at = flat(batch.column("text"))
            steps = range(0, max(1, len(data) - length + 1), STEP) if batch.num_rows == 1 else [0]
            for a in steps:
                part, borders = (data[a:a + STEP + length - 1], None) if batch.num_rows == 1 else (data, at)
                owner, s0, s1, reach, off, anchor, h = segments(part, np.array([0, len(part)]) if borders is None else borders, length)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(owner)), pa.array(s0 + a), pa.array(s1 + a), pa.array(reach + a),
                    pa.array(off.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64))],
                    names=["key", "s0", "s1", "reach", "off", "anchor", "h"])

    return texts.mapInArrow(run, "key binary, s0 long, s1 long, reach long, off int, anchor long, h long")


_SEGMENT = "g long, h long, key binary, s long, off int, body binary"


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"g": pa.int64(), "h": pa.int64(), "key": pa.binary(), "s": pa.int64(), "off": pa.int32(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 6, kinds.values())], names=[*kinds])


def fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments: (g, h, key, s, off, body), g being the anchor. ``wanted(key, doc_id, need)`` lists them per text."""

    def run(batches):
        for batch in pieces(batches, "text", STEP):
            out = []
            for key, text, need in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "need"))):
                raw = text.encode()
                out += [(x["anchor"], x["h"], key, x["s0"], x["off"], raw[x["s0"]:x["s1"] + length]) for x in need]
            yield _segment_batch(out)

    n, here = wanted.count(), texts.withColumn("_id", F.coalesce("doc_id", F.lit(-1 << 63)))
    wanted = wanted.withColumn("_id", F.coalesce("doc_id", F.lit(-1 << 63))).drop("doc_id")
    if n <= broadcast_rows(texts.sparkSession):  # ids only: 24 bytes a row; else the join below shuffles all texts
        here = here.join(F.broadcast(wanted.select("_id", "key")), ["_id", "key"], "left_semi")
    return here.join(wanted, ["_id", "key"]).select("key", "text", "need").mapInArrow(run, _SEGMENT)


def dealt_again(crowded: DataFrame, length: int, block: int) -> DataFrame:
    """The segments in parts whose anchors stand in one block of ``block`` places, grouped anew by the bytes that all windows
    of the block share."""

    def run(batches):
        for batch in batches:
            out = []
            for g, key, s, off, body in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "s", "off", "body"))):
                least = off - (len(body) - length)  # bytes before the anchor in the last window
                for k in range(least // block, off // block + 1):
                    low, high = k * block, (k + 1) * block - 1
                    core = body[max(0, off - low):max(0, off - high + length)]
                    a, b = off - min(high, off), off - max(low, least)
                    part = body[a:b + length]
                    name = hashlib.blake2b(core, digest_size=8, key=g.to_bytes(8, "little", signed=True), salt=k.to_bytes(8, "little"))
                    content = hashlib.blake2b(part, digest_size=8)
                    out.append((*(int.from_bytes(x.digest(), "little", signed=True) for x in (name, content)), key, s + a, off - a, part))
            yield _segment_batch(out)

    return crowded.select("g", "key", "s", "off", "body").mapInArrow(run, _SEGMENT)


def shared_windows(found: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of repeated windows in segments of the same group: (key, a, b), first and last window."""

    def run(batches):
        for t in whole_groups(batches, ["g"]):
            g, h, s = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("g", "h", "s"))
            rows = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])])  # a repeated row is one segment
            body = t.column("body").to_pylist()
            key = t.column("key").to_pylist()
            size = np.array([len(body[r]) + 1 for r in rows])
            # Shards end between groups, so that equal windows stay together.
            turn = np.flatnonzero(np.r_[True, g[rows][1:] != g[rows][:-1], True])
            total = np.r_[0, np.cumsum(size)]
            a = 0
            while a < len(turn) - 1:
                b = max(a + 1, int(np.searchsorted(total[turn], total[turn[a]] + SHARD, "right")) - 1)
                part = rows[turn[a]:turn[b]]
                yield one_shard([body[r] for r in part], [key[r] for r in part], s[part], length, keep_first)
                a = b

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "g").sortWithinPartitions("g", "h").mapInArrow(run, "key binary, a long, b long")


def one_shard(bodies: list[bytes], keys: list[bytes], first: np.ndarray, length: int, keep_first: bool) -> pa.RecordBatch:
    t = np.frombuffer(b"".join(x + b"\0" for x in bodies), np.uint8).astype(np.int64) + 1
    size = np.array([len(x) + 1 for x in bodies])
    end = np.cumsum(size) - 1
    t[end] = 0  # between segments; no text letter is 0
    order = suffix_array(t, 257)
    lcp, before = permuted_lcp(t, order)
    left = np.repeat(end, size) - np.arange(len(t))
    shift = first - (end + 1 - size)  # from a place in the shard to one in the text
    flag = np.zeros(len(t), bool)
    if keep_first:  # neighbours in the suffix array with a long common prefix are one window; the first in its text stays
        whole = order[left[order] >= length]
        group = np.cumsum(lcp[whole] < length)
        of = np.searchsorted(end, whole)
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        place = np.lexsort((whole + shift[of], np.array([rank[k] for k in keys])[of], group))
        again = place[1:][group[place[1:]] == group[place[:-1]]]
        flag[whole[again]] = True
    else:
        hit = np.flatnonzero((lcp >= length) & (left >= length))
        flag[hit] = flag[before[hit]] = True
    on = np.flatnonzero(flag)
    begin = on[np.r_[True, on[1:] != on[:-1] + 1]] if len(on) else on
    stop = on[np.r_[on[1:] != on[:-1] + 1, True]] if len(on) else on
    owner = np.searchsorted(end, begin)
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in owner], pa.binary()), pa.array(begin + shift[owner]),
                                       pa.array(stop + shift[owner])], names=["key", "a", "b"])


def repeated_runs(texts: DataFrame, copies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(key, a, b): runs of windows that occur elsewhere, in different texts or in one; with ``keep_first`` without the first
    occurrence, by text hash and position. ``copies(key, doc_id)`` names one document per text."""
    # Computed twice rather than stored: most anchors stand alone, and only the segments of the others are needed.
    every = all_segments(texts.select("key", "text"), length)
    twice = every.groupBy("anchor").agg(F.sum(F.when(F.col("reach") > F.col("s1"), 2).otherwise(1)).alias("n")).where("n > 1").select("anchor")
    rows = stored(every.join(twice, "anchor", "left_semi").select("key", "s0", "s1", "reach", "off", "anchor", "h"))
    place = F.struct("key", "s0", "s1", "off")
    kinds = stored(rows.groupBy("anchor", "h").agg(
        F.min(place).alias("one"), F.max(place).alias("other"), F.max(F.col("reach") > F.col("s1")).alias("again")).select(
        "anchor", "h", "one", (F.col("again") | (F.col("one") != F.col("other"))).alias("many")))
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("many")).cast("int")).alias("open"))
    # Where every segment of an anchor has copies, all of it is repeated anyway; which copy is first still has to be seen.
    open_ = per_anchor.where("n > 1" if keep_first else "n > 1 and open = 1").select("anchor")
    asked = kinds.join(open_, "anchor").select(F.col("one.key").alias("key"), F.struct(
        "anchor", "h", F.col("one.s0").alias("s0"), F.col("one.s1").alias("s1"), F.col("one.off").alias("off")).alias("x"))
    wanted = stored(asked.groupBy("key").agg(F.collect_list("x").alias("need")).join(copies.select("key", "doc_id"), "key"))
    copied = rows.join(kinds.where("many").select("anchor", "h", "one"), ["anchor", "h"])
    if keep_first:  # of equal segments in a row the first stays
        copied = copied.withColumn("s0", F.expr("if(key = one.key and s0 = one.s0, s1 + 1, s0)")).where("s0 <= reach")
    runs = copied.select("key", F.col("s0").alias("a"), F.col("reach").alias("b"))
    found, block = stored(fetch(texts, wanted, length)), 1 << (length - anchor_length(length)).bit_length()
    while True:
        # Different bodies per group; one body stands for its equals, which are repeated except where the first stays.
        sizes, seen = cut_counted(found.select("g", "h").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                                  {"crowds": F.count_if(F.col("n") > CROWD)})
        small = found.join(sizes.where(F.col("n") <= CROWD).select("g"), "g", "left_semi")
        # Stored round by round: the plan that reads all runs holds no round, whatever their number.
        runs = runs.unionByName(stored(shared_windows(small, length, keep_first)))
        if not seen["crowds"]:
            return runs
        crowds = sizes.where(F.col("n") > CROWD).select("g")
        block //= 2
        parts = stored(dealt_again(found.join(crowds, "g", "left_semi").dropDuplicates(["g", "h"]), length, block))
        here = F.struct("key", "s")
        kinds = stored(parts.groupBy("g", "h").agg(F.min(here).alias("one"), F.max(here).alias("other")).withColumn(
            "many", F.col("one") != F.col("other")))
        equal = parts.join(kinds.where("many").select("g", "h", "one"), ["g", "h"])
        if keep_first:
            equal = equal.where("not (key = one.key and s = one.s)")
        runs = runs.unionByName(stored(equal.select("key", F.col("s").alias("a"), (F.col("s") + F.octet_length("body") - length).cast("long").alias("b"))))
        found = stored(parts.join(kinds.select("g", "h", "one"), ["g", "h"]).where("key = one.key and s = one.s").drop("one"))


def cut_spans(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(key, n_removed, n_spans, kept) of ``texts(key, text)`` that have runs; ``kept`` holds the remaining bytes."""

    def run(batches):
        for batch in pieces(batches, "text"):
            out = {"key": [], "n_removed": [], "n_spans": [], "kept": []}
            for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                raw = text.encode()
                keep, at, spans_out, reach = [], 0, 0, -1
                for x in sorted((x["a"], x["b"]) for x in spans):
                    a, b = x[0], x[1] + length
                    if a > reach:
                        keep.append(raw[max(reach, 0):a])
                        spans_out += 1
                    reach = max(reach, b)
                keep.append(raw[reach:])
                kept = b"".join(keep)
                for k, v in zip(out, (key, len(raw) - len(kept), spans_out, kept)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), pa.array(out["n_removed"], pa.int64()),
                                              pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], names=[*out])

    spans, n = cut(runs.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    if n <= broadcast_rows(texts.sparkSession):
        texts = texts.join(F.broadcast(spans.select("key")), "key", "left_semi")
    return texts.join(spans, "key").select("key", "text", "spans").mapInArrow(run, "key binary, n_removed long, n_spans long, kept binary")


def found_cuts(docs: DataFrame, length: int, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows(doc_id, key, n_bytes, sha), cuts(key, n_removed, n_spans, kept)) of ``docs(doc_id, text)``. Without ``keep_first``,
    texts that occur more than once and have ``length`` bytes or more lose everything, so they need no spans."""
    with scratch(docs.sparkSession) as keep:
        return tuple(map(keep, _found_cuts(docs, length, keep_first)))


def _found_cuts(docs: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    texts = keyed(docs)
    rows = stored(texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    copies = stored(rows.where(F.col("n_bytes") >= length).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("n_bytes")))
    runs = repeated_runs(texts, copies, length, keep_first)
    if keep_first:
        return rows, stored(cut_spans(texts, runs, length).dropDuplicates(["key"]))
    part = cut_spans(texts, runs.join(copies.where("n > 1").select("key"), "key", "left_anti"), length)
    whole = copies.where("n > 1").select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return rows, stored(part.unionByName(whole))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, cut (whether anything was removed) of every row.

    A null text counts as empty. Texts under ``length`` bytes keep everything. Repeated rows are repeats of each other, with
    or without an id. An empty table gives no rows; other columns are not looked at."""
    rows, cuts = found_cuts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), length)
    none = F.lit(0).cast("long")
    return rows.join(cuts.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha")), "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"), (F.coalesce("n_removed", none) > 0).alias("cut"))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text``; bytes of letters that a cut breaks are dropped. A null text
    stays null, other columns stay as they are. With ``keep_first`` the first occurrence of every string stays, by text
    hash and position, and rows with one and the same text count as one text, which is cut alike in all of them."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    _, cuts = found_cuts(given, length, keep_first)

    def decoded(batches):
        for batch in batches:
            kept = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.string())], names=["_key", "_kept"])

    left = cuts.select("key", "kept").mapInArrow(decoded, "_key binary, _kept string")
    keyed_docs = docs.withColumn("_key", F.unhex(F.md5(body.cast("binary"))))
    return keyed_docs.join(left, "_key", "left").withColumn(text, F.coalesce("_kept", text)).select(*docs.columns)
