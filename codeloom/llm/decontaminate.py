"""Benchmark decontamination with generalised suffix automata over the words of the test items.

Items are cut into blocks of a bounded number of words; each block becomes one automaton, built in a task and stored as
flat arrays. Documents stream through the automata of up to PASS_BLOCKS blocks at once; every pass is narrow (no
shuffle), so more items mean more passes, not larger tasks. In a pass, words are hashed with numpy; only runs of words
that stand in some item are read word for word (exactly, by their bytes) and walked through the automaton, which gives
the longest match that ends at each word.
"""

from __future__ import annotations

import hashlib
import io
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.base import flat, mix, pieces, powers, stored

#: Words of an item that make a window; an item of fewer words is one window.
WINDOW = 10
#: Words in one automaton (at most two states a word), and automata that one pass over the documents holds.
BLOCK_WORDS, PASS_BLOCKS = 250_000, 8
#: Text bytes that are split into words at once, also inside one very long text.
STEP = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1111))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word of lower-cased texts laid end to end with borders ``at``."""
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    return (np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]])),
            np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; equal words have equal ones."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_CODES[data] * up[:len(data)], dtype=np.uint64)]
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def words_of(text: str | None) -> list[bytes]:
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(*(x.tolist() for x in word_spans(data, np.array([0, len(data)]))))]


class Automaton:
    """A generalised suffix automaton of word sequences. ``window[s]`` is the state of the window that ends a match in
    state s (or -1), ``short[s]`` the nearest state up the suffix links in which a whole shorter item ends, and
    ``items[s]`` the numbers of the items that hold the window, or are the short item, of state s."""

    def __init__(self, texts: list[list[bytes]], ids: list[int | None], width: int):
        self.width, self.vocab = width, {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in t] for t in texts]
        length, link, to = [0], [-1], [{}]

        def split(p: int, w: int) -> int:
            """The state of p's longest string and w, where it exists; cut off from longer ones if need be."""
            q = to[p][w]
            if length[q] == length[p] + 1:
                return q
            length.append(length[p] + 1)
            link.append(link[q])
            to.append(dict(to[q]))
            link[q] = clone = len(length) - 1
            while p >= 0 and to[p].get(w) == q:
                to[p][w] = clone
                p = link[p]
            return clone

        for seq in coded:
            last = 0
            for w in seq:
                if w in to[last]:
                    last = split(last, w)
                    continue
                length.append(length[last] + 1)
                link.append(0)
                to.append({})
                new, p = len(length) - 1, last
                while p >= 0 and w not in to[p]:
                    to[p][w] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, w)
                last = new
        self.length, self.link = array("q", length), array("q", link)
        n = len(self.vocab) + 1
        edges = sorted((s * n + w, t) for s, out in enumerate(to) for w, t in out.items())
        self.keys, self.to = array("q", [k for k, _ in edges]), array("q", [t for _, t in edges])
        self.window, self.short = array("q", [-1]) * len(length), array("q", [-1]) * len(length)
        self.items: dict[int, set] = {}
        ends: dict[int, int] = {}
        for seq, i in zip(coded, ids):  # an item shorter than a window is walked exactly: its own whole state
            if 0 < len(seq) < width:
                s = 0
                for w in seq:
                    s = self.step(s, w)
                ends[s] = len(seq)
                self.items.setdefault(s, set()).add(i)
        self.ends = ends
        for s in sorted(range(1, len(length)), key=length.__getitem__):
            up = link[s]
            self.window[s] = (s if length[up] < width else self.window[up]) if length[s] >= width else -1
            self.short[s] = s if s in ends else self.short[up]
        for seq, i in zip(coded, ids):
            for _, s, matched in self.walk(seq):
                if matched >= width:
                    self.items.setdefault(self.window[s], set()).add(i)
        self.least = min([width, *ends.values()])

    def step(self, s: int, w: int) -> int:
        key = s * (len(self.vocab) + 1) + w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, words matched) after every word: the longest string of any item that ends there."""
        s = matched = 0
        for i, w in enumerate(seq):
            while (t := self.step(s, w)) < 0 and s:
                s = self.link[s]
                matched = self.length[s]
            if t >= 0:
                s, matched = t, matched + 1
            yield i, s, matched

    def hits(self, seq: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first word, last word, items) of every window occurrence that is not covered by the text before it."""
        for i, s, matched in self.walk(seq):
            if matched >= self.width:
                yield i - self.width + 1, i, self.items[self.window[s]]
            e = self.short[s]
            while e >= 0:
                n = self.ends[e]
                if n <= matched:
                    yield i - n + 1, i, self.items[e]
                e = self.short[self.link[e]] if self.link[e] >= 0 else -1

    def dump(self) -> bytes:
        out = io.BytesIO()
        owned = sorted(self.items)
        width = np.array([len(self.items[s]) for s in owned], np.int64)
        np.savez(out, vocab=np.frombuffer(b"\0".join(self.vocab), np.uint8), length=self.length, link=self.link, keys=self.keys,
                 to=self.to, window=self.window, short=self.short, ends=np.array([*self.ends.items()], np.int64).reshape(-1, 2),
                 owned=np.array(owned, np.int64), n_owned=width, fixed=np.array([self.width, self.least]),
                 items=np.array(["" if i is None else f"={i}" for s in owned for i in self.items[s]], dtype="U"))
        return out.getvalue()

    @classmethod
    def load(cls, body: bytes) -> Automaton:
        z, a = np.load(io.BytesIO(body)), cls.__new__(cls)
        a.vocab = {w: i for i, w in enumerate(z["vocab"].tobytes().split(b"\0"))}
        for name in ("length", "link", "keys", "to", "window", "short"):
            setattr(a, name, array("q", z[name].astype(np.int64).tobytes()))
        a.ends = dict(z["ends"].tolist())
        cuts = np.cumsum(z["n_owned"])[:-1]
        a.items = {s: {x[1:] for x in i.tolist() if x} for s, i in zip(z["owned"].tolist(), np.split(z["items"], cuts))}
        a.width, a.least = z["fixed"].tolist()
        return a


def automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, body): stored automata of all items, each of at most ``block_words`` words. A longer item is cut into
    parts that overlap by a window less one word, so no window is lost. Equal texts under one id are taken once; items
    without words are left out. Ids are kept as strings; a null id marks words, but is never listed."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).distinct()

    def parts(batches):
        for batch in pieces(batches, "text", STEP):
            out = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(t)
                step = block_words - window + 1
                for a in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    out.append((i, words[a:a + block_words]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.list_(pa.binary())),
                 pa.array([len(w) for _, w in out], pa.int64())], names=["id", "words", "n"])

    made = stored(rows.mapInArrow(parts, "id string, words array<binary>, n long"))
    # Sums per hash group first, so that the running sum sees a bounded number of rows; groups are split again by part.
    group = F.pmod(F.xxhash64("id", "words"), F.lit(1 << 16))
    sums = made.groupBy(group.alias("g")).agg(F.sum("n").alias("n"))
    first = sums.withColumn("before", F.sum("n").over(Window.orderBy("g")) - F.col("n")).drop("n")
    inner = Window.partitionBy("g").orderBy("id", "words").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("g", group).join(first, "g").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    blocks = placed.withColumn("block", F.floor(F.col("at") / block_words).cast("long")).select("block", "id", "words")

    def build(key, t):
        a = Automaton(t.column("words").to_pylist(), t.column("id").to_pylist(), window)
        return pa.table({"block": [key[0].as_py()], "body": pa.array([a.dump()], pa.binary())})

    return stored(blocks.groupBy("block").applyInArrow(build, "block long, body binary"))


def _known(data: np.ndarray, at: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word borders and whether each word's hash is in ``vocab``; texts over STEP bytes are taken in steps that end
    where a word ends."""
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + STEP)
        while b < len(data) and _IS_WORD[data[b]] and _IS_WORD[data[b - 1]]:  # inside a word: go on to its end
            gap = np.flatnonzero(~_IS_WORD[data[b:b + STEP]])
            b += int(gap[0]) if len(gap) else min(STEP, len(data) - b)
        part = data[a:b]
        borders = at[(at >= a) & (at <= b)] - a
        first, last = word_spans(part, borders)
        h = word_hashes(part, first, last)
        there = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        out.append((first + a, last + a, vocab[there] == h))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(texts: pa.Array, machines: list[Automaton], vocab: np.ndarray) -> tuple[list[int], list[list], list[list]]:
    """Per text: number of words, hit runs [(word, words, byte, bytes)], items as strings."""
    data, at = flat(texts)
    data = _LOWER[data]
    first, last, known = _known(data, at, vocab)
    border = np.searchsorted(first, at)
    count = np.zeros(len(first) + 1, np.int32)
    found: list[set] = [set() for _ in range(len(texts))]
    edge = np.zeros(len(first) + 1, bool)
    edge[border] = True
    begin = np.flatnonzero(known & (edge[:-1] | ~np.r_[False, known[:-1]]))
    end = np.flatnonzero(known & (edge[1:] | ~np.r_[known[1:], False])) + 1
    long = end - begin >= min(m.least for m in machines)
    for a, b in zip(begin[long].tolist(), end[long].tolist()):
        doc = int(np.searchsorted(border, a, "right")) - 1
        raw = data[first[a]:last[b - 1]].tobytes()
        spans = [*zip((first[a:b] - first[a]).tolist(), (last[a:b] - first[a]).tolist())]
        for m in machines:
            for i, j, items in m.hits([m.vocab.get(raw[x:y], len(m.vocab)) for x, y in spans]):
                count[a + i] += 1
                count[a + j + 1] -= 1
                found[doc] |= items
    on = np.cumsum(count[:-1]) > 0
    begin = np.flatnonzero(on & (edge[:-1] | ~np.r_[False, on[:-1]]))
    end = np.flatnonzero(on & (edge[1:] | ~np.r_[on[1:], False])) + 1
    spans_of: list[list] = [[] for _ in range(len(texts))]
    for a, b in zip(begin.tolist(), end.tolist()):
        doc = int(np.searchsorted(border, a, "right")) - 1
        spans_of[doc].append((a - int(border[doc]), b - a, int(first[a] - at[doc]), int(last[b - 1] - first[a])))
    return np.diff(border).tolist(), spans_of, [sorted(f) for f in found]


def _merge(old: list, new: list) -> list:
    """Both lists of hit runs as one list of maximal runs."""
    out: list = []
    for w, n, b, m in sorted([*(tuple(x.values()) for x in old), *new]):
        if out and w <= out[-1][0] + out[-1][1]:
            pw, pn, pb, pm = out[-1]
            out[-1] = (pw, max(pn, w + n - pw), pb, max(pm, b + m - pb))
        else:
            out.append((w, n, b, m))
    return out


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


SPANS = "array<struct<word: long, n_words: long, byte: long, n_bytes: long>>"


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hit_spans`` (maximal runs of words inside window occurrences, with their places
    in the lower-cased words and in the UTF-8 bytes) and ``hit_items`` (ids with an occurring window as strings, sorted).

    A null text has no words. Rows are independent: repeated rows, null ids and very long texts need no care; columns of
    the three new names are replaced, others stay. Without items nothing is hit; an empty table stays empty."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    kept = docs.schema.fields
    body = _unused(docs, "_text")
    out = docs.withColumns({body: F.coalesce(F.col(text).cast("string"), F.lit("")), "n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(SPANS), "hit_items": F.array().cast("array<string>")})
    machines = automata(benchmark, item_id, item_text, window, block_words)
    blocks = sorted(r.block for r in machines.select("block").collect())
    schema = out.schema
    for k in range(0, max(1, len(blocks)), pass_blocks):
        group = blocks[k:k + pass_blocks]
        bodies = spark.sparkContext.broadcast([bytes(r.body) for r in machines.where(F.col("block").isin(group)).collect()] if group else [])

        def run(batches, bodies=bodies):
            loaded = [Automaton.load(b) for b in bodies.value] or [Automaton([], [], window)]
            vocab = np.unique(np.concatenate([_vocabulary_hashes(m) for m in loaded]))
            for batch in pieces(batches, body, STEP):
                n, spans, items = _scan(batch.column(body), loaded, vocab)
                old = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
                spans = [_merge(o, s) for o, s in zip(old[0], spans)]
                items = [sorted({*o, *i}) for o, i in zip(old[1], items)]
                arrays = dict(zip(batch.schema.names, batch.columns))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "n_words", "byte", "n_bytes")]))
                arrays["n_words"] = pa.array(n, pa.int64())
                arrays["hit_spans"] = pa.array([[dict(zip(("word", "n_words", "byte", "n_bytes"), s)) for s in x] for x in spans], kind)
                arrays["hit_items"] = pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*arrays.values()], names=[*arrays])

        out = out.mapInArrow(run, schema)
        if k + pass_blocks < len(blocks):
            out = stored(out)
    return out.select(*[F.col(f"`{f.name}`") for f in kept], "n_words", "hit_spans", "hit_items")


def _vocabulary_hashes(m: Automaton) -> np.ndarray:
    words = [*m.vocab] or [b"\0"]
    at = np.cumsum([0, *map(len, words)])
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", longest: int = 0, coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without contamination: hit runs of more than ``longest`` words are removed from the text, and documents
    in which hit words are more than the share ``coverage`` of all words are dropped. Null texts stay null."""
    rows = marked(docs, benchmark, text, **options)
    total = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    whole = F.col(text).cast("string")
    bad = F.filter("hit_spans", lambda s: s["n_words"] > longest)
    # What stands between the removed runs: from the end of one to the start of the next, in bytes.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(bad, lambda s: s["byte"] + s["n_bytes"]))
    stops = F.concat(F.transform(bad, lambda s: s["byte"]), F.array(F.octet_length(whole).cast("long")))
    left = F.zip_with(starts, stops, lambda a, b: F.substring(whole.cast("binary"), (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cleared = F.when(F.size(bad) == 0, F.col(text)).otherwise(F.array_join(left, ""))
    return rows.where(total <= coverage * F.col("n_words")).withColumn(text, cleared).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    rows = marked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
