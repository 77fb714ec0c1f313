"""Operators for training data against brute force on small tables, with nulls, copies, empty and clashing columns."""

import hashlib
import math
import random
import re
import string
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import bpe_trie, hamming_dedup, line_dedup, packing, quality, rp_forest, sharding, suffix_dedup, url_filter, vector_graph
from codeloom.llm.base import ship
from codeloom.llm.suffix_array import permuted_lcp, suffix_array
from codeloom.session import cut

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = words(1, 300)
TEXTS = [LONG, LONG, LONG.replace("w7 ", "w8 ", 1), None, "", " \t", "one two", "one two", "ONE Two", "line a\nline b\nline c",
         "x\nline a\nline b\ny", words(2, 90) + " " + LONG[200:900] + " " + words(3, 90), "é" * 500, words(4, 20000), "a b " * 600,
         "it's we'LL don't 12½ 漢字 İΣ <|endoftext|> \x1c zero", "z" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", -1, "clash") for i, t in enumerate(TEXTS)] + [(None, "one two", "en", 0, "x"), (None, None, None, None, None), (0, LONG, "en", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, key string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_suffix_array_matches_sorting():
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        t = np.tile(rng.integers(0, 3, n), 1 + n % 3)
        text = t.tolist()
        order = suffix_array(t, 4)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp, before = permuted_lcp(t, order)
        for i, j in enumerate(before):
            k = 0
            while j >= 0 and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert lcp[i] == k


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-1]][:-1]).sum()), hashlib.sha256(kept).hexdigest(), bool(gone.any())))
    return out


def brute_later(texts, length):
    """What is left of distinct texts when the first occurrence of every string stays, by text hash and position."""
    raw = sorted({(t or "").encode() for t in texts}, key=lambda r: hashlib.md5(r).digest())
    seen, out = set(), {}
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if (w := r[i:i + length]) in seen:
                gone[i:i + length] = True
            seen.add(w)
        out[r.decode()] = bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore")
    return out


def crowded_texts():
    """One passage in many texts with other neighbours on both sides, also near its ends, and in families that share one side."""
    passage, rng = words(77, 120)[:500], np.random.default_rng(8)
    out = [words(100 + i, 40) + passage + words(300 + i, 40) for i in range(40)]
    out += [words(100 + i % 3, 60) + passage[:rng.integers(90, 500)] + words(500 + i, 50) for i in range(40)]
    return out + ["ab" * 400, "ab" * 300 + passage, passage * 2]


@pytest.mark.parametrize(("length", "crowd"), [(400, 200), (400, 1), (200, 5)])
def test_suffix_dedup(spark, docs, nothing, monkeypatch, length, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "STEP", 3000)
    small = docs.where("text is null or length(text) < 5000").select("doc_id", "text").unionByName(
        spark.createDataFrame([*enumerate(crowded_texts(), 1000)], "doc_id long, text string"))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(small, length=length).collect()]
    rows = small.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, brute_repeats([r.text for r in rows], length))]
    assert Counter(got) == Counter(want)
    later = brute_later([r.text for r in rows], length)
    kept = suffix_dedup.cleaned(small, length=length, keep_first=True).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r.doc_id, r.text if r.text is None else later[r.text]) for r in rows)


def test_suffix_dedup_stores_no_lone_segments_and_no_rounds_in_the_plan(spark, monkeypatch):
    rng = random.Random(5)
    lone = ["".join(rng.choices(string.ascii_lowercase, k=3000)) for _ in range(40)]
    texts = suffix_dedup.keyed(spark.createDataFrame([*enumerate([*lone, *crowded_texts()])], "doc_id long, text string"))
    alone = {hashlib.md5(t.encode()).digest() for t in lone}
    seen = []
    real = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df: seen.append(real(df)) or seen[-1])
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    runs = suffix_dedup.repeated_runs(texts, texts.select("key", "doc_id").dropDuplicates(["key"]), 200, True)
    first = next(t for t in seen if "anchor" in t.columns)
    assert first.count() > 0 and not alone & {bytes(r.key) for r in first.select("key").collect()}
    assert "MapInArrow" not in runs._jdf.queryExecution().toString()


def periodic_texts():
    """Stretches of one letter, of two and of one line, alone, side by side, shared by other texts and in other phases."""
    line = words(91, 25) + "\n"
    return [line * 40, words(92, 40) + line * 12 + words(93, 90), (line * 9)[7:] + words(94, 30) + line * 5, "q" * 5000, "pq" * 700 + "qp" * 900,
            words(95, 90) + "xyz" * 500, "xy" * 300 + words(96, 40) + "xy" * 300, "u" * 401, "v" * 400, words(97, 200)]


@pytest.mark.parametrize(("length", "crowd", "step"), [(400, 200, 1 << 20), (200, 5, 3000)])
def test_suffix_dedup_periodic_texts(spark, monkeypatch, length, crowd, step):
    ship(spark)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    texts = periodic_texts()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, length=length).collect()]
    assert Counter(got) == Counter((i, *w) for i, w in enumerate(brute_repeats(texts, length)))
    later = brute_later(texts, length)
    kept = suffix_dedup.cleaned(docs, length=length, keep_first=True).collect()
    assert {r.doc_id: r.text for r in kept} == {i: later[t] for i, t in enumerate(texts)}


def test_suffix_dedup_periods_are_one_row(spark):
    """A stretch that repeats itself gives as many rows whatever its length; before, it gave one per period, all under one anchor."""
    ship(spark)
    line = words(91, 25) + "\n"
    for unit in ("q", "pq", line):
        docs = spark.createDataFrame([(i, unit * (n // len(unit))) for i, n in enumerate((3000, 60000))], "doc_id long, text string")
        rows = suffix_dedup.all_segments(suffix_dedup.keyed(docs).select("key", "text"), 400).groupBy("key").count().collect()
        assert len(rows) == 2 and max(r["count"] for r in rows) <= 4, unit


def test_quality_model_holds_no_second_copy_of_the_counts():
    counts = np.random.default_rng(1).poisson(0.6, (2 * quality.PER_CLASS, quality.FEATURES)).astype(np.float32)
    tracemalloc.start()
    quality.Model(np.ones(quality.FEATURES), counts, np.arange(len(counts)) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * quality.FEATURES ** 2


def test_suffix_dedup_empty_and_columns(docs, nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0 and suffix_dedup.cleaned(nothing, keep_first=True).count() == 0
    assert suffix_dedup.cleaned(docs).columns == docs.columns


def brute_shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_hamming_dedup(spark, docs, nothing):
    near = [(100 + i, " ".join(np.where(np.random.default_rng(i).random(200) < 0.02, "new", words(9, 200).split()))) for i in range(40)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = hamming_dedup.find(both).collect()
    rows = both.where("doc_id is not null").distinct().collect()
    sets = {r.doc_id: brute_shingles(r.text) for r in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert {r.component_id for r in got if r.doc_id is None} == {6, None}
    assert len(got) == both.count() and hamming_dedup.find(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 30, 400, 20000])
def test_parity_sketch_refuses_no_linked_pair(size):
    rng = np.random.default_rng(size)
    for share in np.linspace(0, 0.4, 40):
        a = rng.integers(0, 1 << 64, size, np.uint64)
        b = np.unique(np.r_[a[rng.random(size) >= share], rng.integers(0, 1 << 64, int(size * share), np.uint64)])
        a = np.unique(a)
        common, pair = len(np.intersect1d(a, b)), [np.frombuffer(hamming_dedup.parity(s), np.uint64)[None] for s in (a, b)]
        linked = 100 * common >= 75 * (len(a) + len(b) - common)
        assert hamming_dedup.may_link(*pair, np.array([len(a) + len(b)]))[0] or not linked


def test_line_dedup(docs, nothing):
    got = {r.doc_id: r for r in line_dedup.dedup(docs.where("doc_id in (3, 4, 9, 10)"), 4).collect()}
    assert [(got[d].n_lines, got[d].n_removed, got[d].n_spans) for d in (3, 4, 9, 10)] == [(0, 0, 0), (1, 0, 0), (3, 0, 0), (4, 2, 1)]
    assert got[10].kept_sha256 == hashlib.sha256(b"x\ny").hexdigest()
    assert line_dedup.dedup(docs).count() == docs.count() and line_dedup.dedup(nothing).count() == 0


def brute_lines(texts, least):
    """The texts without the lines of later copies of any run of ``least`` bytes or more, by all runs of all texts."""
    seen, out = set(), []
    for t in texts:
        lines, gone = (t.split("\n") if t is not None else []), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.encode()) + 1 for x in run) >= least:
                    gone.update(range(i, j) if run in seen else ())
                    seen.add(run)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


@pytest.mark.parametrize("least, letters", [(1, ["a", "b", ""]), (4, ["a", "b", "c"]), (10, ["a", "b"]), (7, ["", "a", "bé", "long line"]), (64, ["x" * 63, "y" * 62, "z" * 20, ""])])
def test_line_dedup_brute_force(spark, least, letters):
    rng = np.random.default_rng(least)
    texts = ["\n".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(30)]
    texts += [*texts[:5], "\n".join(f"only here {i}" for i in range(40)) + "\n" + texts[0]]
    got = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), least).collect()}
    assert [got[d] for d in range(len(texts))] == brute_lines(texts, least)


def test_line_dedup_with_a_hot_line(spark):
    """With keys of ten rows counted as hot, a line of every document is dealt over tasks and the result stays."""
    rng = np.random.default_rng(5)
    texts = ["\n".join(rng.choice(["the line that all share, of quite some length and a little more than that", "b", "c"], 6)) for _ in range(60)]
    spark.conf.set("spark.codeloom.hotKeyRows", "10")
    try:
        got = {r.doc_id: r.text for r in line_dedup.cleaned(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.codeloom.hotKeyRows")
    assert [got[d] for d in range(len(texts))] == brute_lines(texts, line_dedup.LEAST)


def test_bpe_trie(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe_trie.encode(docs, path).select("text", "ids", "decoded").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_trie.digests(nothing, path).count() == 0


def test_packing(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    for doc_id in range(len(TEXTS)):
        ids = np.array(library.encode(TEXTS[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.length for r in mine] == packing.cut_lengths(len(ids), 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert packing.pack(nothing, path).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 200)).tolist())
        bins: list[int] = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [x for x in bins if x >= n]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - n)
            else:
                bins.append(100 - n)
        made = packing.plan(dict(counts), 100)
        assert max(first + take for (n, rank, first, _), take in zip(made, [
            (made[i + 1][1] if i + 1 < len(made) and made[i + 1][0] == e[0] else counts[e[0]]) - e[1] for i, e in enumerate(made)])) == len(bins)


def test_packing_plan_fills_whole_bins_first():
    made = packing.plan({4: 4, 3: 2, 2: 1}, 12)
    assert {first for _, _, first, _ in made} == {0, 1}
    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = Counter(rng.integers(1, 13, rng.integers(1, 120)).tolist())
        bins: list[int] = []
        for n in sorted(counts.elements(), reverse=True):
            room = min((x for x in bins if x >= n), default=None)
            bins.append((40 if room is None else room) - n)
            if room is not None:
                bins.remove(room)
        fill: dict = {}
        made = packing.plan(dict(counts), 40)
        for e, after in zip(made, [*made[1:], None]):
            for r in range((after[1] if after and after[0] == e[0] else counts[e[0]]) - e[1]):
                fill.setdefault(e[2] + r, []).append((e[3], e[0]))
        assert sorted(40 - sum(n for _, n in b) for b in fill.values()) == sorted(bins)
        assert all(o == sum(n for x, n in b if x < o) for b in fill.values() for o, _ in b)


def test_sharding(spark, docs, nothing):
    got = sharding.shard(docs, 4).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {(r.size, r.text_crc32) for r in got} == {(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in TEXTS}
    assert sharding.shard(nothing).count() == 0
    for n in (1, 2, 3, 17, 1000):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))


def test_sharding_equals_plain_python(spark, docs):
    """Shard and slot of every row, from the sorted rows and the permutation written with Python integers."""
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect())
    n, bits = len(rows), max(1, (max(len(rows) - 1, 1).bit_length() + 1) // 2)

    def place(x):
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for key in sharding.ROUND_KEYS:
                t = (right + key) % (1 << 31) * sharding.FACTOR % (1 << 31)
                t = (t ^ t >> 15) * sharding.FACTOR % (1 << 31)
                left, right = right, left ^ (t >> 9 & (1 << bits) - 1)
            x = left << bits | right
            if x < n:
                return x

    want = Counter((i if some else None, crc, size, place(k) % 4, place(k) // 4) for k, ((some, i), crc, size) in enumerate(rows))
    assert Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in sharding.shard(docs, 4).collect()) == want


def test_url_parts_equal_a_loop(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, "a://b"), (-2, "x://H/p?q#r"), (-3, "://?x"), (-4, "no scheme"), (-5, None), (-6, "http://É.Example.COM/en/ü://z"), (-7, ""), (-8, "s://net/es/\n?")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    rows = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.judge(pages).collect():
        _, found, rest = (rows[r.page_id] or "").partition("://")
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fit = max((x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1] + fit[2]), r
        assert fit is None or r.verdict == fit[0]


def test_url_grams_and_long_urls(spark):
    import time

    rows = spark.createDataFrame([("aé𝄞b", ""), ("", "xyz")], "h string, p string")
    got = [set(r[0]) for r in rows.select(url_filter.grams(F.col("h"), F.col("p"))).collect()]
    marked = [("^aé𝄞b$", "^$"), ("^$", "^xyz$")]
    assert got == [{m + t[i:i + n] for m, t in zip("hp", texts) for n in url_filter.GRAMS for i in range(len(t) - n + 1)} for texts in marked]
    rng = np.random.default_rng(0)
    letters = "".join(rng.choice([*"abcdefgh/"], 1_000_000))
    pages = spark.createDataFrame([(1, "http://x.example.org/" + letters), (2, letters), (3, letters + "://h/p")], "page_id long, url string")
    start = time.time()
    assert url_filter.judge(pages).count() == 3 and {r.host for r in url_filter.judge(pages).collect()} == {"x.example.org", "", "h"}
    assert time.time() - start < 120


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\r\n \u00a0"])
def test_packing_encodes_two_million_blanks(space):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in ("word" + space * (2_000_000 // len(space)) + "<|endoftext|> end", space * 50_000 + "x"):
        assert packing.encode(text, path).tolist() == library.encode(text, add_special_tokens=False).ids


def test_url_filter(spark):
    urls = {"http://a.example.com/en/1": ("example.com/en/", "block"), "https://www.example.com/en/x?y": ("www.example.com/en/", "allow"),
            "http://EXAMPLE.com/de": ("com/", "allow"), "http://x.net/es/": ("net/es/", "block"), "http://example.com:80/en/": (None, None), "http://www.garden.example.org/en/9": (None, "allow"),
            "http://x.com": (None, None), "http://free-casino.example.org/bets": (None, "block"), "no scheme/": (None, None), "": (None, None)}
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (u, (rule, verdict)) in enumerate(urls.items()):
        assert got[i].rule == rule and got[i].verdict in ({verdict} if verdict else {"allow", "block"}), u  # None: the model's own
    assert (got[2].host, got[2].path, got[8].host, got[None].path) == ("example.com", "/de", "", "")
    assert url_filter.judge(pages.where("false")).count() == 0
    one = spark.createDataFrame([("http://a.org/", 1)], "url string, blocked int")
    assert {r.verdict for r in url_filter.judge(pages.where("url = ''"), one).collect()} == {"block"}


def test_url_filter_on_held_out_urls(spark):
    """Three folds of the labelled table by URL hash: each part is scored by the model of the others."""
    table = url_filter.small_table(spark).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(3)))
    hits, n = 0, table.count()
    for k in range(3):
        part = table.where(F.col("fold") == k)
        got = url_filter.judge(part, table.where(F.col("fold") != k).drop("fold"), page_id="url").join(part.withColumnRenamed("url", "page_id"), "page_id")
        hits += got.where("(score >= 0.5) = (blocked = 1)").count()
    print(f"held out: {hits} of {n}")
    assert hits / n > 0.6


def test_quality(spark, docs, nothing):
    ship(spark)
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert len(got) == d.count()
    assert quality.classify(docs, labels).where("score between 0 and 1").count() == docs.count()
    assert quality.classify(docs, labels.where("false")).where("score = 0.5").count() == docs.count()
    assert quality.classify(nothing, labels).count() == 0


def test_quality_vote_brute_force(spark):
    """Trigrams, weights, projection and votes in plain loops; ties and zero vectors do not depend on ids."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("red blue green 12 7 Sky sea".split()) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    texts += ["", None, "ab", "zz zz zz"] + texts[:12]
    rows = [(i, t, int("red" in (t or "")) if i % 7 else i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df, df)
    got = {r.doc_id: r.score for r in quality.score(df, model).select("doc_id", "score").collect()}

    def trigrams(text):
        fold = [48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
        counts = Counter()
        for x, y, z in zip(fold, fold[1:], fold[2:]):
            mixed = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
            counts[(mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 21] += 1
        return counts

    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    df_count = Counter(f for t in texts for f in trigrams(t))
    for f, n in df_count.items():
        assert math.isclose(model.idf[f], math.log((1 + len(texts)) / (1 + n)), rel_tol=1e-5, abs_tol=1e-6)

    def latent(text):
        x = np.zeros(quality.FEATURES)
        for f, n in trigrams(text).items():
            x[f] = math.log1p(n) * math.log((1 + len(texts)) / (1 + df_count[f]))
        y = x / max(np.linalg.norm(x), 1e-12) @ model.basis.astype(float)
        return y / max(np.linalg.norm(y), 1e-12)

    known = [(latent(t), q) for i, t, q in rows if i not in held]
    prior = sum(q for _, q in known) / len(known)
    for i, text, _ in rows:
        own = latent(text)
        if not own.any():
            assert math.isclose(got[i], prior), text
            continue
        votes = sorted(((float(own @ v), q) for v, q in known), reverse=True)
        edge = votes[min(quality.NEIGHBOURS, len(votes)) - 1][0]
        sure = [(c, q) for c, q in votes if c > edge + 1e-6]
        tied = [q for c, q in votes if abs(c - edge) <= 1e-6]
        weight = lambda c: max(c, 1e-6) ** 4
        left = min(quality.NEIGHBOURS, len(votes)) - len(sure)
        total = sum(weight(c) for c, _ in sure) + left * weight(edge)
        ones = sum(weight(c) for c, q in sure if q)
        least, most = max(0, left - tied.count(0)), min(left, tied.count(1))
        assert (ones + least * weight(edge)) / total - 1e-4 <= got[i] <= (ones + most * weight(edge)) / total + 1e-4, text
    assert len({round(got[i], 9) for i, t, _ in rows if len(t or "") < 3}) == 1
    # The same rows under other ids that are in the same folds: the same scores.
    free = [j for j in range(1000, 9000) if zlib.crc32(str(j).encode()) % 3 != 1][::-1]
    shut = [j for j in range(1000, 9000) if zlib.crc32(str(j).encode()) % 3 == 1]
    other = {i: (shut if i in held else free).pop() for i, _, _ in rows}
    again = spark.createDataFrame([(other[i], t, q) for i, t, q in rows], df.schema)
    scores = {r.doc_id: r.score for r in quality.score(again, quality.fit(again, again)).select("doc_id", "score").collect()}
    assert all(math.isclose(scores[other[i]], got[i], abs_tol=1e-6) for i, _, _ in rows)


def test_quality_votes_with_true_counts_of_a_long_text(spark):
    ship(spark)
    long = "a" * 65540 + words(40, 30)  # one trigram 65,538 times
    df = spark.createDataFrame([(i, long if i == 0 else words(i, 30), i % 2) for i in range(60)], "doc_id long, text string, quality int")
    model = quality.fit(df, df)
    own = model.project(quality.features(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)])))
    assert np.isclose(own @ model.known.T, 1, atol=1e-5).any()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:1] + rng.normal(scale=0.15, size=(60, 16)), base[5:6], base[5:6]]).astype("f4").astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [None] + [1.0] * 15), (1060, [float("nan")] * 16), (1080, [float("inf")] + [0.0] * 15)]
    return x, spark.createDataFrame([(a, b, 3) for a, b in rows + odd], "vec_id long, embedding array<float>, label int")


def test_vector_graph(spark, vectors):
    x, df = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(n), int(c)) for n, c in zip(near.sum(1), label)]
    assert all(r.audited_links in (None, r.n_links) for r in got.values())
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (1000, 1020, 1040, 1060, 1080))
    assert vector_graph.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [3072, 256])  # one group in few shards, and dealt to many
def test_vector_graph_counts_all_links_of_a_group_of_near_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", rows)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:700] = x[0] + rng.normal(scale=0.031, size=(700, 64))
    x = x.astype("f4").astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([*enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {got[i].component_id for i in range(700)} == {0}


def test_forest(spark, vectors):
    x, df = vectors
    got = rp_forest.nearest(df, k=5).collect()
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and np.allclose([r.score for r in mine], s[[r.vec_id for r in mine]], rtol=1e-12)
        hits += [r.vec_id in want for r in mine]
    assert np.mean(hits) >= 0.9 and {r.query_id for r in got} == set(range(0, len(x), 20))
    assert rp_forest.nearest(df.where("false")).count() == 0


def test_forest_alone_reaches_neighbours_inside_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + rng.normal(scale=0.05, size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4").astype(float)
    df = spark.createDataFrame([*enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = {}
    for r in rp_forest.nearest(df, every=200, seeded=False).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for group in (True, False):
        recall = []
        for q in (q for q in range(0, len(x), 200) if (q % 3 == 0) == group):
            score = x @ x[q]
            score[q] = -np.inf
            recall.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
        assert np.mean(recall) >= 0.93, (group, np.mean(recall))


@pytest.mark.parametrize("n", [500, 2000, 4096])
def test_forest_alone_on_tables_no_larger_than_the_sample(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    forest = rp_forest.Forest(x, np.arange(n), n, 20)
    leaf, asked = forest.leaves(x), np.arange(40)
    hits = 0
    for q, found in zip(asked, forest.search(x[asked], forest.known(x[asked], asked)[0])):
        score = x @ x[q]
        score[q] = -np.inf
        hits += sum(any(leaf[i, t] == f for t, f in found) for i in np.argsort(-score)[:20])
    assert hits / 20 / len(asked) >= 0.93


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_filter(spark, docs, SF)
    assert first.columns == docs.columns and first.count() > 0.7 * docs.count()
    packed = corpus_pipeline.run(spark, SF).collect()
    assert packed and all(0 < r.length <= 2048 for r in packed)


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    ship(spark)
    a, b, c, d = (words(50 + i, 120) for i in range(4))
    near_b = b.replace(b.split()[60], "changed", 1)
    blank = "".join(np.random.default_rng(60).choice([" ", "\t"], 450))
    rows = [(1, a), (1, a), (2, b), (3, near_b), (3, c), (None, d), (None, d), (4, blank), (4, blank), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    want = Counter([(1, a), (2, b), (3, c), (None, d), (4, blank), (5, ""), (5, ""), (6, None)])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        if name != "line_dedup":
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == want, name
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter({(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1): n for (i, t), n in want.items()})


def brute_stages(rows):
    """Rows (id, text) after each of line_dedup, near_dedup and suffix_array_dedup, by plain loops."""
    def place(i, t):
        return i is None, i or 0, hashlib.md5((t or "").encode()).digest()

    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{'none' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).digest()))
    gone = dict(zip(order, brute_lines([t for _, t in order], line_dedup.LEAST)))
    lines = [(i, gone[i, t]) for i, t in rows if gone[i, t] or not t]
    sets = [brute_shingles(t) for _, t in lines]
    label = list(range(len(lines)))
    for _ in lines:
        for a in range(len(lines)):
            for b in range(len(lines)):
                same = 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) if sets[a] and sets[b] else lines[a][1] and lines[a][1] == lines[b][1]
                if same:
                    label[a] = label[b] = min(label[a], label[b])
    near = [min((r for r, c in zip(lines, label) if c == group), key=lambda r: place(*r)) for group in sorted(set(label))]
    later = brute_later([t for _, t in near], 200)
    cut = [(i, later[t] if t else t) for i, t in near]
    return lines, near, cut


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.5").select("doc_id")
    assert Counter(r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, SF).collect()) == Counter(r.doc_id for r in want.collect())

    a, b, c, d, e = (words(70 + i, 150) for i in range(5))
    shared, pair = words(80, 130), "a line of its own\nand the next one"
    rows = [(1, a), (1, a), (2, a.replace(" ", "  ", 3)), (3, b), (3, c), (4, b.replace(b.split()[70], "new", 1)), (None, d), (None, d), (None, None), (None, None),
            (5, f"{e} {shared} {words(81, 100)}"), (6, f"{words(82, 120)} {shared}"), (7, pair), (8, pair), (9, f"{words(83, 40)}\n{pair}\n{words(84, 40)}"),
            (10, ""), (11, None), (11, None), (12, "é" * 450), (13, words(85, 60) + "\nlone line"), (14, words(86, 60) + "\nlone line"),
            (15, words(87, 60) + "\n" + words(88, 30)), (16, words(88, 30) + "\n" + words(89, 60)), (17, words(88, 30))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for (name, stage), want in zip(corpus_pipeline.STAGES[1:4], brute_stages(rows)):
        docs = cut(stage(spark, docs, SF))[0]
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want), name
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    lengths = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want)
    assert Counter((r.doc_id, r.length) for r in packed) == lengths
    room: list[int] = []
    for n in sorted((n for _, n in lengths.elements()), reverse=True):
        fit = min((x for x in room if x >= n), default=None)
        room.append((2048 if fit is None else fit) - n)
        if fit is not None:
            room.remove(fit)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert sorted(2048 - n for n in used.values()) == sorted(room)


def test_shingles_are_made_in_small_steps():
    import tracemalloc

    import pyarrow as pa

    from codeloom.llm import hamming_dedup as hd
    from codeloom.llm.base import flat, pieces

    text = " ".join(f"w{i % 977}" for i in range(800))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 2500)], names=["text"])
    tracemalloc.start()
    try:
        n = sum(len(hd.shingles(*flat(b.column("text")))) for b in pieces([batch], "text", hd.STEP_BYTES))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2500 and peak < 120 << 20
