"""Benchmark decontamination against a window count in plain Python."""

import hashlib
import re

import numpy as np
import pytest

from codeloom.llm import decontaminate
from codeloom.llm.base import ship

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = [*"abcd", "É", "ß9"]


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def texts(seed, n, longest):
    rng = np.random.default_rng(seed)
    return [rng.choice([" ", ", ", "\n"]).join(rng.choice(LETTERS, rng.integers(0, longest))) for _ in range(n)]


ITEMS = [*enumerate(texts(1, 12, 30)), (3, "a b a b a b a b a b a b a b"), (90, "z"), (91, ""), (None, "q r s"), (92, None), (92, "B, c! D"),
         (93, "b c d"), (None, None), (7, "x" * 3000), (94, " ".join(f"w{i}" for i in range(60)))]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [*enumerate([*texts(2, 40, 120), None, "", "z", "Z z-Z", "w" * 9000, " ".join(f"W{i}" for i in range(5, 40)), "q R s",
                        "x" * 3000, "y " * 40000 + ITEMS[0][1]])] + [(None, "b c d"), (0, "b c d"), (0, "b c d")]
    return spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], "doc_id long, text string, _text string, n_words int")


@pytest.mark.parametrize(("block", "at_once"), [(250_000, 8), (25, 2)])
def test_report_equals_window_count(spark, docs, monkeypatch, block, at_once):
    monkeypatch.setattr(decontaminate, "STEP", 5000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.marked(docs, items, block_words=block, pass_blocks=at_once)
    assert rows.columns == ["doc_id", "text", "_text", "n_words", "hit_spans", "hit_items"]
    got = [(r.doc_id, r.n_words, sum(s.n_words for s in r.hit_spans), len(r.hit_items),
            hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), bool(r.hit_spans)) for r in rows.collect()]
    key = str
    assert sorted(got, key=key) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS), key=key)


def test_spans_name_the_bytes_and_are_removed(spark, docs):
    items = spark.createDataFrame([(1, "b c d"), (2, "z")], "item_id long, text string")
    for r in decontaminate.marked(docs, items).where("size(hit_spans) > 0").collect():
        raw = r.text.encode()
        for s in r.hit_spans:
            assert words(raw[s.byte:s.byte + s.n_bytes].decode()) == words(r.text)[s.word:s.word + s.n_words]
    small = spark.createDataFrame([(1, "é one b, C d two"), (2, "b c d"), (3, None), (4, "zz")], "doc_id long, text string")
    got = dict(decontaminate.cleaned(small, items).collect())
    assert got == {1: "é one  two", 3: None, 4: "zz"}
    assert dict(decontaminate.cleaned(small, items, longest=3, coverage=1.0).collect()) == dict(small.collect())


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.report(docs, none).collect()} == {False}
    assert decontaminate.report(docs.where("false"), none.union(spark.createDataFrame([(1, "b c d")], none.schema))).count() == 0


def test_production_query_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = [tuple(r) for r in decontaminate.report(docs, items).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(got) == sorted(want) and any(r[5] for r in got)
