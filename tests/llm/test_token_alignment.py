"""Alignment of two tokenizers against the libraries and plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codeloom.llm import token_alignment
from codeloom.llm.base import byte_letters, ship

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    found, counts = [], Counter()
    for d, text in rows:
        ids, spans = ([], []), ([], [])
        if text:
            want = (" " + text).encode()
            ids = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            raw = ([bytes(byte_of[c] for c in ta.id_to_token(i)) for i in ids[0]],
                   [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
            if any(b"".join(r) != want for r in raw):
                ids = [], []
            else:
                spans = tuple(np.cumsum([len(x) for x in r]).tolist() for r in raw)
        end_b = {e: j for j, e in enumerate(spans[1])}
        links = [(i, end_b[e]) for i, e in enumerate(spans[0]) if e in end_b]
        counts.update((ids[0][i], ids[1][j]) for i, j in links)
        groups, a0, b0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids[0][a0:i + 1])) + "|" + ",".join(map(str, ids[1][b0:j + 1])))
            a0, b0 = i + 1, j + 1
        found.append((d, ids, links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for d, ids, links, text in found:
        n = [counts[ids[0][i], ids[1][j]] for i, j in links]
        out.append((d, len(ids[0]), len(ids[1]), len(links), len(links), sum(x == best[ids[1][j]] for x, (_, j) in zip(n, links)), sum(n),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts


TEXTS = ["The cat sat.", "The cat sat.", None, "", " ", "  lead", "a\tb\r\n\n\nc", "漢字 é İ ß 🎉", "<|endoftext|> <s> </s> <unk> <0x41> ▁ x",
         "\x00\x01 zero", "don't WE'LL 12345 !!!", "é ﬁ  ", "z" * 5000, "word " * 3000, " " * 3000 + "x" + "\t" * 2000]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [*enumerate(TEXTS), (None, "The cat"), (0, "The cat sat.")]
    return spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, groups string")


def test_digests_equal_the_libraries(docs):
    want, counts = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = [tuple(r) for r in token_alignment.digests(docs, A, B).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    table = token_alignment.pair_table(docs, A, B).collect()
    assert {(r.a_id, r.b_id): r.n for r in table} == counts
    assert len(table) <= token_alignment.pair_bound(token_alignment.tokenizers(A, B))
    assert token_alignment.digests(docs.where("false"), A, B).count() == 0


def test_long_white_space_goes_to_the_other_library(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "LONG_TEXT", 50)
    rows = [(1, "some words\n" * 20 + " " * 500), (2, "short")]
    got = [tuple(r) for r in token_alignment.digests(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()]
    assert sorted(got) == sorted(brute(rows)[0])


def test_two_million_blanks():
    both = token_alignment.tokenizers(A, B)
    for text in (" " * 2_000_000, "\n" * 2_000_000):
        assert b"".join(map(both.bytes_a.__getitem__, both.encode_a(text).tolist())) == text.encode()


def test_groups_cover_the_text(docs):
    rows = token_alignment.aligned(docs, A, B)
    assert rows.columns == docs.columns
    for r in rows.where("groups is not null and size(groups) > 0").collect():
        assert [g.start for g in r.groups] == [0, *[g.stop for g in r.groups][:-1]]
        assert r.groups[-1].stop == len((" " + r.text).encode())


def test_perfect_hash_and_tree_sum(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    h = token_alignment.PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == [*range(len(keys))]
    assert (h.find(rng.integers(-1 << 62, -1, 500)) == -1).all() and len(token_alignment.PerfectHash(keys[:0]).find(keys)) == len(keys)
    rows = [(int(k), int(n)) for k, n in zip(rng.choice(keys, 3000), rng.integers(1, 9, 3000))]
    want = np.zeros(len(keys), np.int64)
    np.add.at(want, h.find(np.array([k for k, _ in rows])), [n for _, n in rows])
    partial = spark.createDataFrame(rows, "pair long, n long").repartition(13)
    assert np.array_equal(token_alignment.summed(partial, h, 3), want)
