"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import conversation_trie
from codeloom.llm.base import ship
from codeloom.llm.conversation_trie import SpillingQueue


def brute(rows, borrow=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    nodes = defaultdict(list)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if borrow else 0
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, totals = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, own + sum(totals[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(built[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), *totals[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n):
    """Few texts and roles, so that many prefixes are shared; tie-free turns, nulls, a long one, copies and gaps in the ids."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(n * 3, n, replace=False).tolist():
        places = rng.choice(200, rng.integers(1, 12), replace=False).tolist()
        for t in places:
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["é", "ab", "", None], p=[0.7, 0.1, 0.1, 0.1])))
        if rng.random() < 0.2:
            rows.append((c, None, "system", "first"))
    rows += [(900_000 + i, t, "user", "same") for i in range(40) for t in range(6)]
    rows += [(800_000, t, "user", "same") for t in range(300)] + [(None, 1, "user", "nobody"), (700_001, 1, "user", "only")]
    rng.shuffle(rows)
    return [(c if c is None else int(c), t if t is None else int(t), r, x) for c, t, r, x in rows]


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)

    def make(rows):
        return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, top string, depth int")

    return make


@pytest.mark.parametrize(("borrow", "band", "shard_rows", "held"), [(True, 1024, 100_000, 200_000), (True, 4, 12, 2), (False, 3, 40, 1)])
def test_trie_equals_dictionary(table, borrow, band, shard_rows, held):
    rows = sample(band, 150)
    got = conversation_trie.trie(table(rows), borrow, band=band, shard_rows=shard_rows, held=held)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, borrow)


def test_hot_prefix_is_spread(spark, table):
    spark.conf.set("spark.codeloom.hotKeyRows", "10")
    try:
        rows = sample(9, 60)
        assert sorted(map(tuple, conversation_trie.trie(table(rows)).collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.codeloom.hotKeyRows")


def test_repeated_rows_ties_and_empty_tables(table):
    rows = [(5, 1, "u", "b")] * 3 + [(5, 1, "u", "a"), (6, None, None, None), (6, None, None, None), (11, 0, "u", "x" * 100_000)]
    assert sorted(map(tuple, conversation_trie.trie(table(rows), borrow=False).collect()), key=str) == brute(rows, False)
    assert conversation_trie.trie(table([])).count() == 0
    assert conversation_trie.trie(table([(None, 1, "u", "x")])).count() == 0


def test_queue_spills_and_keeps_order():
    rng = np.random.default_rng(0)
    queue, want = SpillingQueue(7), defaultdict(lambda: [0, 0])
    for level, conv, a, b in rng.integers(0, 6, (500, 4)).tolist():
        queue.push(level, conv, a, b)
        want[level, conv][0] += a
        want[level, conv][1] += b
    assert len(queue.runs) > 10
    for level in range(5, -1, -1):
        for conv in range(6):
            assert queue.take(level, conv) == tuple(want[level, conv])
    assert not queue.heap and not queue.runs


def test_given_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = conversation_trie.trie(rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(map(tuple, rows.select("conv_id", "turn", "role", "text").collect()))
