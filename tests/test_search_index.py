"""The stored positional index against the scan of the texts."""

import pytest

from codeloom.graph import Graph
from codeloom.plans import search, search_index

COLUMNS = "id string, kind string, name string, qualified_name string, docstring string, signature string, file_path string, seq int, start_line int"
WORDS = ["order", "load", "item", "été", "find", "by", "name", "nation"]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(f"n{i:03d}", "import" if i % 7 == 0 else "method", f"{WORDS[i % 8]} {WORDS[i * 3 % 8]}", f"com.{WORDS[i % 5]}.{WORDS[i * 5 % 8]}",
             None if i % 3 else " ".join(WORDS[j % 8] for j in range(i % 11, i % 29)), f"order {i}", f"f{i % 4}", i, i) for i in range(400)]
    rows += [("e1", "class", None, None, None, None, "f", 0, 0), ("e2", "class", "findByName", "", "", "", "f", 1, 1)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def index(nodes):
    return search_index.build(nodes)


def rounded(df):
    return sorted((r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("query", ["order", "ETE", "nat*", '"load item"', '"find by na"*', 'item "by name" OR ete load*', '"order order"', "- OR"])
def test_ranking_equals_the_scan(nodes, index, query):
    assert rounded(search_index.ranked(index, query)) == rounded(search.bm25_scan(nodes, search.TEXT_COLUMNS, query))
    whole = sorted(rounded(search_index.ranked(index, query)), key=lambda r: r[1])
    few = set(rounded(search_index.ranked(index, query, 10)))
    assert few <= set(whole) and {r for r in whole if r[1] <= whole[min(9, len(whole) - 1)][1]} <= few


@pytest.mark.parametrize("query", ["order", "findName", "IndByN", "  "])
@pytest.mark.parametrize("limit", [3, 50])
def test_tiers_equal_the_scan(nodes, index, query, limit):
    graph = Graph(nodes, None)
    got = [tuple(r) for r in search_index.search(graph, index, query, limit).collect()]
    want = [tuple(r) for r in search.search(graph, query, limit).collect()]
    assert [(*r[:-1], round(r[-1], 9)) for r in got] == [(*r[:-1], round(r[-1], 9)) for r in want]


def test_blocks_below_the_best_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 10)
    rows = [(f"n{i:04d}", "method", "word " * (1 + (i % 50 == 0)) + "x " * (i % 97), None, None, None, "f", i, i) for i in range(1000)]
    nodes = spark.createDataFrame(rows, COLUMNS)
    index = search_index.build(nodes)
    blocks = index.postings.where("term = 'word'")
    best = sorted((r.best for r in blocks.select("best").collect()), reverse=True)
    assert len(best) > 50 and sum(b >= best[4] for b in best) < len(best) / 2
    few, whole = rounded(search_index.ranked(index, "word", 5)), rounded(search.bm25_scan(nodes, search.TEXT_COLUMNS, "word"))
    assert len(few) < len(whole) and sorted(few, key=lambda r: (r[1], r[0]))[:5] == sorted(whole, key=lambda r: (r[1], r[0]))[:5]


def test_term_filter_is_pushed_down(index):
    plan = index.postings.where(search_index._is("ord", True)).select("id" if "id" in index.postings.columns else "n")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ord)" in plan and "entries" not in plan.split("ReadSchema")[-1]


def test_empty_table(spark, nodes):
    index = search_index.build(nodes.where("false"))
    assert index.total == 0 and search_index.ranked(index, "order").count() == 0
    assert search_index.search(Graph(nodes.where("false"), None), index, "order").count() == 0


def test_build_without_vocabulary(spark, nodes, monkeypatch):
    """No vocabulary of long texts, and no join of the postings by word."""
    def never(*_, **__):
        raise AssertionError("not needed")

    monkeypatch.setattr(search_index, "segment_vocab", never)
    monkeypatch.setattr(search_index, "lookup_join", never)
    index = search_index.build(nodes, names=False)
    assert index.vocab is None and index.postings.where("block > 0").count() > 0
    for query in ('"load item"', 'item "by name" OR ete load*'):
        assert rounded(search_index.ranked(index, query)) == rounded(search.bm25_scan(nodes, search.TEXT_COLUMNS, query))
