"""A stored positional index over node texts: ranked search and phrases without reading the texts again.

Postings lie in blocks of up to BLOCK nodes: one row holds a term, the nodes that contain it with their word positions,
and the best ranking factor in the block; import nodes, which searches leave out, have blocks of their own. Rows are range-partitioned and sorted by (term, block), so a word or prefix is a
pushed-down filter that reads few row groups, and a frequent term spreads over many files. For a single word the blocks
whose best factor is below the k-th best one cannot hold one of the k best nodes; they are skipped before entries are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import Graph
from codeloom.operators.skew import lookup_join
from codeloom.plans.search import (
    K1, TEXT_COLUMNS, B, Phrase, _accepts, _score, query_phrases, search_segments, search_substring, segment_vocab, tokens,
)
from codeloom.session import broadcast_rows, cut, shared_dir

#: Nodes in one block of a term's postings.
BLOCK = 128


@dataclass(frozen=True)
class SearchIndex:
    """Stored relations ``postings(term, imports, block, n, best, entries)`` and ``vocab(segment, name)``, and the corpus figures."""

    postings: DataFrame
    vocab: DataFrame | None
    total: int
    mean: float


def _positioned(nodes: DataFrame) -> DataFrame:
    """(id, kind, dl, words): all words of a node with their positions; texts of different columns are one position apart,
    so that no phrase runs from one into the next."""
    texts = [c for c in TEXT_COLUMNS if c in nodes.columns]
    split = nodes.select("id", "kind", *[tokens(F.col(c)).alias(f"_t{i}") for i, c in enumerate(texts)])

    def placed(words: Column, start: Column) -> Column:
        return F.transform(words, lambda w, p: F.struct(w.alias("term"), (p + start).alias("at")))

    words, start = [], F.lit(0)
    for i in range(len(texts)):
        words.append(placed(F.col(f"_t{i}"), start))
        start = start + F.size(f"_t{i}") + 1
    return split.select("id", "kind", (start - len(texts)).alias("dl"), F.concat(*words).alias("words"))


def _factor(tf: Column, dl: Column, mean: float) -> Column:
    """What a word adds to a node's score, but for the word's own weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def build(nodes: DataFrame, folder: str | None = None, names: bool = True) -> SearchIndex:
    """Index ``nodes`` under ``folder`` (a new one in the shared folder by default). Every node text is read once.

    The vocabulary repeats a name with each of its segments; ``ranked`` does not read it, so it may be left out where the
    names are long texts (not ``names``). ``search`` needs it."""
    spark = nodes.sparkSession
    folder = folder or f"{shared_dir(spark)}/codeloom-index-{uuid.uuid4().hex}"
    # Dealt by node before the words are split off, so that the grouping by word and node moves no row.
    figures = F.count(F.lit(1)).alias("total"), F.avg("dl").alias("mean")
    seen = Observation()
    placed = _positioned(nodes.repartition("id")).observe(seen, *figures)
    per_node, rows = cut(placed.select("id", "kind", "dl", F.explode("words").alias("w")).groupBy(F.col("w.term").alias("term"), "id", "kind", "dl").agg(
        F.sort_array(F.collect_list("w.at")).alias("at")))  # bounded by one node's text
    # A plan without rows drops the observation.
    total, mean = (seen.get["total"], seen.get["mean"]) if rows else _positioned(nodes).agg(*figures).first()
    # A term's nodes are dealt over blocks by a hash of the id; the number of blocks follows the term's nodes. Only terms
    # of more than one block are looked up.
    sizes, several = cut(per_node.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1"))
    sized = per_node.join(F.broadcast(sizes), "term", "left") if several <= broadcast_rows(spark) else lookup_join(
        per_node, sizes, ["term"], "left", stored=True)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    entry = F.struct("id", "kind", "dl", "at")
    # A block's rows meet in the range that they are stored in.
    postings = dealt.repartitionByRange("term", "block").groupBy("term", (F.col("kind") == "import").alias("imports"), "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(_factor(F.size("at"), F.col("dl"), mean or 1.0)).alias("best"), F.collect_list(entry).alias("entries"))
    postings.sortWithinPartitions("term", "block").write.mode("errorifexists").parquet(f"{folder}/postings")
    if names:
        segment_vocab(nodes).repartitionByRange("segment", "name").sortWithinPartitions("segment", "name").write.mode("errorifexists").parquet(f"{folder}/vocab")
    spark.createDataFrame([(total, mean)], "total long, mean double").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/figures")
    return load(spark, folder, names)


def load(spark: SparkSession, folder: str, names: bool = True) -> SearchIndex:
    total, mean = spark.read.parquet(f"{folder}/figures").first()
    return SearchIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/vocab") if names else None, total, mean or 1.0)


def _is(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _words(p: Phrase) -> list[tuple[str, bool]]:
    return [(w, p.prefix and i == len(p.words) - 1) for i, w in enumerate(p.words)]


def _phrase_count(p: Phrase, names: dict[tuple[str, bool], str]) -> Column:
    """Occurrences of a phrase from the positions of its words, which are columns of arrays."""
    first, *rest = [F.col(names[w]) for w in _words(p)]
    if not rest:
        return F.size(first)
    return F.size(F.filter(first, lambda at: reduce(
        lambda a, b: a & b, [F.array_contains(r, at + i) for i, r in enumerate(rest, 1)])))


def ranked(index: SearchIndex, query: str, best_of: int | None = None, imports: bool = True) -> DataFrame:
    """(id, kind, score) of every node that satisfies the query; lower scores are better. Import nodes count in the corpus
    figures, but are left out without ``imports``. With ``best_of``, rows outside the best so many, ties included, may be
    missing."""
    alternatives = query_phrases(query)
    phrases = list(dict.fromkeys(p for alt in alternatives for p in alt))
    if not phrases:
        return index.postings.select(F.lit("").alias("id"), F.lit("").alias("kind"), F.lit(0.0).alias("score")).limit(0)
    words = list(dict.fromkeys(w for p in phrases for w in _words(p)))
    rows = index.postings.where(reduce(lambda a, b: a | b, [_is(*w) for w in words]))
    held = None
    if best_of and len(phrases) == 1 and len(phrases[0].words) == 1 and not phrases[0].prefix:
        # Every block holds a node with its best factor: nodes below the k-th best block are beaten k times.
        held = rows.agg(F.sum("n")).first()[0] or 0
        rows = rows if imports else rows.where("not imports")
        top = rows.select("best").orderBy(F.desc("best")).limit(best_of).agg(F.min("best"), F.count(F.lit(1))).first()
        if top[1] == best_of:
            rows = rows.where(F.col("best") >= top[0])
    names = {w: f"_w{i}" for i, w in enumerate(words)}
    flat = rows.select("term", F.explode("entries").alias("e")).select("term", "e.*")
    at = [F.array_sort(F.flatten(F.collect_list(F.when(_is(*w), F.col("at"))))).alias(n) for w, n in names.items()]
    per_node = flat.groupBy("id", "kind", "dl").agg(*at)
    counts = {p: f"_f{i}" for i, p in enumerate(phrases)}
    counted = per_node.select("id", "kind", "dl", *[_phrase_count(p, names).alias(n) for p, n in counts.items()])
    if held is None:
        with_term = counted.agg(*[F.count_if(F.col(n) > 0).alias("n" + n) for n in counts.values()])
        stat = with_term.select(F.struct("*").alias("s")).scalar()
        having = [stat["n" + n] for n in counts.values()]
    else:
        having = [F.lit(held)]
    score = _score([F.col(n) for n in counts.values()], F.col("dl"), F.lit(index.total), F.lit(index.mean), having)
    found = counted.filter(_accepts(alternatives, counts)).select("id", "kind", score.alias("score"))
    return found if imports else found.where("kind <> 'import'")


def search(graph: Graph, index: SearchIndex, query: str, limit: int = 50, exclude_imports: bool = True) -> DataFrame:
    """``plans.search.search`` from the index: the best tier that finds anything, with the same rows and order. Node rows are
    looked up by id, for hits only."""
    nodes = graph.nodes
    columns = nodes.columns + ["score"]
    ties = [c for c in ("file_path", "seq", "id") if c in nodes.columns]
    if not query.strip():
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    hits = ranked(index, query, limit, not exclude_imports)
    # Ties at the last place are decided by columns of the node, so all rows up to the k-th score go on.
    hits, n = cut(hits.select("id", "score"))
    if n > limit:
        last = hits.orderBy("score").limit(limit).agg(F.max("score")).first()[0]
        hits = hits.where(F.col("score") <= last)
    if n or not exclude_imports:
        return nodes.join(hits, "id").select(*columns).orderBy("score", *ties).limit(limit)
    found, rows = cut(search_segments(nodes, query, index.vocab).select(*columns).orderBy(F.desc("score"), *ties).limit(limit))
    if rows:
        return found.orderBy(F.desc("score"), *ties)
    return search_substring(nodes, query).select(*columns).orderBy("start_line", *ties).limit(limit)
