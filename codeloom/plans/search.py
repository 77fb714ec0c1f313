"""Three-tier symbol search: ranked full text, name segments, substring."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions.text import fold_accents, identifier_segments, word_runs
from codeloom.graph import Graph
from codeloom.operators.skew import lookup_join
from codeloom.session import cut

# Parameters of the ranking function.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6

TEXT_COLUMNS = ["name", "qualified_name", "docstring", "signature"]


@dataclass(frozen=True)
class Phrase:
    """Consecutive words; the last one may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def query_phrases(query: str) -> list[list[Phrase]]:
    """``a b OR "c d" OR e*`` as alternatives of phrases that must all occur."""
    alternatives: list[list[Phrase]] = [[]]
    for item in re.findall(r'"[^"]*"\*?|\S+', query):
        if item == "OR":
            alternatives.append([])
            continue
        if item == "AND":
            continue
        words = tuple(re.findall(r"[^\W_]+", item.lower()))
        if words:
            alternatives[-1].append(Phrase(words, item.endswith("*")))
    return [a for a in alternatives if a]


def tokens(text: Column) -> Column:
    """Folded alphanumeric runs; a missing text has none."""
    return word_runs(fold_accents(F.coalesce(text, F.lit(""))))


def _hits(words: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens (a bound lambda variable)."""
    def matches(token: Column, i: int) -> Column:
        last = i == len(phrase.words) - 1
        return token.startswith(phrase.words[i]) if last and phrase.prefix else token == phrase.words[i]

    if len(phrase.words) == 1:
        return F.size(F.filter(words, lambda t: matches(t, 0)))
    # Every start position at which all words follow one another.
    return F.size(F.filter(words, lambda t, pos: reduce(
        lambda a, b: a & b, [matches(F.get(words, pos + i), i) for i in range(len(phrase.words))])))


def _counts(texts: list[Column], phrases: list[Phrase]) -> Column:
    """array<struct<_len, _f0, _f1, ...>>, one element per text. The inner
    ``transform`` binds the tokens, so every text is split once."""
    def count(words: Column) -> Column:
        return F.struct(F.size(words).alias("_len"),
                        *[_hits(words, p).alias(f"_f{i}") for i, p in enumerate(phrases)])

    return F.flatten(F.transform(F.array(*texts), lambda t: F.transform(F.array(tokens(t)), count)))


def _score(counts: list[Column], length: Column, total: Column, mean: Column, with_term: list[Column]) -> Column:
    norm = K1 * (1 - B + B * length / mean)
    score = F.lit(0.0)
    for f, n in zip(counts, with_term):
        idf = F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(MIN_IDF))
        score = score + idf * (f * (K1 + 1)) / (f + norm)
    return -score


def _accepts(alternatives: list[list[Phrase]], names: dict[Phrase, str]) -> Column:
    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.col(names[p]) > 0 for p in alt]) for alt in alternatives])


def bm25_scan(docs: DataFrame, text_columns: list[str], query: str) -> DataFrame:
    """Documents that satisfy the query with their (negative, lower is better)
    score, read straight from the text: one narrow pass for the counts and one
    small aggregate for the corpus statistics."""
    alternatives = query_phrases(query)
    if not alternatives:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    phrases = list(dict.fromkeys(p for alt in alternatives for p in alt))
    names = {p: f"_f{i}" for i, p in enumerate(phrases)}
    fields = ["_len", *names.values()]
    per_text = docs.withColumn("_c", _counts([F.col(c).cast("string") for c in text_columns], phrases))
    counted = per_text.select(
        *docs.columns,
        *[F.aggregate(F.col(f"_c.{f}"), F.lit(0), lambda acc, x: acc + x).alias(f) for f in fields])
    corpus = counted.agg(
        F.count(F.lit(1)).alias("total"), F.avg("_len").alias("mean"),
        *[F.count_if(F.col(n) > 0).alias("n" + n) for n in names.values()])
    # One subquery for all statistics: it is planned and run once.
    stat = corpus.select(F.struct("*").alias("s")).scalar()
    score = _score([F.col(n) for n in names.values()], F.col("_len"), stat["total"], stat["mean"],
                   [stat["n" + n] for n in names.values()])
    return (
        counted.filter(_accepts(alternatives, names)).withColumn("score", score)
        .drop("_len", *names.values())
    )


# -- inverted index ---------------------------------------------------------

def build_postings(nodes: DataFrame) -> DataFrame:
    """(term, id, kind, tf, dl): one row per term and node.

    The node's length rides along, so ranking needs no join back to nodes."""
    words = F.flatten(F.array(*[tokens(F.col(c)) for c in TEXT_COLUMNS]))
    per_node = nodes.select("id", "kind", words.alias("_w")).withColumn("dl", F.size("_w"))
    return (
        per_node.select("id", "kind", "dl", F.explode("_w").alias("term"))
        .groupBy("term", "id", "kind", "dl").agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_stats(nodes: DataFrame) -> DataFrame:
    """One row: number of nodes and mean length."""
    length = reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in TEXT_COLUMNS])
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.avg(length).alias("mean"))


def write_postings(postings: DataFrame, path: str) -> None:
    """Range-partitioned by (term, id): a term query reads few row groups, and a
    term found in most nodes still spreads over several files."""
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("errorifexists").parquet(path)


def bm25_index(postings: DataFrame, corpus: DataFrame, query: str) -> DataFrame:
    """(id, score) from the index, for queries of single words and prefixes."""
    alternatives = query_phrases(query)
    phrases = list(dict.fromkeys(p for alt in alternatives for p in alt))
    if any(len(p.words) > 1 for p in phrases):
        raise ValueError("phrases need bm25_scan")
    names = {p: f"_f{i}" for i, p in enumerate(phrases)}

    def is_term(p: Phrase) -> Column:
        return F.col("term").startswith(p.words[0]) if p.prefix else F.col("term") == p.words[0]

    relevant = postings.filter(reduce(lambda a, b: a | b, [is_term(p) for p in phrases]))
    counted = relevant.groupBy("id", "kind", "dl").agg(
        *[F.coalesce(F.sum(F.when(is_term(p), F.col("tf"))), F.lit(0)).alias(n) for p, n in names.items()])
    with_term = counted.agg(*[F.count_if(F.col(n) > 0).alias("n" + n) for n in names.values()])
    stat, held = (df.select(F.struct("*").alias("s")).scalar() for df in (corpus.select("total", "mean"), with_term))
    score = _score([F.col(n) for n in names.values()], F.col("dl"), stat["total"], stat["mean"],
                   [held["n" + n] for n in names.values()])
    return counted.filter(_accepts(alternatives, names)).select("id", "kind", score.alias("score"))


# -- segments and substring -------------------------------------------------

def segment_vocab(nodes: DataFrame) -> DataFrame:
    """Distinct (segment, name) of all segmentable nodes."""
    names = nodes.filter(~F.col("kind").isin(schema.UNSEGMENTED_KINDS)).select("name").distinct()
    return names.select(F.explode(identifier_segments(F.col("name"))).alias("segment"), "name")


def search_segments(nodes: DataFrame, query: str, vocab: DataFrame | None = None) -> DataFrame:
    """Nodes sharing name segments with the query; score grows with the number shared."""
    wanted = F.array_contains(identifier_segments(F.lit(query)), F.col("segment"))
    vocab = segment_vocab(nodes) if vocab is None else vocab
    by_name = vocab.filter(wanted).groupBy("name").agg(
        (F.count(F.lit(1)).cast("double") * 0.2 + 0.4).alias("score"))
    return lookup_join(nodes.filter(F.col("kind") != "import"), by_name, ["name"], "inner")


def search_substring(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or qualified name contains the query in any case."""
    needle = query.lower()
    hit = F.lower("name").contains(needle) | F.lower("qualified_name").contains(needle)
    return nodes.filter(hit & (F.col("kind") != "import")).withColumn("score", F.lit(0.3))


def search(graph: Graph, query: str, limit: int = 50, exclude_imports: bool = True) -> DataFrame:
    """The best tier that finds anything: full text, then segments, then substring."""
    nodes = graph.nodes
    columns = nodes.columns + ["score"]
    ties = [c for c in ("file_path", "seq", "id") if c in nodes.columns]
    empty = nodes.withColumn("score", F.lit(0.0)).limit(0)
    if not query.strip():
        return empty
    ranked = bm25_scan(nodes, [c for c in TEXT_COLUMNS if c in nodes.columns], query)
    if exclude_imports:
        ranked = ranked.filter(F.col("kind") != "import")
    found, rows = cut(ranked.select(*columns).orderBy("score", *ties).limit(limit))
    if rows or not exclude_imports:
        return found.orderBy("score", *ties)
    found, rows = cut(search_segments(nodes, query).select(*columns).orderBy(F.desc("score"), *ties).limit(limit))
    if rows:
        return found.orderBy(F.desc("score"), *ties)
    return search_substring(nodes, query).select(*columns).orderBy("start_line", *ties).limit(limit)
