"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling. DataFrame functions only.

A suffix's rank orders it by its first h lines; joining the rank at i with the rank at i + h orders it by 2 h lines.
Suffixes whose rank is unique are dropped at once, since they share no longer prefix either. A run of lines is deleted by
its size in bytes, so one long line counts as much as many short ones. The suffixes that share their first m lines are a
longest-common-prefix interval of depth m; it is named by two ranks of the largest power of two in m, one at its first
line and one that ends with its last. Every repeated run of LEAST bytes or more is the union of the shortest such runs
that begin, and of those that end, at its lines; so intervals are formed at these depths, doubling goes on until ranks
cover the deepest, and what the later members of all intervals cover joins to the maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.base import stored
from codeloom.llm.sharding import number_rows
from codeloom.operators.skew import lookup_join
from codeloom.session import broadcast_rows, cut

#: Least bytes of a repeated run that is deleted, each line with its line feed; about ten words.
LEAST = 64


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``_doc`` (id), ``_row`` (128-bit key of id and text) and ``_lines``."""
    body = F.col(text).cast("string")
    named = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return docs.select("*", F.col(doc_id).cast("long").alias("_doc"), F.unhex(F.md5(named.cast("binary"))).alias("_row"),
                       F.coalesce(F.split(body, "\n", -1), F.array().cast("array<string>")).alias("_lines"))


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """The stored ``suffixes`` that share their ``keys`` with another one, with their ``rank`` by these instead of them.
    The distinct keys are range sorted and numbered; counts combine before the shuffle and tell whether a key is hot."""
    shared = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    numbered, _ = number_rows(shared, [F.col(k) for k in keys])
    most = numbered.agg(F.max("_n")).first()[0] or 0
    found = lookup_join(suffixes, numbered.select(*keys, F.col("row_no").alias("_new")), keys, "inner", most, stored=True)
    return stored(found.drop(*keys).withColumnRenamed("_new", "rank"))


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """(_doc, _row, line, size, rank) of the lines that stand elsewhere too: the suffix array by one line."""
    lines = stored(keyed.select("_doc", "_row", F.posexplode("_lines").alias("line", "_text")).select(
        "_doc", "_row", "line", (F.octet_length("_text") + 1).cast("long").alias("size"), F.xxhash64("_text").alias("x"), F.hash("_text").alias("y")))
    # Rows that are equal in id and text are one document.
    return stored(_ranked(lines, ["x", "y"]).dropDuplicates(["_row", "line"]))


def shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """(_doc, _row, line, m): for each of the ``lines`` the fewest lines of ``least`` bytes that begin there, and the fewest that
    end there, within stretches of lines that follow each other."""
    by_line = Window.partitionBy("_row").orderBy("line")  # one document's lines
    part = Window.partitionBy("_row", "_stretch")
    sized = lines.withColumn("_stretch", F.col("line") - F.row_number().over(by_line)).withColumn(
        "_end", F.sum("size").over(part.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_start", F.col("_end") - F.col("size")).withColumn("_all", F.max("_end").over(part))
    begin = F.count(F.lit(1)).over(part.orderBy("_start").rangeBetween(1, least - 1)) if least > 1 else F.lit(0)
    stop = F.count(F.lit(1)).over(part.orderBy("_end").rangeBetween(1 - least, -1)) if least > 1 else F.lit(0)
    both = sized.select("_doc", "_row", "line", F.when(F.col("_start") + least <= F.col("_all"), begin).alias("_b"),
                        F.when(F.col("_end") >= least, stop).alias("_s"))
    one = F.explode(F.array(F.struct(F.col("line").alias("line"), F.col("_b").alias("more")),
                            F.struct((F.col("line") - F.col("_s")).cast("int").alias("line"), F.col("_s").alias("more"))))
    return both.select("_doc", "_row", one.alias("_w")).where("_w.more is not null").select(
        "_doc", "_row", "_w.line", (F.col("_w.more") + 1).cast("int").alias("m"))


def intervals(keyed: DataFrame, least: int = LEAST) -> DataFrame:
    """(_doc, _row, line, m, head, tail): suffixes by the longest-common-prefix intervals of depth m that they lie in; the ranks
    ``head`` and ``tail`` name the interval."""
    ranks = repeated_lines(keyed)
    runs = stored(shortest_runs(ranks, least).withColumn("k", F.length(F.bin("m")) - 1))
    deepest = runs.agg(F.max("k")).first()[0] or 0
    ranks = ranks.drop("size")
    levels = ranks.withColumn("k", F.lit(0))
    for k in range(deepest):
        after = ranks.select("_row", (F.col("line") - (1 << k)).alias("line"), F.col("rank").alias("next"))
        ranks = _ranked(stored(ranks.join(after, ["_row", "line"])), ["rank", "next"])
        levels = levels.unionByName(ranks.withColumn("k", F.lit(k + 1)))
    named = levels.select("_row", "line", "k", "rank")
    second = runs.withColumn("_at", F.expr("line + m - shiftleft(1, k)"))
    return second.join(named.withColumnRenamed("rank", "head"), ["_row", "line", "k"]).join(
        named.select("_row", F.col("line").alias("_at"), "k", F.col("rank").alias("tail")), ["_row", "_at", "k"]).select(
        "_doc", "_row", "line", "m", "head", "tail")


def later_copies(members: DataFrame) -> DataFrame:
    """(_row, a, b): maximal runs of lines that are covered by all but the first members of the intervals."""
    members = stored(members)
    place = F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_row", "line")
    first = members.groupBy("m", "head", "tail").agg(F.min(place).alias("first")).select("first._row", "first.line", "m")
    # A place and a depth lie in one interval, so no key of this join is hot.
    later = members.join(first, ["_row", "line", "m"], "left_anti").select("_row", F.col("line").alias("a"), (F.col("line") + F.col("m") - 1).alias("b"))
    in_order = Window.partitionBy("_row").orderBy("a", "b")  # one document's runs
    reach = F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    run = F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("run", run).groupBy("_row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("_row", "a", "b")


def _cut(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``_lines``, ``_runs`` (deleted runs, in order) and ``_kept`` (the lines that stay)."""
    keyed = _keyed(docs, doc_id, text)
    runs, n = cut(later_copies(intervals(keyed, least)))
    runs = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_runs"))
    if n <= broadcast_rows(docs.sparkSession):  # counted runs, about 24 bytes each; otherwise both sides are shuffled
        runs = F.broadcast(runs)
    found = keyed.join(runs, "_row", "left").withColumn("_runs", F.coalesce("_runs", F.array().cast("array<struct<a:int,b:int>>")))
    count = F.size("_runs")
    gap = F.transform(F.sequence(F.lit(0), count), lambda j: F.slice(
        "_lines", F.when(j == 0, 1).otherwise(F.get("_runs", j - 1)["b"] + 2),
        F.greatest(F.lit(0), F.when(j == count, F.size("_lines")).otherwise(F.get("_runs", j)["a"])
                   - F.when(j == 0, 0).otherwise(F.get("_runs", j - 1)["b"] + 1))))
    return found.withColumn("_kept", F.flatten(gap))


def cleaned(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines of later copies. A text that loses lines and has none left becomes empty; a null text
    stays null; other columns stay as they are."""
    out = _cut(docs, least, doc_id, text)
    return out.withColumn(text, F.when(F.size("_runs") == 0, F.col(text)).otherwise(F.array_join("_kept", "\n"))).select(*docs.columns)


def dedup(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_sha256 of every row.

    Lines end at a line feed; an empty text is one empty line, a null text has none. A repeated run is deleted if its lines
    have ``least`` bytes or more, each with its line feed. Documents are ordered by id (null last), then by text key; the first
    copy of a run in that order stays, and a run may overlap its own earlier copy. Every distinct line survives somewhere. Rows equal in id and
    text get the same result. An empty table gives no rows; other columns are not looked at."""
    out = _cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least, "doc_id", "text")
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
                      F.size("_runs").cast("long").alias("n_spans"), F.sha2(F.array_join("_kept", "\n").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i, line, strlen(line) + 1 AS size FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
runs AS (
  SELECT doc_id, i, 1 AS n, size, size AS head, md5(line) AS content FROM lines QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT r.doc_id, r.i, r.n + 1, r.size + l.size, r.head, md5(r.content || l.line) AS content
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.i = r.i + r.n
  WHERE r.size - r.head < {LEAST}  -- longer runs are unions of shorter ones
  QUALIFY count(*) OVER (PARTITION BY md5(r.content || l.line)) > 1),
later AS (
  SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, content ORDER BY doc_id, i) AS copy FROM runs WHERE size >= {LEAST}),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM later WHERE copy > 1),
marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS out,
         coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS out_before
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT out_before) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
