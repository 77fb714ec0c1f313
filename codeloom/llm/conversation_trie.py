"""The prefix trie of all conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is found by a 128-bit fingerprint of its prefix (the exclusive or of a
hash of every turn and its place), so a conversation of any length is fingerprinted in parts. The smallest conversation
through a node names it: (conv_id, depth) is unique, and the nodes that one conversation names form one downward path.

Totals go from children to parents. The trie is cut into bands of BAND levels and, inside a band, into shards: the
highest subtrees that hold at most SHARD_ROWS turns of all their members. Nodes above those are heavy; there are few, as
each stands for more rows than a shard. A shard's nodes come in reverse level order from Spark's external sort; each
takes the messages addressed to it from a priority queue that spills, and sends its total to its parent. The same
sweep then runs across shard roots and heavy nodes, and once more over shards that have other shards below them.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.base import stored
from codeloom.operators.skew import lookup_join
from codeloom.session import cut

#: Levels of a band, turns of a shard, messages a queue holds in memory, bytes of one piece of a list of ids.
BAND, SHARD_ROWS, HELD, CHUNK = 1024, 100_000, 200_000, 1 << 20

_ENTRY = struct.Struct("<qqqq")


class SpillingQueue:
    """Messages (level, conv_id, leaves, saved) taken deepest level first, then by conv_id. More than ``held`` of them go
    to a sorted run in Spark's own scratch folder; the file has no name and ends with the task."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, level: int, conv: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-level, conv, leaves, saved))
        if len(self.heap) > self.held:
            self.spill()

    def spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        for entry in sorted(self.heap):
            file.write(_ENTRY.pack(*entry))
        file.seek(0)
        self.heap = []
        self._advance(file)

    def _advance(self, file) -> None:
        if body := file.read(_ENTRY.size):
            heapq.heappush(self.runs, (_ENTRY.unpack(body), id(file), file))
        else:
            file.close()

    def take(self, level: int, conv: int) -> tuple[int, int]:
        """Sum of all messages for one node; they are the first in the queue when the node's turn comes."""
        leaves = saved = 0
        key = (-level, conv)
        while self.heap and self.heap[0][:2] == key:
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:2] == key:
            (_, _, a, b), _, file = heapq.heappop(self.runs)
            leaves, saved = leaves + a, saved + b
            self._advance(file)
        return leaves, saved


_TOTALS = "conv_id long, depth long, n_leaves long, saved_tokens long"


def sweep(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Subtree totals in every shard. ``rows(top, top_depth, depth, conv_id, message, up, up_depth, leaves, saved)``: nodes with
    their own values and their parent (``up`` null: none in this shard), or messages for the node (conv_id, depth)."""

    def run(batches):
        shard, queue = None, SpillingQueue(held)
        extra = [0, 0]
        for batch in batches:
            out: list[tuple] = []
            for top, top_depth, depth, conv, message, up, up_depth, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                if (top, top_depth) != shard:
                    shard, queue, extra = (top, top_depth), SpillingQueue(held), [0, 0]
                if message:  # sorted before its node
                    extra = [extra[0] + leaves, extra[1] + saved]
                    continue
                more = queue.take(depth, conv)
                leaves, saved = leaves + more[0] + extra[0], saved + more[1] + extra[1]
                extra = [0, 0]
                out.append((conv, depth, leaves, saved))
                if up is not None:
                    queue.push(up_depth, up, leaves, saved)
            columns = [*zip(*out)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv_id", "depth", "n_leaves", "saved_tokens"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("top", "top_depth", "depth", "conv_id", "message", "up", "up_depth", "leaves", "saved").repartition(
        n, "top", "top_depth").sortWithinPartitions("top", "top_depth", F.desc("depth"), "conv_id", F.desc("message"))
    return ordered.mapInArrow(run, _TOTALS)


def numbered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns(part, conv_id, at, digest, size), runs(part, conv_id, at, before, n)): turns in the order (conv_id, turn with
    null first, content), cut into parts of even size, so that a long conversation lies in many; and the place in its
    conversation at which each part begins. Equal turns are told apart by read position and may lie in several parts."""
    body, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, body).cast("binary"))).alias("digest"),
        F.octet_length(body).cast("long").alias("size"), F.monotonically_increasing_id().alias("tie"))
    rows, order = stored(rows), ["conv_id", "turn", "digest", "tie"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", "digest", "size", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
    runs = placed.groupBy("part", "conv_id").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a part
    return placed, stored(runs.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))


def prefixes(turns: DataFrame, runs: DataFrame, borrow: bool) -> tuple[DataFrame, DataFrame]:
    """(convs(conv_id, length), rows(conv_id, depth, length, f1, f2, up1, up2, size)): every first d turns of every conversation
    with the fingerprints of the prefix and of the one before it. With ``borrow``, conversation c begins with the first
    h = crc32(c) mod 9 turns of c - c mod 5 and goes on with its own after its first h."""
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9 if borrow else F.lit(0).cast("long")
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    given = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(given, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    # A part's share of a conversation is bounded by the part, so this key has no hot value.
    info = runs.drop("n").withColumnRenamed("at", "first").join(convs, "conv_id")
    rows = stored(turns.join(info, ["part", "conv_id"]).withColumn("place", F.col("before") + F.col("at") - F.col("first")))
    mine = rows.where("place >= h").select("conv_id", "part", (F.col("lent") + F.col("place") - F.col("h") + 1).alias("depth"), "length", "digest", "size")
    heads = rows.where("place < 8").select(F.col("conv_id").alias("base"), "place", "digest", "size")
    lent = convs.where("lent > 0").join(heads, "base").where("place < h").select(
        "conv_id", F.lit(-1).cast("long").alias("part"), (F.col("place") + 1).alias("depth"), "length", "digest", "size")
    both = mine.unionByName(lent).withColumns({f"g{i}": F.xxhash64(F.lit(i), "digest", "depth") for i in (1, 2)}).drop("digest")
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumns({f"x{i}": F.bit_xor(f"g{i}").over(here) for i in (1, 2)})
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("conv_id", "part").agg(*[F.bit_xor(f"g{i}").alias(f"c{i}") for i in (1, 2)])
    carried = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"c{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    whole = local.join(carried, ["conv_id", "part"])
    f = {i: F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}
    return convs, stored(whole.select("conv_id", "depth", "length", "size", *[f[i].alias(f"f{i}") for i in f],
                                      *[f[i].bitwiseXOR(F.col(f"g{i}")).alias(f"up{i}") for i in f]))


def _shards(rows: DataFrame, band: int, shard_rows: int) -> DataFrame:
    """``rows`` with the node's name ``named``, ``n_convs`` and its shard's root (top, top_depth; null: a heavy node)."""
    level = F.floor((F.col("depth") - 1) / band).cast("long")
    key = ["depth", "f1", "f2"]
    below = F.least("length", (level + 1) * band) - F.col("depth") + 1
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("named"), F.count(F.lit(1)).alias("n_convs"), F.sum(below).alias("below"))
    # A prefix that most conversations share is a hot key of the many-sided rows; this join spreads it.
    named = stored(lookup_join(rows, nodes, key, "inner", stored=True).drop("f1", "f2", "up1", "up2").withColumn("band", level))
    tops = named.where(F.col("below") <= shard_rows).groupBy("conv_id", "band").agg(F.min(F.struct("depth", "named")).alias("t")).select(
        "conv_id", "band", F.col("t.depth").alias("top_depth"), F.col("t.named").alias("top"))  # at most a band's levels a key
    inside = F.col("depth") >= F.col("top_depth")
    return stored(named.join(tops, ["conv_id", "band"], "left").select(
        "conv_id", "depth", "length", "size", "named", "n_convs", F.when(inside, F.col("top")).alias("top"),
        F.when(inside, F.col("top_depth")).alias("top_depth")))


def _totals(nodes: DataFrame, held: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of ``nodes(conv_id, depth, up, top, top_depth, up_top, up_top_depth, leaves,
    saved)``: own values summed over subtrees, within shards, then across their roots."""
    is_top = F.col("top").isNull() | ((F.col("top") == F.col("conv_id")) & (F.col("top_depth") == F.col("depth")))
    within = nodes.where("top is not null").withColumns({
        "message": F.lit(False), "up_depth": F.col("depth") - 1, "up": F.when(~is_top, F.col("up"))})
    first = stored(sweep(within, held))
    # Shard roots with their shard's totals, and heavy nodes with their own values; each points to its parent's shard root,
    # or to the parent itself where that is heavy.
    sums = first.select("conv_id", "depth", "n_leaves", "saved_tokens")
    roots = nodes.where(is_top).join(sums, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("n_leaves", "leaves").alias("leaves"), F.coalesce("saved_tokens", "saved").alias("saved"),
        F.coalesce("up_top", "up").alias("to"), F.coalesce("up_top_depth", F.col("depth") - 1).alias("to_depth"), "up", "up_top", "up_top_depth")
    roots = stored(roots)
    inner = roots.where("to is not null").select(F.col("to").alias("conv_id"), F.col("to_depth").alias("depth")).distinct()
    outer = roots.join(inner, ["conv_id", "depth"], "left_anti")  # nothing below: its total is final and is summed before it is sent
    sent = outer.where("to is not null").groupBy(F.col("to").alias("conv_id"), F.col("to_depth").alias("depth")).agg(
        F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
    core = roots.join(inner, ["conv_id", "depth"]).join(sent, ["conv_id", "depth"], "left").select(
        F.lit(0).alias("top"), F.lit(0).alias("top_depth"), "depth", "conv_id", F.lit(False).alias("message"), F.col("to").alias("up"),
        F.col("to_depth").alias("up_depth"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    across = stored(sweep(core, held).unionByName(outer.select(
        "conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))))
    final = roots.where("up_top is not null").join(across, ["conv_id", "depth"])
    messages, n = cut(final.select(F.col("up_top").alias("top"), F.col("up_top_depth").alias("top_depth"), (F.col("depth") - 1).alias("depth"),
                                   F.col("up").alias("conv_id"), F.lit(True).alias("message"), F.lit(None).cast("long").alias("up"),
                                   F.lit(None).cast("long").alias("up_depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    heavy = across.join(nodes.where("top is null").select("conv_id", "depth"), ["conv_id", "depth"])
    if not n:
        return first.unionByName(heavy)
    touched = messages.select("top", "top_depth").distinct()
    columns = messages.columns
    second = sweep(within.join(touched, ["top", "top_depth"], "left_semi").select(*columns).unionByName(messages), held)
    rest = within.join(touched, ["top", "top_depth"], "left_anti").select("conv_id", "depth").join(first, ["conv_id", "depth"])
    return second.unionByName(rest).unionByName(heavy)


def _ends(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``rows(named, depth, conv_id)``: digest of the ids in ascending order, comma-joined. Ids are
    joined in range-sorted parts first, so a node at which very many end reaches its task as pieces of text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(batches, names) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names))

    def joined(batches):
        key, ids, size, out = None, [], 0, []

        def close():
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))

        for named, depth, conv in groups(batches, ("named", "depth", "conv_id")):
            if (named, depth) != key or size > CHUNK:
                close()
                key, ids, size = (named, depth), [], 0
            ids.append(conv)
            size += 8
            if len(out) >= 1000 or sum(len(o[3]) for o in out[-2:]) > CHUNK:
                yield piece(out)
                out.clear()
        close()
        yield piece(out)

    def piece(out):
        named, depth, first, body = [*zip(*out)] or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (named, depth, first)], pa.array(body, pa.string())],
                                          names=["named", "depth", "first", "body"])

    def digest(batches):
        key, h, out = None, None, []
        for named, depth, body in groups(batches, ("named", "depth", "body")):
            if (named, depth) != key:
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = (named, depth), hashlib.sha256(body.encode())
            else:
                h.update(b"," + body.encode())
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if key:
            out.append((*key, h.hexdigest()))
        yield table(out)

    def table(out):
        named, depth, sha = [*zip(*out)] or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())],
                                          names=["conv_id", "depth", "ends_sha256"])

    order = ["named", "depth", "conv_id"]
    made = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        joined, "named long, depth long, first long, body string")
    return made.repartition(n, "named", "depth").sortWithinPartitions("named", "depth", "first").mapInArrow(
        digest, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, borrow: bool = True, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         band: int = BAND, shard_rows: int = SHARD_ROWS, held: int = HELD) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The node's own turn is turn ``depth`` of conversation ``conv_id`` (rebuilt, with ``borrow``; see ``prefixes``).

    Turns go by ``turn`` (null first), ties by content; repeated rows are turns of their own; a null role or text counts as
    empty. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes, not even a
    root. Other columns are not looked at."""
    convs, rows = prefixes(*numbered(conversations, conv_id, turn, role, text), borrow)
    named = _shards(rows, band, shard_rows)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    none, root_id = F.lit(None).cast("long"), F.lit(top.first().conv_id).cast("long")
    top = top.where("n_convs > 0")
    before = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("named").alias("up"), F.col("top").alias("up_top"),
                          F.col("top_depth").alias("up_top_depth"))
    own = named.where("named = conv_id").join(before, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_convs", "size", "top", "top_depth", F.coalesce("up", root_id).alias("up"), "up_top", "up_top_depth")
    root = top.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("size"), none.alias("top"),
                      none.alias("top_depth"), none.alias("up"), none.alias("up_top"), none.alias("up_top_depth"))
    nodes = stored(own.unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    valued = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    ends = named.where("depth = length").select("named", "depth", "conv_id").unionByName(
        convs.where("length = 0").select(root_id.alias("named"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    return nodes.join(_totals(valued, held), ["conv_id", "depth"]).join(_ends(ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
