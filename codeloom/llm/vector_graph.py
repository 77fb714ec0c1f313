"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one class. Classes are dealt to overlapping cluster shards (the two nearest of centroids fitted on a
bounded sample; a large cluster is split by row). Each shard builds a flat graph by robust pruning and keeps every edge
in both directions, so each node can be reached; the adjacency lists of a class from its shards are united. Every class
is then searched in its nearest shards and in all whose centroid is in range: a greedy beam search starts from the
shard's medoid (and from the class itself where the shard holds it) and, once it meets vectors in range, expands through
all of them. Links are verified in double precision on the original vectors. A link counts for both ends: where the other
end does not search the shards of this one, it is counted for it here. Only counts per class and a spanning forest of
the links leave a task, never all pairs of a group. ``audit`` counts links by brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import stored
from codeloom.llm.components import components
from codeloom.llm.vectors import is_valid, matrix, packed
from codeloom.session import cut

#: Least cosine of a link; cosine from which the range phase walks on.
LEAST, WALK = 0.9, 0.85
#: Rows a shard should hold, shards a row is built into and at least searched in, sample for the centroids and their largest number.
SHARD_ROWS, OVERLAP, PROBES, SAMPLE, MOST_CLUSTERS = 3072, 2, 4, 8192, 1024
#: Graph: candidates by nearness and at random, out-degree, slack of the pruning; beam of the greedy phase.
NEAR, RANDOM, DEGREE, SLACK, BEAM = 40, 8, 24, 1.2, 24
#: Vectors whose links are counted again by brute force.
AUDITED = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, a few rounds from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(6):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where((np.linalg.norm(sums, axis=1) > 0)[:, None], unit(sums), c)
    return c


def prune(cand: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of all rows at once: take the nearest candidate left, drop those that it is closer to (by the
    slack) than the row is. ``cand`` n x c sorted by nearness, -1 for none; ``near`` their similarities."""
    n = len(cand)
    alive = cand >= 0
    out = np.full((n, degree), -1, np.int32)
    rows = np.arange(n)
    for r in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        p = np.where(some, cand[rows, first], -1)
        out[:, r] = p
        closer = SLACK ** 2 * (1 - sims[p[:, None], cand]) <= 1 - near
        alive &= ~(closer & some[:, None])
        alive[rows, first] = False
    return out


def build(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(borders, neighbours): adjacency of one shard's unit vectors, those of node i from borders[i] to borders[i + 1]. Each
    node keeps DEGREE edges at most, and every edge is kept in both directions; the shard's size bounds the similarities held."""
    n = len(x)
    if n < 2:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    f = x.astype(np.float32)
    sims = f @ f.T
    np.fill_diagonal(sims, -2)
    c = min(NEAR, n - 1)
    cand = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    cand = np.concatenate([cand, np.random.default_rng(seed).integers(0, n, (n, RANDOM))], axis=1)

    def ordered(cand):
        near = np.where(cand >= 0, np.take_along_axis(sims, np.maximum(cand, 0), 1), -3)
        near[cand == np.arange(n)[:, None]] = -3
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        again = np.zeros(cand.shape, bool)
        again[:, 1:] = cand[:, 1:] == cand[:, :-1]
        return np.where((near > -2) & ~again, cand, -1), near

    def two_way(near):
        src, dst = np.repeat(np.arange(n), DEGREE), near.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        pair = np.unique(np.r_[src, dst].astype(np.int64) * n + np.r_[dst, src])
        return pair // n, pair % n

    a, b = two_way(prune(*ordered(cand), sims, DEGREE))
    order = np.lexsort((-sims[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    both = np.full((n, min(int(place.max()) + 1, 4 * DEGREE) if len(a) else 1), -1, np.int64)
    ok = place < both.shape[1]
    both[a[ok], place[ok]] = b[ok]
    a, b = two_way(prune(*ordered(both), sims, DEGREE))
    return np.searchsorted(a, np.arange(n + 1)), b


def table_of(lists: list[list]) -> np.ndarray:
    """Lists of cluster numbers as one table, -1 for none."""
    out = np.full((len(lists), max(map(len, lists), default=0)), -1, np.int64)
    for row, v in zip(out, lists):
        row[:len(v)] = v
    return out


class Shard:
    """One shard while it is searched: ids, unit vectors, copies, probed clusters, adjacency within the shard."""

    def __init__(self, me: tuple, ids, vec, copies, probes, lists):
        self.me, self.ids, self.x, self.copies, self.probes = me, ids, vec, copies, table_of(probes)
        self.homes = np.array([(v + v)[:2] for v in probes])
        #: Links of members to queries that the member's own search does not ask for.
        self.owed = np.zeros(len(ids), np.int64)
        self.f = vec.astype(np.float32)
        order = np.argsort(ids)
        ranked = ids[order]
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
        at = np.minimum(np.searchsorted(ranked, flat), len(ids) - 1)
        here = ranked[at] == flat
        owner, to = owner[here], order[at[here]]
        self.borders, self.to = np.searchsorted(owner, np.arange(len(ids) + 1)), to
        self.order, self.ranked = order, ranked
        self.medoid = int((self.x @ self.x.mean(0)).argmax())
        self.root = np.arange(len(ids))

    def own(self, qid: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ranked, qid), len(self.ids) - 1)
        return np.where(self.ranked[at] == qid, self.order[at], -1)

    def edges(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``r`` repeated for, and beside it, the neighbours of the nodes ``c``."""
        many = self.borders[c + 1] - self.borders[c]
        at = np.repeat(self.borders[c] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(r, many), self.to[at]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def search(self, qid: np.ndarray, q: np.ndarray, copies: np.ndarray, probes: list[list]) -> tuple:
        """(links counted here, one linked id or -1) per query; joins linked nodes in the shard's forest. Links that the
        other end does not ask for are added to its ``owed``."""
        m, n = len(q), len(self.ids)
        f = q.astype(np.float32)
        seen = np.zeros((m, n), bool)
        score = np.full((m, n), -2, np.float32)
        rows = np.arange(m)
        mine = self.own(qid)

        def visit(r, c):
            new = np.zeros(m * n, bool)
            new[(r * n + c)[c >= 0]] = True
            new &= ~seen.ravel()
            at = np.flatnonzero(new)
            seen.ravel()[at] = True
            r, c = at // n, at % n
            for s in range(0, len(at), 1 << 15):
                score[r[s:s + (1 << 15)], c[s:s + (1 << 15)]] = np.einsum("ij,ij->i", f[r[s:s + (1 << 15)]], self.f[c[s:s + (1 << 15)]])
            return r, c

        visit(rows, np.full(m, self.medoid))
        visit(rows[mine >= 0], mine[mine >= 0])
        done = np.zeros((m, n), bool)
        width = min(BEAM, n)
        while True:  # greedy: the best node of the beam that is not expanded yet, for all queries at once
            beam = np.argpartition(-score, width - 1, axis=1)[:, :width]
            best = np.where(np.take_along_axis(done, beam, 1), -3, np.take_along_axis(score, beam, 1))
            pick = best.argmax(1)
            live = best[rows, pick] > -2
            if not live.any():
                break
            r, c = rows[live], beam[rows, pick][live]
            done[r, c] = True
            visit(*self.edges(r, c))
        r, c = np.nonzero(score >= WALK)
        while len(r):  # range: expand through everything near enough
            todo = ~done[r, c]
            r, c = r[todo], c[todo]
            done[r, c] = True
            found_r, found_c = [], []
            for s in range(0, len(r), 1 << 15):
                a, b = visit(*self.edges(r[s:s + (1 << 15)], c[s:s + (1 << 15)]))
                found_r.append(a), found_c.append(b)
            r, c = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_r, found_c))
            close = score[r, c] >= WALK
            r, c = r[close], c[close]
        r, c = np.nonzero(score >= LEAST - 1e-4)
        ok = np.zeros(len(r), bool)
        for s in range(0, len(r), 1 << 15):
            i, j = r[s:s + (1 << 15)], c[s:s + (1 << 15)]
            ok[s:s + (1 << 15)] = (np.einsum("ij,ij->i", q[i], self.x[j]) >= LEAST) & (qid[i] != self.ids[j])
        r, c = r[ok], c[ok]
        # A vector stands in two shards; it is counted in the one that the query probes first.
        count = np.zeros(m, np.int64)
        if len(r):
            other = np.where(self.homes[c, 0] == self.me[0], self.homes[c, 1], self.homes[c, 0])
            before = np.zeros((m, max(int(self.homes.max()), max(map(max, probes))) + 2), bool)
            for i, list_ in enumerate(probes):
                before[i, list_[:list_.index(self.me[0])]] = True
            counted = ~before[r, other]
            np.add.at(count, r[counted], self.copies[c[counted]])
            r1, c1 = r[counted], c[counted]
            near = np.array([(v + v)[:2] for v in probes])
            asks = np.zeros(len(r1), bool)
            for j in range(self.probes.shape[1]):
                asks |= (self.probes[c1, j, None] == near[r1]).any(1)
            np.add.at(self.owed, c1[~asks], copies[r1[~asks]])
        first = np.full(m, -1, np.int64)
        if len(r):
            head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            first[r[head]] = c[head]
            a, b = first[r], c
            a, b = np.r_[a, mine[r[head]]], np.r_[b, c[head]]
            a, b = a[a >= 0], b[a >= 0]
            while not np.array_equal(flat := self.root[self.root], self.root):
                self.root = flat
            for i, j in zip(*(v[self.root[a] != self.root[b]].tolist() for v in (a, b))):
                i, j = self.find(i), self.find(j)
                if i != j:
                    self.root[max(i, j)] = min(i, j)
        return count, np.where(first >= 0, self.ids[first], -1)


def grouped(batches, kind):
    """(shard, rows of kind 0 as one table, iterator of tables of kind 1) from rows sorted by shard and kind."""
    shard, held = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("c", "sub", "kind")], axis=1)
        turn = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True]) if len(key) else []
        for a, b in zip(turn[:-1], turn[1:]):
            me = (int(key[a, 0]), int(key[a, 1]))
            if me != shard:
                if shard is not None:
                    yield shard, held, None
                shard, held = me, []
            if key[a, 2] == 0:
                held.append(batch.slice(a, b - a))
            else:
                yield shard, held, batch.slice(a, b - a)
    if shard is not None:
        yield shard, held, None


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec, n, n_links, component, audit) per class of equal valid vectors; ``audit`` is the brute-force number of
    links of the AUDITED classes with the smallest hashes, null elsewhere."""
    rows, kind = packed(vectors, vec_id, embedding)
    spark = vectors.sparkSession
    made = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    unnamed = -1 - F.shiftrightunsigned(F.xxhash64("vec"), 1)  # stands for a class whose ids are all null
    classes, total = cut(made.select(F.coalesce("id", unnamed).alias("id"), "vec", "n"))
    if total == 0:
        return spark.createDataFrame([], "id long, vec binary, n long, n_links long, component long, audit long")
    sample = unit(matrix([r.vec for r in classes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").collect()], kind))
    k = int(min(max(1, -(-total * OVERLAP // SHARD_ROWS)), MOST_CLUSTERS, len(sample)))
    shared = spark.sparkContext.broadcast(centroids(sample, k))

    def route(batches):
        for batch in batches:
            x = unit(matrix(batch.column("vec"), kind))
            if not len(x):
                continue
            cosine = x @ shared.value.T
            order = np.argsort(-cosine, axis=1, kind="stable")
            many = np.maximum((cosine >= WALK).sum(1), min(PROBES, order.shape[1]))
            probes = [v[:m].tolist() for v, m in zip(order, many)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], names=["id", "vec", "n", "probes"])

    routed = stored(classes.select("id", "vec", "n").mapInArrow(route, "id long, vec binary, n long, probes array<int>"))
    placed = routed.withColumn("c", F.explode(F.slice("probes", 1, OVERLAP)))
    sizes = placed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD_ROWS)).cast("int").alias("subs"))  # at most MOST_CLUSTERS rows
    members = placed.join(F.broadcast(sizes), "c").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("c", "sub", F.lit(0).alias("kind"), "id", "vec").repartition(parts, "c", "sub").sortWithinPartitions("c", "sub", "kind", "id")

    def graphs(batches):
        for me, held, asked in grouped(batches, kind):
            if asked is None:
                t = pa.Table.from_batches(held)
                ids = t.column("id").to_numpy()
                borders, near = build(unit(matrix(t.column("vec"), kind)), me[0] * 65537 + me[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids[near], pa.int64()))], names=["id", "near"])

    lists = dealt.mapInArrow(graphs, "id long, near array<long>")
    united = stored(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # from OVERLAP shards
    none = F.lit(None)
    nodes = members.join(united, "id").select("c", "sub", F.lit(0).alias("kind"), "id", "vec", "n", "probes", "near")
    asked = routed.withColumn("c", F.explode("probes")).join(F.broadcast(sizes), "c").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    asked = asked.select("c", "sub", F.lit(1).alias("kind"), "id", "vec", "n", "probes", none.cast("array<long>").alias("near"))

    def searches(batches):
        at = None
        for me, held, q in grouped(batches, kind):
            if at is None or at.me != me:
                if not held:
                    continue
                t = pa.Table.from_batches(held)
                at = Shard(me, t.column("id").to_numpy(), unit(matrix(t.column("vec"), kind)), t.column("n").to_numpy(), t.column("probes").to_pylist(),
                           [np.asarray(v, np.int64) for v in t.column("near").to_pylist()])
            if q is None:
                for i in range(len(at.ids)):
                    at.root[i] = at.find(i)
                moved = at.root != np.arange(len(at.ids))
                i = np.flatnonzero(moved | (at.owed > 0))
                yield pa.RecordBatch.from_arrays([pa.array(at.ids[i]), pa.array(at.owed[i]), pa.array(at.ids[at.root[i]], mask=~moved[i])], names=["id", "n_links", "to"])
                continue
            for s in range(0, q.num_rows, 256):
                piece = q.slice(s, 256)
                qid = piece.column("id").to_numpy()
                count, to = at.search(qid, unit(matrix(piece.column("vec"), kind)), piece.column("n").to_numpy(), piece.column("probes").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(count), pa.array(to, pa.int64(), mask=to == -1)], names=["id", "n_links", "to"])

    both = nodes.unionByName(asked).repartition(parts, "c", "sub").sortWithinPartitions("c", "sub", "kind", "id")
    found = stored(both.mapInArrow(searches, "id long, n_links long, to long"))
    joined = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    out = classes.join(counted, "id").join(joined, "id", "left").join(audit(classes, kind), "id", "left")
    return out.select("id", "vec", "n", (F.col("others") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "audit")


def audit(classes: DataFrame, kind: str, queries: int = AUDITED) -> DataFrame:
    """(id, audit): links of a fixed number of classes, counted against all rows in blocks."""
    chosen = classes.orderBy(F.xxhash64("id", "vec"), "id").limit(queries).collect()
    ids, q = np.array([r.id for r in chosen], np.int64), unit(matrix([r.vec for r in chosen], kind))

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            x, n, rid = unit(matrix(batch.column("vec"), kind)), batch.column("n").to_numpy(), batch.column("id").to_numpy()
            for s in range(0, len(x), 2048):
                total += ((q @ x[s:s + 2048].T >= LEAST) * (n[s:s + 2048] - (ids[:, None] == rid[s:s + 2048]))).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "audit"])

    return classes.mapInArrow(count, "id long, audit long").groupBy("id").agg(F.sum("audit").alias("audit"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_links of every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Equal vectors link with each
    other, so repeated rows count as vectors; a null id takes part, and a negative number stands for a component without
    any id (its rows are kept). An empty table gives no rows; other columns are not looked at."""
    found = link(vectors, vec_id, embedding)
    # The class is found again by the vector itself, as ids may be null or repeated.
    narrow = vectors.schema[embedding].dataType
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(narrow).alias("_e"))
    good, _ = packed(rows, "vec_id", "_e")
    linked = good.withColumnRenamed("id", "vec_id").join(found, "vec").select("vec_id", "n_links", F.col("component").alias("component_id"), "audit")
    bad = rows.where(~is_valid(F.col("_e"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("long").alias("audit"))
    return linked.unionByName(bad).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
                                          F.col("audit").alias("audited_links"))
