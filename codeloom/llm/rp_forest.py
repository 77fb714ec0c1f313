"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched best-first through one
priority queue over all trees, with exact scores of all rows in the leaves that were reached."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.base import constants, stored
from codeloom.llm.vectors import matrix, packed
from codeloom.session import cut

#: Trees; rows a leaf should hold; rows that the split points are fitted on (the bound of the sample; every row is
#: indexed); share of a query's best sample rows that a search reaches before it stops, and least number of those.
TREES, LEAF_ROWS, SAMPLE, COVER, WITNESSES = 6, 256, 8192, 0.97, 40
#: Leaves (as a power of two) and rows that one scoring group holds.
GROUP_LEVELS, GROUP_ROWS = 4, 8192


class Forest:
    """Split planes and split points of all trees; its size depends on the number of leaves, at most SAMPLE / 16 a tree."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int, trees: int = TREES):
        self.dim = sample.shape[1] if sample.size else 1
        self.depth = max(0, min(math.ceil(math.log2(max(1, rows / LEAF_ROWS))), int(math.log2(max(1, len(sample) / 16)))))
        nodes = (1 << self.depth) - 1
        draw = np.random.default_rng(int(constants(1, 21)[0]))
        planes = draw.normal(size=(trees, nodes, self.dim))
        self.planes = planes / np.linalg.norm(planes, axis=2, keepdims=True)
        self.splits = np.zeros((trees, nodes))
        for t in range(trees):
            inside = {0: np.arange(len(sample))}
            for node in range(nodes):
                own = inside.pop(node)
                side = sample[own] @ self.planes[t, node]
                self.splits[t, node] = np.median(side) if len(own) else 0.0
                inside[2 * node + 1], inside[2 * node + 2] = own[side < self.splits[t, node]], own[side >= self.splits[t, node]]
        self.rows, self.k = rows, k
        self.sample, self.sample_ids = sample, ids
        self.sample_leaves = self.leaves(sample).tolist() if len(sample) else []
        self.square = float((sample ** 2).sum(1).mean()) if len(sample) else 1.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """n x trees: leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            side = x @ self.planes[t].T >= self.splits[t] if self.depth else np.zeros((len(x), 0), bool)
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def known(self, q: np.ndarray, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the sample rows (-inf for a query's own id) and the bound of each query: its k-th best, if any."""
        scores = q @ self.sample.T
        scores[qid[:, None] == self.sample_ids] = -np.inf
        k = self.k
        return scores, np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)

    def search(self, q: np.ndarray, scores: np.ndarray) -> list[list[tuple[int, int]]]:
        """(tree, leaf) pairs to score for each query, in the order the shared queue gives them; ``scores`` of the sample.

        The search stops on what it has scored: the query's best sample rows are its witnesses, and leaves are opened
        until COVER of them are reached. The sample is a random part of the table, so the share of witnesses reached is
        that of all rows as near as they are, however rows are spread; the wanted neighbours are nearer still. Only the
        order is a guess: a neighbour is taken to lie at the inner product of the sample row of its rank, spread evenly
        otherwise, so each side of a split has a probability, and a node's priority is the product on its path. The queue
        holds nodes of all trees; a query's own leaf in every tree comes first."""
        if not self.depth:
            return [[(0, 0)]] * len(q)
        norm = np.linalg.norm(q, axis=1)
        m = min(max(WITNESSES, 2 * self.k), scores.shape[1])
        best = np.argsort(-scores, axis=1, kind="stable")[:, :m]
        level = np.take_along_axis(scores, best, 1)[:, min(m, math.ceil(self.k * scores.shape[1] / self.rows)) - 1]
        most = 0.98 * math.sqrt(self.square)
        along = np.clip(level / norm, -most, most)
        spread = np.sqrt(np.maximum(self.square - along ** 2, 1e-9) / max(1, self.dim - 1))
        trees = len(self.planes)
        cosine = np.einsum("qd,tnd->qtn", q / norm[:, None], self.planes)
        z = (along[:, None, None] * cosine - self.splits) / (spread[:, None, None] * np.sqrt(np.maximum(1 - cosine ** 2, 1e-9)))
        right = 1 / (1 + np.exp(-np.clip(1.702 * z, -40, 40)))
        first = (1 << self.depth) - 1
        out = []
        for p, own, witnesses, s in zip(right, self.leaves(q).tolist(), best.tolist(), scores):
            p = p.tolist()
            witnesses = [w for w in witnesses if s[w] > -np.inf]
            at: dict = {}
            for w in witnesses:
                for place in enumerate(self.sample_leaves[w]):
                    at.setdefault(place, []).append(w)
            found = list(enumerate(own))
            opened = set(found)
            reached = {w for place in found for w in at.get(place, ())}
            queue = [(-1.0, t, 0) for t in range(trees)]
            while queue and len(reached) < COVER * len(witnesses):
                chance, t, node = heapq.heappop(queue)
                if node >= first:
                    place = (t, node - first)
                    if place not in opened:
                        found.append(place)
                        reached.update(at.get(place, ()))
                else:
                    r = p[t][node]
                    heapq.heappush(queue, (chance * (1 - r), t, 2 * node + 1))
                    heapq.heappush(queue, (chance * r, t, 2 * node + 2))
            out.append(found)
        return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            seeded: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``.

    Rows are dealt to (tree, subtree) groups, queries to the groups of the leaves they reach; a group with more than
    GROUP_ROWS rows (many copies of one vector) is split by row and its queries go to every part. Each part gives its k
    best per query, ties to the smaller id, and the best of all parts are kept. Rows below the k-th best of the sample
    cannot be among the k nearest and are not sent. Invalid vectors and null ids take no part; repeated ids are separate
    candidates, but a query's own id is never one. An empty table gives no rows; other columns are not looked at.

    ``seeded``: the k best of the scored sample are candidates too; without, only what the forest reaches is given."""
    rows, kind = packed(vectors, vec_id, embedding)
    rows, n = cut(rows.where("id is not null"))
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "vec").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(Forest(matrix([r.vec for r in sample], kind), np.array([r.id for r in sample]), n, k))

    def deal(batches):
        for batch in batches:
            x = matrix(batch.column("vec"), kind)
            if not len(x):
                continue
            leaf = shared.value.leaves(x)
            trees = leaf.shape[1]
            take = pa.array(np.repeat(np.arange(len(x)), trees))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))), pa.array((leaf >> min(GROUP_LEVELS, shared.value.depth)).ravel().astype(np.int32)),
                pa.array([[v] for v in leaf.ravel().tolist()], pa.list_(pa.int64())), pa.nulls(len(take), pa.float64()), batch.column("id").take(take), batch.column("vec").take(take)],
                names=["tree", "part", "leaves", "least", "id", "vec"])

    def ask(batches):
        forest = shared.value
        shift = min(GROUP_LEVELS, forest.depth)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                piece = batch.slice(s, 256)
                out = {"tree": [], "part": [], "leaves": [], "at": []}
                q = matrix(piece.column("vec"), kind)
                scores, least = forest.known(q, piece.column("id").to_numpy())
                for i, found in enumerate(forest.search(q, scores)):
                    groups: dict = {}
                    for t, leaf in found:
                        groups.setdefault((t, leaf >> shift), []).append(leaf)
                    for (t, part), leaves in groups.items():
                        for name, v in zip(out, (t, part, leaves, i)):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["tree"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["leaves"], pa.list_(pa.int64())), pa.array(least[out["at"]]),
                    piece.column("id").take(pa.array(out["at"], pa.int64())), piece.column("vec").take(pa.array(out["at"], pa.int64()))],
                    names=["tree", "part", "leaves", "least", "id", "vec"])

    def seeds(batches):
        """The k best rows of the sample: candidates that every query has."""
        forest = shared.value
        for batch in batches:
            q, qid = matrix(batch.column("vec"), kind), batch.column("id").to_numpy()
            for s in range(0, len(q), 256):
                score, _ = forest.known(q[s:s + 256], qid[s:s + 256])
                best = [np.lexsort((forest.sample_ids, -x))[:k] for x in score]
                best = [b[x[b] > -np.inf] for b, x in zip(best, score)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(qid[s:s + 256], [len(b) for b in best])), pa.array(forest.sample_ids[np.concatenate(best)]),
                    pa.array(np.concatenate([x[b] for b, x in zip(best, score)]))], names=["query_id", "vec_id", "score"])

    form = "tree int, part int, leaves array<long>, least double, id long, vec binary"
    members = rows.mapInArrow(deal, form)
    queries = rows.where(F.col("id") % every == 0)
    asked = queries.mapInArrow(ask, form)
    sizes = members.groupBy("tree", "part").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("subs"))
    members = members.join(sizes, ["tree", "part"]).withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int")).withColumn("kind", F.lit(0))
    asked = asked.join(sizes, ["tree", "part"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("kind", F.lit(1))

    def scored(batches):
        group, held, ids, leaf = None, [], [], []

        def flush(q, qid, asked_leaves, least, m):
            score = q @ m[0].T
            ok = (score >= least[:, None] - 1e-9) & (qid[:, None] != m[1])
            for i, wanted in enumerate(asked_leaves):
                ok[i] &= np.isin(m[2], wanted)
            score[~ok] = -np.inf
            out = []
            for i in range(len(q)):
                at = np.flatnonzero(ok[i])
                if len(at) > k:
                    edge = np.partition(score[i, at], len(at) - k)[len(at) - k]
                    at = at[score[i, at] >= edge]
                    at = at[np.lexsort((m[1][at], -score[i, at]))[:k]]
                out.append((np.full(len(at), qid[i]), m[1][at], score[i, at]))
            return [np.concatenate([o[j] for o in out]) for j in range(3)]

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "sub"))))
            kinds, rid = batch.column("kind").to_numpy(), batch.column("id").to_numpy()
            x, leaves = matrix(batch.column("vec"), kind), batch.column("leaves").to_pylist()
            least = batch.column("least").to_numpy(zero_copy_only=False)
            s = 0
            while s < len(key):
                e = s
                while e < len(key) and key[e] == key[s] and kinds[e] == kinds[s] and e - s < 512:
                    e += 1
                if key[s] != group:
                    group, held, ids, leaf = key[s], [], [], []
                if kinds[s] == 0:
                    held.append(x[s:e]), ids.append(rid[s:e]), leaf.append([v[0] for v in leaves[s:e]])
                elif held:
                    if len(held) > 1 or isinstance(leaf[0], list):
                        held, ids, leaf = [np.concatenate(held)], [np.concatenate(ids)], [np.concatenate(leaf)]
                    a, b, c = flush(x[s:e], rid[s:e], leaves[s:e], least[s:e], (held[0], ids[0], leaf[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])
                s = e

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = ["tree", "part", "sub", "kind", "leaves", "least", "id", "vec"]
    both = members.select(*cols).unionByName(asked.select(*cols)).repartition(parts, "tree", "part", "sub")
    found = both.sortWithinPartitions("tree", "part", "sub", "kind").mapInArrow(scored, "query_id long, vec_id long, score double")
    if seeded:
        found = found.unionByName(queries.mapInArrow(seeds, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
