"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.base import append, flat, pieces
from codeloom.session import cut

#: Hashed features, latent dimensions, neighbours that vote, labelled rows per class that are fitted (a documented bound).
FEATURES, RANK, NEIGHBOURS, PER_CLASS = 2048, 48, 25, 1500
#: Labelled rows that the fit weights at a time.
BLOCK = 256


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams per text, n x FEATURES; digits count as one and letters as lower case. Trigrams
    do not cross texts; each text is read whole."""
    n = len(at) - 1
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[48:58] = 48
    x = fold[data]
    out = np.zeros((n, FEATURES), np.float32)
    if len(x) >= 3:
        code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        code = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int64)  # 11 bits: FEATURES
        for i in range(n):
            if at[i + 1] - at[i] >= 3:
                out[i] = np.bincount(code[at[i]:at[i + 1] - 2], minlength=FEATURES)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times inverse document frequency; a row without features stays zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Projection, labelled unit vectors and labels; about 600 kB, whatever the corpus."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, prior: float = 0.5):
        self.idf, self.labels, self.prior = idf.astype(np.float32), labels.astype(np.float64), prior
        self.basis = np.zeros((FEATURES, RANK), np.float32)
        # In blocks of rows: the driver holds no second copy of the counts.
        blocks = [counts[a:a + BLOCK] for a in range(0, max(1, len(counts)), BLOCK)]
        if len(labels):
            products = np.zeros((FEATURES, FEATURES))
            for block in blocks:
                x = weighted(block, self.idf).astype(np.float64)
                products += x.T @ x
            self.basis = np.linalg.eigh(products)[1][:, ::-1][:, :RANK].astype(np.float32)
        self.known = np.concatenate([self.project(block) for block in blocks])

    def project(self, counts: np.ndarray) -> np.ndarray:
        y = weighted(counts, self.idf) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each vote weighted by its cosine (floored just above
        zero). Ties in cosine go to the earlier labelled row. A zero vector has no nearest one: it gets the prior. No
        labelled rows: 0.5."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        own = self.project(counts).astype(np.float64)
        cosine = own @ self.known.T.astype(np.float64)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4
        share = np.clip((votes * self.labels[near]).sum(1) / votes.sum(1), 0.0, 1.0)
        return np.where(own.any(1), share, self.prior)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Document frequencies from all rows of ``docs``; the labelled vectors from at most PER_CLASS rows of each label
    (those with the smallest hashes) whose id is not held out; the prior is the share of label 1 among all such rows.
    Labelled vectors stand in the order of their contents, so that no id decides a tie."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def frequencies(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in pieces(batches, "text"):
            seen += (features(*flat(batch.column("text"))) > 0).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(FEATURES)]), pa.array([n, *seen.tolist()])], names=["feature", "n"])

    found = {r.feature: r.n for r in rows.select("text").mapInArrow(frequencies, "feature long, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = found.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + found.get(i, 0))) for i in range(FEATURES)])
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "doc_id is not null and quality in (0, 1)").where(~is_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Labelled ids may lack a document: semi join first, on ids alone, then take the bounded sample.
    there, _ = cut(marked.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"))
    prior = there.agg(F.avg("quality")).first()[0]
    parts = [there.where(F.col("quality") == q).orderBy(*order).limit(PER_CLASS) for q in (0, 1)]
    sample = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")  # at most 2 * PER_CLASS rows

    def vectors(batches):
        for batch in pieces(batches, "text"):
            x = features(*flat(batch.column("text"))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["doc_id", "quality", "counts"])

    got = sample.select("doc_id", "quality", "text").mapInArrow(vectors, "doc_id long, quality int, counts binary")
    # A repeated document id gives one vector.
    got = got.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("counts").alias("counts")).collect()
    got.sort(key=lambda r: (bytes(r.counts), r.quality))
    quality = np.array([r.quality for r in got])
    counts = np.empty((len(got), FEATURES), np.float32)
    for i in range(len(got)):  # a collected row goes as soon as it is read
        counts[i], got[i] = np.frombuffer(got[i].counts, np.uint32), None
    return Model(idf, counts, quality, 0.5 if prior is None else float(prior))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text, from the text alone. A null or empty text, or
    one of fewer than three bytes, has a zero vector and gets the prior. Every other document is compared exactly with all labelled vectors, in blocks; the model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)

    def make(batch):
        data, at = flat(batch.column(text))
        out = [shared.value.score(features(data[at[i]:at[j]], at[i:j + 1] - at[i]))
               for i in range(0, batch.num_rows, 512) if (j := min(i + 512, batch.num_rows)) > i]
        return [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

    return append(docs, text, [T.StructField(column, T.DoubleType())], make)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Repeated rows are scored alike; an empty table gives no rows; a
    null id is never held out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
