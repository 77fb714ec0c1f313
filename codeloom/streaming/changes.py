"""Apply a stream of file changes to a snapshot folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans.sync import apply_changes, build
from codeloom.session import cut
from codeloom.sources import snapshot
from codeloom.sources.java_tree import MAX_FILE_BYTES

CHANGE = "status string, path string, text string, at long"
BATCH = "last_change_batch"
OVERSIZED = "oversized_in_last_batch"


def follow(spark: SparkSession, changes_dir: str, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follow Parquet files of changes (status A/M/D, path, text, at).

    Within a batch the last change of a path counts. A text over the size that a
    scan reads counts as deleted here too, and is reported in the snapshot's
    metadata. The batch id is stored in the snapshot it produced, so a batch
    replayed after a failure changes nothing."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("status", "text"), "at").alias("c")).select("path", "c.*")
        kept = (F.col("status") != "D") & (F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_FILE_BYTES)
        last, _ = cut(last.withColumn("kept", kept))
        texts = last.filter("kept").select("path", "text")
        gone = last.filter("not kept").select("path")
        oversized = last.filter("not kept and status <> 'D'").count()
        session = batch.sparkSession
        if snapshot.current_version(session, folder):
            index = snapshot.load(session, folder)
            if int(index.metadata.get(BATCH, "-1")) >= batch_id:
                return
            index = apply_changes(index, texts, gone)
        else:
            index = build(texts)
        index.metadata[BATCH] = str(batch_id)
        index.metadata[OVERSIZED] = str(oversized)
        snapshot.save(index, folder)

    stream = spark.readStream.schema(CHANGE).parquet(changes_dir).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.start()
