"""Session helpers: conf lookups and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import codeloom

#: Rows a traversal frontier or lookup side may have before it is joined by a
#: shuffle instead of a broadcast (ids are < 100 bytes, so about 50 MB).
BROADCAST_ROWS = 500_000

#: Rows one join key may hold before its rows are spread over several tasks.
HOT_KEY_ROWS = 1_000_000


#: Stands in for ``spark.checkpoint.dir`` in local sessions that do not set it.
LOCAL_FOLDER = "/tmp/checkpoints"


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return default if value is None else int(value)


def broadcast_rows(spark: SparkSession) -> int:
    return conf_int(spark, "spark.codeloom.broadcastRows", BROADCAST_ROWS)


def hot_key_rows(spark: SparkSession) -> int:
    return conf_int(spark, "spark.codeloom.hotKeyRows", HOT_KEY_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    LOCAL_FOLDER is used only where the setting is absent *and* the session is
    local (tests, bench); on a cluster a missing setting is an error, because a
    machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(LOCAL_FOLDER)
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package: its sources go to the shared folder as a zip file that Spark adds to the Python path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    data = io.BytesIO()
    top = Path(codeloom.__file__).parent
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"codeloom/{f.relative_to(top).as_posix()}"), f.read_bytes())
    body = data.getvalue()
    path = f"{shared_dir(spark).rstrip('/')}/codeloom-{hashlib.sha256(body).hexdigest()[:16]}-{sc.applicationId}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(body))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> tuple[DataFrame, int]:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Returns the stored DataFrame and its row count, which is observed during
    the write, so no second job runs.
    """
    stored, seen = cut_counted(df, {})
    return stored, seen["rows"]


def cut_counted(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """As ``cut``, with further aggregates that the same write observes; ``rows`` is the row count."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{uuid.uuid4().hex}"
    seen = Observation()
    if _open:
        _open[-1].append(path)
    with _shuffles_dropped(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counters.items()]).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside the block go with its end. Nothing else reads them, and Spark would keep them until the
    driver collects garbage, so that a plan of many tables held the shuffles of all on disk."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes inside the block are deleted at its end, but for those handed to the function it gives.
    What leaves the block must be such a table, or read none that was written in it."""
    mine: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.extend(f.rsplit("/", 1)[0] for f in table.inputFiles())
        return table

    _open.append(mine)
    try:
        yield keep
    finally:
        _open.pop()
    stay = {k.rsplit("/", 1)[-1] for k in kept}
    sc = spark.sparkContext
    for path in mine:
        if path.rsplit("/", 1)[-1] in stay:
            if _open:
                _open[-1].append(path)
            continue
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """Give per-row heavy work on a table scan at least one task per core.

    Only for plain scans: their split count is known without running anything.
    A table that comes in enough splits (any large one) is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
