"""Session defaults, the shared working folder, and materialisation that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a count proved that it holds no more rows than this.
BROADCAST_ROWS = 1_000_000
# The same in bytes, for rows that carry texts such as sequences, questions or error messages.
BROADCAST_BYTES = 64 << 20
# What a broadcast row takes besides its texts.
ROW_BYTES = 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "pelagia", cores: int | str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    active = context.getCheckpointDir()
    if active is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pelagia-"))
        active = context.getCheckpointDir()
    return active.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove the files of their shuffles when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a reread gives the same rows."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fits_broadcast(frame: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame of short keys stays below the broadcast bound, by counting it."""
    return frame.count() <= rows


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the size check passes; otherwise leave the join to AQE."""
    return F.broadcast(frame) if fits_broadcast(frame, rows) else frame


def broadcast_if_light(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same for rows with texts, whose bytes are added up in one aggregation."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in frame.schema.fields]
    size = frame.agg(F.sum(sum(texts, F.lit(ROW_BYTES)).cast("long")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(frame) if size <= limit else frame


def in_parallel(spark: SparkSession, *jobs: Callable[[], Any]) -> list:
    """Run independent Spark jobs side by side; the first failure in list order is raised."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inherit(job)) for job in jobs]
        return [r.result() for r in running]


def spread(frame: DataFrame, per_core: int = 4) -> DataFrame:
    """Short rows dealt over all cores before they grow or are worked on at length: a small file is one task otherwise."""
    return frame.repartition(per_core * frame.sparkSession.sparkContext.defaultParallelism)


def all_null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """``left.a <=> right.b`` for every pair, joined with AND."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
