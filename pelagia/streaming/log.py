"""What micro-batches leave behind, in segments of growing size."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from pelagia.cluster import shuffles_removed
from pelagia.sources.storage import children, exists, make_folder, remove, write_text

DONE = ".done"


class Segment(NamedTuple):
    """The batches from ``low`` up to, but without, ``high``."""

    low: int
    high: int

    @property
    def name(self) -> str:
        return f"{self.low:012d}-{self.high:012d}"

    def within(self, other: Segment) -> bool:
        return other != self and other.low <= self.low and self.high <= other.high


class LevelLog:
    """Rows of micro-batches in a folder per segment; a new batch absorbs the segments before it that aren't larger.

    So there are about log2(batches) folders, a row is rewritten about log2(batches) times, and most batches
    rewrite little. ``merged`` may shorten the rows of several segments as they are joined. A segment counts once its
    marker is there; those that it absorbed go when the next batch comes, so that a reader at work keeps its
    files. A batch that is repeated after a restart finds itself in a segment and writes nothing.
    """

    def __init__(self, path: str, schema: str, merged: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.path, self.schema, self.merged = path, schema, merged

    def segments(self, spark: SparkSession) -> tuple[list[Segment], list[Segment]]:
        """Those that count, in order, and those absorbed by them."""
        if not exists(spark, self.path):
            return [], []
        names = {f.name for f in children(spark, self.path)}
        done = sorted(Segment(*map(int, n.removesuffix(DONE).split("-"))) for n in names
                      if n.endswith(DONE) and n.removesuffix(DONE) in names)
        live = [s for s in done if not any(s.within(o) for o in done)]
        return live, [s for s in done if s not in live]

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        make_folder(spark, self.path)
        live, absorbed = self.segments(spark)
        for old in absorbed:
            remove(spark, f"{self.path}/{old.name}{DONE}")
            remove(spark, f"{self.path}/{old.name}")
        if any(s.low <= batch_id < s.high for s in live):
            return
        new = Segment(batch_id, batch_id + 1)
        self._write(spark, rows, new)
        low = batch_id
        while live and live[-1].high - live[-1].low <= batch_id + 1 - low:
            low = live.pop().low
        if low < batch_id:
            joined = self._read(spark, [s for s in self.segments(spark)[0] if s.low >= low])
            self._write(spark, self.merged(joined) if self.merged else joined, Segment(low, batch_id + 1))

    def _write(self, spark: SparkSession, rows: DataFrame, segment: Segment) -> None:
        with shuffles_removed(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{segment.name}")
        write_text(spark, f"{self.path}/{segment.name}{DONE}", "")

    def _read(self, spark: SparkSession, segments: list[Segment]) -> DataFrame:
        paths = [f"{self.path}/{s.name}" for s in segments]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """What all batches left."""
        return self._read(spark, self.segments(spark)[0])
