"""Structured Streaming over span life-cycle events and answer deltas.

A span or an answer may stay open for any time, so nothing here depends on a watermark or a
time-out. Folds by least and greatest agree in any order, so a batch of life-cycle events leaves its own
fold in a level log, where folds meet as segments are joined; readers see open spans as running and answers as
far as they came. Numbers need those of earlier batches: the state of a streaming aggregation, kept by
Spark's state store beside the query's checkpoint, of which a batch looks up and changes the keys that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelagia.cluster import scratch_path, settle
from pelagia.operators.ordering import numbered
from pelagia.operators.redaction import sanitize_payloads, sanitize_updates
from pelagia.operators.traces import (ENTRY, answer_assembly, entry_rows, folded_entries, glue_neighbours,
                                      span_rows)
from pelagia.streaming.log import LevelLog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, file_name: str, schema, files: int | None = None) -> DataFrame:
    """A Parquet file source over files of one name or pattern; ``files`` bounds those of a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """New queries keep their state in RocksDB, beyond the heap, unless the session names a provider."""
    if spark.conf.get(PROVIDER, "").rsplit(".", 1)[-1] not in ("", "HDFSBackedStateStoreProvider"):
        yield
        return
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def take_in(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what the stream holds now through ``each`` and return the finished query."""
    with state_on_disk(frame.sparkSession):
        query = (frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


# -- spans -------------------------------------------------------------------------------------

class SpanLog:
    """Takes in life-cycle events; what belongs to one span may be any number of batches apart.

    The log holds one row for each thing that is known of a span (its start, its end, a field, a key
    of a map), so that the details of an update merge key by key whenever it comes. It is the only copy: a state
    store beside it would hold the same values twice more, in the executors' folders and in the checkpoint.
    """

    def __init__(self, path: str, values: dict[str, str] | None = None, maps: tuple[str, ...] = ()) -> None:
        self.values, self.maps = values or {}, maps
        self.log = LevelLog(path, ENTRY, folded_entries)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        self.log(folded_entries(batch), batch_id)

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return take_in(entry_rows(events, tuple(self.values), self.maps), self._take, checkpoint)

    def spans(self, spark: SparkSession) -> DataFrame:
        """Every span seen so far, running ones too; the same rows as ``span_fold`` over all events.

        Segments are folded already, so rows go straight to their span: one shuffle serves both aggregations.
        """
        entries = self.log.read(spark).repartition("trace_id", "span_id")
        return span_rows(folded_entries(entries), self.values, self.maps)


# -- numbers -----------------------------------------------------------------------------------

NUMBERED = "trace_id string, span_id string, occurred_at timestamp, sequence_no long"


class SequenceLog:
    """Numbers the spans of each trace 0, 1, 2, ... across micro-batches, in start order.

    The state is the number of starts of each trace, an aggregation that combines before its shuffle. A batch
    gets the new counts of its own traces beside its rows, places its rows among themselves
    (``ordering.numbered``, which cuts a large trace into slices), and shifts them.
    """

    def __init__(self, path: str) -> None:
        self.log = LevelLog(path, NUMBERED)

    def _placed(self, batch: DataFrame, batch_id: int) -> None:
        rows = settle(batch)  # the batch's plan holds the state; it runs once
        placed = settle(numbered(rows.filter("total is null").drop("total"), ["trace_id"], ["occurred_at", "span_id"], "sequence_no"))
        here = placed.groupBy("trace_id").agg(F.count("*").alias("_here"))
        totals = rows.filter("total is not null").select("trace_id", "total").join(here, "trace_id")
        before = totals.select("trace_id", (F.col("total") - F.col("_here")).alias("_before")).filter("_before > 0")
        shifted = placed.join(before, "trace_id", "left").withColumn("sequence_no", F.col("sequence_no") + F.coalesce("_before", F.lit(0)))
        self.log(shifted.select("trace_id", "span_id", "occurred_at", "sequence_no"), batch_id)

    def run(self, starts: DataFrame, checkpoint: str) -> StreamingQuery:
        rows = starts.select("trace_id", "span_id", "occurred_at", F.lit(None).cast("long").alias("total"))
        totals = starts.groupBy("trace_id").agg(F.count("*").alias("total")).select(
            "trace_id", F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("timestamp").alias("occurred_at"), "total")
        return take_in(rows.unionByName(totals), self._placed, checkpoint, "update")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.log.read(spark)


def number_available(starts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Number what the stream of starts holds now and read the rows back."""
    log = SequenceLog(path)
    log.run(starts, checkpoint)
    return log.rows(starts.sparkSession)


# -- answers -----------------------------------------------------------------------------------

DELTA = "trace_id string, seq long, kind string, content string, deltas long"


class AnswerLog:
    """Takes in answer deltas as they come; their order is that of ``seq``, not of arrival.

    Where segments are joined, texts whose deltas follow one another become one, so that a delta is copied
    about log2(batches) times and reading joins few pieces.
    """

    def __init__(self, path: str) -> None:
        self.log = LevelLog(path, DELTA, glue_neighbours)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        self.log(glue_neighbours(batch), batch_id)

    def run(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        return take_in(deltas.select("trace_id", "seq", "kind", "content", F.lit(1).cast("long").alias("deltas")), self._take, checkpoint)

    def answers(self, spark: SparkSession) -> DataFrame:
        """Reasoning, answer and last usage of every trace, as far as its deltas came."""
        return answer_assembly(self.log.read(spark))


# -- safe forms --------------------------------------------------------------------------------

def safe_stream(events: DataFrame, columns: list[str]) -> DataFrame:
    """JSON payload columns in their safe form, before anything is stored."""
    return sanitize_payloads(events, columns)


def safe_updates(events: DataFrame) -> DataFrame:
    """Updates of spans in their safe form: payloads, error text, id lists and lists of references."""
    return sanitize_updates(events)


def write_parquet(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (frame.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_available(frame: DataFrame, label: str) -> DataFrame:
    """Process what is there now and read the sink back."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    query = write_parquet(frame, path, f"{path}-progress")
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)
