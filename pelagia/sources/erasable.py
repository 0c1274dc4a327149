"""Stored tables whose rows can be deleted by key without rewriting what doesn't hold them.

A table is a list of Parquet files and of tombstone tables, in one small file that is replaced as a whole. A
deletion writes its keys as a tombstone table and takes effect at once: readers leave those keys out. ``rewrite`` then finds the files
that hold such rows, by the file path that each row carries, writes their other rows anew, and lists the new files
instead. A run that stops halfway leaves the list as it was, and files that nothing lists.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelagia.cluster import broadcast_if_small, settle
from pelagia.sources import storage

LIST = "_list.json"


@dataclass
class Listing:
    schema: str
    files: list[str]
    tombstones: list[dict] = field(default_factory=list)  # column and folder


class ErasableTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, frame: DataFrame, path: str, order: list[str], parts: int | None = None) -> ErasableTable:
        """Rows clustered by ``order``, so that the rows of one key lie in few files; Spark chooses their number if none is given."""
        table = cls(frame.sparkSession, path)
        ranged = frame.repartitionByRange(*order) if parts is None else frame.repartitionByRange(parts, *order)
        files = table._added(ranged.sortWithinPartitions(*order))
        table._commit(Listing(frame.schema.json(), files))
        return table

    def listing(self) -> Listing:
        return Listing(**json.loads(storage.read_text(self.spark, f"{self.path}/{LIST}")))

    def _commit(self, listing: Listing) -> None:
        new = f"{self.path}/.{LIST}.{uuid.uuid4().hex}"
        storage.write_text(self.spark, new, json.dumps(vars(listing)))
        storage.replace(self.spark, new, f"{self.path}/{LIST}")

    def _added(self, rows: DataFrame) -> list[str]:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return [f"{folder}/{f.name}" for f in storage.data_files(self.spark, f"{self.path}/{folder}")]

    def _files(self, names: list[str], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        paths = [f"{self.path}/{name}" for name in names]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _keys(self, tombstone: dict) -> DataFrame:
        return broadcast_if_small(self.spark.read.parquet(f"{self.path}/{tombstone['folder']}"))

    def _left(self, rows: DataFrame, tombstones: list[dict]) -> DataFrame:
        for t in tombstones:
            rows = rows.join(self._keys(t), t["column"], "left_anti").select(rows.columns)
        return rows

    def read(self) -> DataFrame:
        """The rows that aren't deleted."""
        now = self.listing()
        return self._left(self._files(now.files, now.schema), now.tombstones)

    def erase(self, keys: DataFrame, column: str) -> None:
        """Delete the rows whose ``column`` is among ``keys`` (one column), at once for all later readers."""
        now = self.listing()
        folder = f"tombstones-{uuid.uuid4().hex}"
        keys.select(F.col(keys.columns[0]).alias(column)).filter(F.col(column).isNotNull()).distinct().write.parquet(f"{self.path}/{folder}")
        now.tombstones.append({"column": column, "folder": folder})
        self._commit(now)

    def touched(self) -> list[str]:
        """The files that hold deleted rows."""
        now = self.listing()
        rows = self._files(now.files, now.schema)
        found: set[str] = set()
        for t in now.tombstones:
            names = rows.select(t["column"], F.col("_metadata.file_path").alias("_file")).join(self._keys(t), t["column"], "left_semi")
            found |= {"/".join(r._file.rsplit("/", 2)[1:]) for r in names.select("_file").distinct().collect()}  # a listing of files
        return sorted(found)

    def rewrite(self) -> list[str]:
        """Write the files with deleted rows anew without them; the names of the files that went."""
        now, gone = self.listing(), self.touched()
        left = settle(self._left(self._files(gone, now.schema), now.tombstones))
        new = [] if left.isEmpty() else self._added(left)
        old = [t["folder"] for t in now.tombstones]
        self._commit(Listing(now.schema, [f for f in now.files if f not in set(gone)] + new))
        for name in (*gone, *old):
            storage.remove(self.spark, f"{self.path}/{name}")
        return gone


def erase_sessions(sessions: ErasableTable, messages: ErasableTable, traces: ErasableTable, spans: ErasableTable,
                   requested: DataFrame, user_id) -> DataFrame:
    """Delete the user's requested sessions and all that hangs on them; the deleted ids in request order.

    ``requested`` holds position and session_id. What hangs on a session goes first, so that a run that stops can be repeated.
    """
    own = sessions.read().filter(F.col("user_id") == F.lit(user_id)).select("session_id")
    deleted = settle(requested.join(own, "session_id", "left_semi"))
    ids = deleted.select("session_id").distinct()
    spans.erase(traces.read().join(ids, "session_id", "left_semi").select("trace_id"), "trace_id")
    for table in (traces, messages, sessions):
        table.erase(ids, "session_id")
    return deleted.orderBy("position")
