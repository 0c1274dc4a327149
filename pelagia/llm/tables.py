"""Reading inputs, storing steps in the shared folder, and joins whose side is measured first."""

from __future__ import annotations

import ctypes
import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.cluster import CLEANUP, scratch_path, shuffles_removed  # noqa: F401
from pelagia.sources.storage import remove

#: Bytes of keys that a broadcast side may hold.
KEY_BYTES = 32 << 20
#: The same for rows with sketches or texts; the driver holds them as results, as a table and as blocks to send.
PAYLOAD_BYTES = 16 << 20
#: Where a Python process keeps its encoders (``tokens.encoder``).
ENCODERS = "_pelagia_encoders"
#: For each thread inside ``passing`` blocks, the folders that ``stored`` wrote in each of them.
_STEPS: dict[int, list[list[str]]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, whatever reads it.

    Its shuffles are of no use any more then; their files would stay until the driver collects its garbage.
    """
    path = scratch_path(frame.sparkSession, label)
    if blocks := _STEPS.get(threading.get_ident()):
        blocks[-1].append(path)
    with shuffles_removed(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _of(frame: DataFrame, steps: list[str]) -> list[str]:
    """Those folders that the frame reads."""
    names = {file.rsplit("/", 2)[-2] for file in frame.inputFiles()}
    return [path for path in steps if path.rsplit("/", 1)[-1] in names]


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Steps stored in the block go when it ends, but for those read by the frames given to the function that it yields.

    These pass to the block around it. Other frames must not be read any more by then.
    """
    own, blocks = [], _STEPS.setdefault(threading.get_ident(), [])

    def keep(frame: DataFrame) -> DataFrame:
        for path in _of(frame, own):
            own.remove(path)
            if len(blocks) > 1:
                blocks[-2].append(path)
        return frame

    blocks.append(own)
    try:
        yield keep
    finally:
        blocks.pop()
        for path in own:
            remove(spark, path)


def discard(*frames: DataFrame) -> None:
    """Remove the steps of the innermost block that the frames read; nothing reads them any more."""
    blocks = _STEPS.get(threading.get_ident())
    steps = blocks[-1] if blocks else []
    for frame in frames:
        for path in _of(frame, steps):
            steps.remove(path)
            remove(frame.sparkSession, path)


def fits(frame: DataFrame, width: int, limit: int = KEY_BYTES) -> bool:
    """Whether rows of ``width`` bytes stay below the limit; they are counted."""
    return frame.count() * width <= limit


def small_side(frame: DataFrame, width: int) -> DataFrame:
    """A side of short rows, with a broadcast hint if its measured size allows it."""
    return F.broadcast(frame) if fits(frame, width) else frame


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def give_back() -> None:
    """Return freed memory to the system; Spark keeps a worker for later tasks, and several of them beside each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def forget_encoders() -> None:
    """Drop the encoders that earlier tasks left in this worker; they take more than most steps do themselves."""
    if sys.modules.pop(ENCODERS, None) is not None:
        give_back()


def arrow(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tidy: bool = False, encodes: bool = False) -> DataFrame:
    """``mapInArrow``; with ``tidy``, a task gives its worker's memory back when it ends, and what earlier steps left when it begins.

    Only a step that ``encodes`` goes on with the encoders of its worker's earlier tasks; any other drops them when it begins.
    """
    def tidied(batches):
        if not encodes:
            forget_encoders()
        if tidy:
            give_back()
        yield from work(batches)
        if tidy:
            give_back()
    return frame.mapInArrow(tidied, schema)
