"""Processed tables on disk: layout, manifest, integrity, and lineage of reads."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.cluster import broadcast_if_light, broadcast_if_small
from pelagia.contracts import MARKERS, ContractError, id_frame
from pelagia.operators.ordering import page
from pelagia.operators.quality import require_unique
from pelagia.sources.storage import data_files, exists, read_text
from pelagia.sources.taxon_index import TABLES as TAXON_TABLES
from pelagia.sources.taxon_index import TaxonIndex

MANIFEST = "manifest.json"
UNKNOWN_SHOWN = 5


def write_table(frame: DataFrame, path: str, partition_by: list[str], order: list[str]) -> None:
    """Range-cluster and sort, so that files have narrow min/max ranges; zstd Parquet.

    The range key ends in a unique column, so one frequent key is cut over several files.
    """
    keys = [*partition_by, *order]
    writer = (frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .write.mode("overwrite").option("compression", "zstd"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


@dataclass
class Artifact:
    """What the manifest keeps about one stored table."""

    name: str
    path: str
    bytes: int
    rows: int
    columns: int
    fingerprint: str
    schema: dict[str, str] = field(default_factory=dict)
    sample_columns: int = 0


@dataclass
class Manifest:
    pipeline_version: str
    generation: str
    created_at: str
    sources: dict[str, dict]
    artifacts: dict[str, Artifact]
    coverage: dict[str, int]
    validation_report: str = "validation.json"

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True, ensure_ascii=False) + "\n"

    @classmethod
    def loads(cls, text: str) -> "Manifest":
        payload = json.loads(text)
        payload["artifacts"] = {k: Artifact(**v) for k, v in payload["artifacts"].items()}
        return cls(**payload)


class Store:
    """Typed scans over one published generation; opening it checks every artifact."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        if not exists(spark, f"{self.folder}/{MANIFEST}"):
            raise ContractError(f"no manifest in {self.folder}")
        try:
            self.manifest = Manifest.loads(read_text(spark, f"{self.folder}/{MANIFEST}"))
        except (ValueError, TypeError, KeyError) as error:
            raise ContractError(f"manifest cannot be read: {error}") from error
        self.generation = self._inside(self.folder, self.manifest.generation)
        broken = self.integrity().filter("not present or not size_matches")
        names = [r.artifact for r in broken.select("artifact").collect()]
        if names:
            raise ContractError(f"missing or incomplete artifacts: {names}")

    @staticmethod
    def _inside(parent: str, child: str) -> str:
        if child.startswith("/") or ".." in child.split("/") or ":" in child:
            raise ContractError(f"path leaves the data folder: {child}")
        return f"{parent}/{child}"

    def integrity(self) -> DataFrame:
        """One row per artifact: is it there, and does it have the recorded size?"""
        rows = []
        for item in self.manifest.artifacts.values():
            path = self._inside(self.generation, item.path)
            there = exists(self.spark, path)
            size = sum(f.size for f in data_files(self.spark, path)) if there else 0
            rows.append((item.name, there, item.bytes, size, there and size == item.bytes))
        return self.spark.createDataFrame(
            rows, "artifact string, present boolean, recorded_bytes long, found_bytes long, "
                  "size_matches boolean")

    def scan(self, name: str) -> DataFrame:
        item = self.manifest.artifacts[name]
        return self.spark.read.parquet(self._inside(self.generation, item.path))

    def report(self, name: str) -> DataFrame:
        """A stored report: missing_values, numeric_profile, categories, level_counts or
        coverage_ids."""
        return self.spark.read.parquet(self._inside(self.generation, f"reports/{name}"))

    def context(self) -> DataFrame:
        return self.scan("context")

    def metadata(self, marker: str | None = None) -> DataFrame:
        return of_marker(self.scan("metadata"), marker)

    def cells(self, marker: str | None = None) -> DataFrame:
        return of_marker(self.scan("abundance"), marker)

    def marker_samples(self, marker: str | None = None) -> DataFrame:
        return of_marker(self.scan("marker_samples"), marker)

    def taxon_index(self) -> TaxonIndex | None:
        """The lookup tables for taxa; older generations have none."""
        folder = self._inside(self.generation, "taxon_index")
        return TaxonIndex(self.spark, folder) if exists(self.spark, f"{folder}/{TAXON_TABLES[-1]}/_SUCCESS") else None

    def observed(self, name: str, frame: DataFrame, artifacts: list[str],
                 filters: dict[str, str] | None = None) -> "ObservedRead":
        """A read that counts its own rows while it is used, whatever it is used for."""
        seen = Observation()
        counted = frame.observe(seen, F.count(F.lit(1)).alias("row_count"))
        return ObservedRead(counted, lambda: self.lineage(name, artifacts, seen.get["row_count"], len(frame.columns), filters))

    def lineage(self, name: str, artifacts: list[str], rows: int, columns: int,
                filters: dict[str, str] | None = None) -> DataFrame:
        """One row per artifact that a named read used."""
        picked = [self.manifest.artifacts[a] for a in artifacts]
        return self.spark.createDataFrame(
            [(name, a.name, self.manifest.generation, self.manifest.pipeline_version,
              a.fingerprint, rows, columns, filters or {}) for a in picked], LINEAGE_SCHEMA)


@dataclass(frozen=True)
class ObservedRead:
    """``frame`` to be read whole once; then ``lineage()`` has a row per artifact, without another job."""

    frame: DataFrame
    lineage: Callable[[], DataFrame]


LINEAGE_SCHEMA = T.StructType([
    T.StructField("read", T.StringType()), T.StructField("artifact", T.StringType()),
    T.StructField("generation", T.StringType()), T.StructField("pipeline_version", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
])


def of_marker(frame: DataFrame, marker: str | None) -> DataFrame:
    if marker is None:
        return frame
    if marker not in MARKERS:
        raise ContractError(f"unknown marker: {marker}")
    return frame.filter(F.col("marker") == marker)


def unknown_ids(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested ids that the known id column does not hold."""
    left, right = requested.columns[0], known.columns[0]
    named = known.select(F.col(right).alias("_known"))
    return requested.join(named, F.col(left) == F.col("_known"), "left_anti")


def check_ids(requested: DataFrame, known: DataFrame) -> None:
    """Duplicates and unknown ids stop the run; only a handful reaches the message."""
    column = requested.columns[0]
    if not requested.groupBy(column).count().filter("count > 1").isEmpty():
        raise ContractError("requested sample ids contain duplicates")
    unknown = unknown_ids(requested, known)
    shown = [r[0] for r in page(unknown, [column], 0, UNKNOWN_SHOWN).collect()]
    if shown:
        raise ContractError(f"Unknown sample IDs: {shown}")


def context_by_ids(context: DataFrame, ids, key: str = "sample_id_pangaea") -> DataFrame:
    """Context rows of the requested ids."""
    wanted = id_frame(context.sparkSession, ids, "_wanted")
    check_ids(wanted, context.select(key))
    return context.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def sample_list(marker_samples: DataFrame) -> DataFrame:
    """Samples of each marker with their processed position."""
    return marker_samples.select("marker", "sample_id", "ordinal")


def abundance_slice(cells: DataFrame, marker_samples: DataFrame, ids) -> DataFrame:
    """Counts of the requested samples; ids are checked against the marker's own samples."""
    wanted = id_frame(cells.sparkSession, ids, "_wanted")
    check_ids(wanted, marker_samples.select("sample_id"))
    return of_samples(cells, wanted)


def of_samples(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Cells of some samples; the ids are broadcast when a count shows that they fit."""
    wanted = broadcast_if_small(id_frame(cells.sparkSession, ids, "_wanted"))
    return cells.join(wanted, F.col("sample_id") == F.col("_wanted"), "left_semi")


def marker_data(metadata: DataFrame, cells: DataFrame, taxonomy_contains: str | None = None,
                sample_ids=None, marker_samples: DataFrame | None = None) -> DataFrame:
    """Metadata joined with counts; ``taxonomy_contains`` is literal and case-sensitive.

    A variant that has two metadata rows raises before anything is joined. ``sample_ids`` keeps
    some samples; with ``marker_samples`` they are checked against the marker's own.
    """
    if taxonomy_contains is not None:
        metadata = metadata.filter(F.contains("taxonomy", F.lit(taxonomy_contains)))
    require_unique(metadata, ["marker", "amplicon"], "metadata_key_errors")
    if sample_ids is not None:
        cells = (of_samples(cells, sample_ids) if marker_samples is None
                 else abundance_slice(cells, marker_samples, sample_ids))
    return cells.join(broadcast_if_light(metadata), ["marker", "amplicon"])
