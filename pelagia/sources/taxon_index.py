"""An inverted index over taxonomy paths, so that a taxon is looked up instead of searched for.

Paths are few beside variants. The index numbers the distinct lower-case paths of a marker in alphabetic order, so that
relatives have neighbouring numbers, and keeps four tables in folders by bucket:

* ``levels``: each whole level of a path, by the level's hash;
* ``grams``: each run of three characters of a path, by the run's hash;
* ``paths``: the paths themselves;
* ``variants``: the metadata rows with their path's number, by ranges of numbers.

A lookup names the buckets that it needs as literals, so the scans list no other folders. What it finds by runs of
characters is checked on the paths. Callers apply their own predicate again, so that results cannot depend on the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.cluster import BROADCAST_ROWS, settle
from pelagia.contracts import METADATA_COLUMNS
from pelagia.operators.ordering import numbered

BUCKETS = 64
GRAM = 3
#: Path numbers that a scan gets as literals; beyond it they are joined.
LISTED = 1000
SCHEMAS = {
    "levels": "path_no long, level string, marker string, bucket int",
    "grams": "path_no long, gram string, marker string, bucket int",
    "paths": "path_no long, path string, marker string, bucket int",
    "variants": ", ".join(f"{c} {'long' if c in ('total', 'spread') else 'string'}" for c in METADATA_COLUMNS)
    + ", path_no long, marker string, bucket int",
}
TABLES = tuple(SCHEMAS)


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _grams(text: str) -> list[str]:
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def _write(frame: DataFrame, path: str, order: list[str]) -> None:
    keys = ["marker", "bucket", *order]
    frame.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite") \
        .option("compression", "zstd").partitionBy("marker", "bucket").parquet(path)


def build(metadata: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write the index of metadata rows; null taxonomy is in no table but ``variants``, in a bucket of its own."""
    lowered = metadata.select("marker", *METADATA_COLUMNS, F.lower("taxonomy").alias("path"))
    distinct = lowered.filter("path is not null").select("marker", "path").distinct()
    paths = settle(numbered(distinct, ["marker"], ["path"], "path_no"))
    sizes = paths.groupBy("marker").agg((F.floor(F.max("path_no") / buckets) + 1).alias("range"))
    placed = settle(paths.join(F.broadcast(sizes), "marker").withColumn("bucket", F.floor(F.col("path_no") / F.col("range")).cast("int")))  # a row per marker
    _write(placed.select("marker", "bucket", "path_no", "path"), f"{folder}/paths", ["path_no"])
    levels = paths.select("marker", "path_no", F.explode(F.array_distinct(F.split("path", ";", -1))).alias("level"))
    _write(levels.withColumn("bucket", _bucket(F.col("level"), buckets)), f"{folder}/levels", ["level", "path_no"])
    starts = F.sequence(F.lit(1), F.char_length("path") - (GRAM - 1))
    runs = paths.filter(F.char_length("path") >= GRAM).select(
        "marker", "path_no", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("path", i, F.lit(GRAM))))).alias("gram"))
    _write(runs.withColumn("bucket", _bucket(F.col("gram"), buckets)), f"{folder}/grams", ["gram", "path_no"])
    rows = lowered.join(placed.select("marker", "path", "path_no", "bucket"), ["marker", "path"], "left").drop("path")
    _write(rows.withColumn("bucket", F.coalesce("bucket", F.lit(-1))), f"{folder}/variants", ["path_no", "amplicon"])


class TaxonIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def table(self, name: str, marker: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}").filter(F.col("marker") == marker)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _buckets_of(self, values: list[str]) -> list[int]:
        """Where the values lie; a constant row, so no job runs."""
        row = self.spark.range(1).select(*[_bucket(F.lit(v), self.buckets).alias(f"_{i}") for i, v in enumerate(values)])
        return sorted(set(row.first()))

    def path_numbers(self, marker: str, taxon: str, mode: str = "level") -> DataFrame:
        """(path_no, bucket of variants and paths) of the paths that match."""
        wanted = taxon.lower()
        if mode == "level":
            found = self.table("levels", marker, self._buckets_of([wanted])).filter(F.col("level") == wanted).select("path_no")
            return self._with_bucket(found, marker)
        grams = _grams(wanted)
        if not grams:  # shorter than a run
            return self.table("paths", marker).filter(F.contains("path", F.lit(wanted))).select("path_no", "bucket")
        having = self.table("grams", marker, self._buckets_of(grams)).filter(F.col("gram").isin(grams)) \
            .groupBy("path_no").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("path_no")
        near = self._with_bucket(having, marker)
        return self._restricted(self.table("paths", marker), near).filter(F.contains("path", F.lit(wanted))).select("path_no", "bucket")

    def _with_bucket(self, numbers: DataFrame, marker: str) -> DataFrame:
        paths = self.table("paths", marker)
        last = paths.agg(F.max("path_no")).first()[0]  # from the footers' range
        size = 1 if last is None else last // self.buckets + 1
        return numbers.withColumn("bucket", F.floor(F.col("path_no") / size).cast("int"))

    def _restricted(self, rows: DataFrame, numbers: DataFrame) -> DataFrame:
        """Rows of the numbered paths; only their buckets are listed, and few numbers reach the scan."""
        held = settle(numbers.select("path_no", "bucket").distinct())
        buckets = [r.bucket for r in held.select("bucket").distinct().collect()]  # at most ``buckets``
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.limit(0)
        few = [r.path_no for r in held.select("path_no").limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return rows.filter(F.col("path_no").isin(few)) if few else rows.limit(0)
        return rows.join(held.select("path_no"), "path_no", "left_semi")

    def variants(self, marker: str, taxon: str, mode: str = "level") -> DataFrame:
        """Metadata rows of the matching variants."""
        return self._restricted(self.table("variants", marker), self.path_numbers(marker, taxon, mode)).select("marker", *METADATA_COLUMNS)

    def narrowed(self, metadata: DataFrame, marker: str, taxon: str, mode: str = "level", most: int = BROADCAST_ROWS) -> DataFrame:
        """The matching variants, or all of ``metadata`` where so many match that a lookup doesn't pay."""
        found = self.variants(marker, taxon, mode)
        return found if found.limit(most + 1).count() <= most else metadata
