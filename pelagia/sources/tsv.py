"""Tab-separated sources: typed scans, and wide count matrices turned into long tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.contracts import MAX_COUNT, METADATA_COLUMNS, SAMPLE_PREFIX, ContractError
from pelagia.sources.storage import data_files, filesystem

BOM = "\ufeff"
DIGITS = "0123456789"


def header_line(spark: SparkSession, file_path: str) -> str:
    """The first line of one file; only its first blocks are read."""
    jvm = spark._jvm
    stream = filesystem(spark, file_path).open(jvm.org.apache.hadoop.fs.Path(file_path))
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return (reader.readLine() or "").removeprefix(BOM)
    finally:
        reader.close()


def source_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a source; its other files are checked by the scans themselves."""
    files = data_files(spark, path)
    if not files:
        raise ContractError(f"no data files in {path}")
    return header_line(spark, files[0].path).split("\t")


def scan_typed_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated, never quoted, empty text is null; the header must be the schema's.

    Every file's header is compared with the schema by position when it is read, and a value
    that does not fit its type fails the scan.
    """
    if source_header(spark, path) != schema.names:
        raise ContractError(f"unexpected column order or names in {path}")
    return (spark.read.schema(schema).option("sep", "\t").option("header", "true")
            .option("quote", "").option("escape", "").option("nullValue", "")
            .option("emptyValue", "").option("enforceSchema", "false")
            .option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path))


def write_tsv(frame: DataFrame, path: str) -> None:
    (frame.write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("quote", "").option("nullValue", "").option("emptyValue", "").csv(path))


@dataclass(frozen=True)
class WideMatrix:
    """A parsed matrix: one row per line, the counts of a variant still in one array column."""

    marker: str
    samples: tuple[str, ...]
    parsed: DataFrame

    def stored(self, path: str, *also: Column) -> "tuple[WideMatrix, dict]":
        """Write the parsed lines and go on from there: the text is split only once.

        The faults, and what else is to be counted, are observed on the way.
        """
        seen = Observation()
        rows = self.parsed.observe(seen, *self.fault_counts(), *also)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return replace(self, parsed=self.parsed.sparkSession.read.parquet(path)), seen.get

    def rows(self) -> DataFrame:
        return self.parsed.filter("not is_header")

    def marker_samples(self) -> DataFrame:
        """The header's sample columns in header order; bounded by the width of one line."""
        spark = self.parsed.sparkSession
        return spark.createDataFrame(
            [(self.marker, s, i) for i, s in enumerate(self.samples)],
            "marker string, sample_id string, ordinal long")

    def metadata(self) -> DataFrame:
        return self.rows().select("marker", *METADATA_COLUMNS)

    def sample_sums(self, condition: Column, places: range) -> DataFrame:
        """Reads of some samples, by their places in the header, over the lines that fit: one scan, and one row to shuffle from each task."""
        sums = self.rows().filter(condition).agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)).alias(f"_{i}") for i in places])
        pairs = [F.struct(F.lit(self.samples[i]).alias("sample_id"), F.col(f"_{i}").alias("reads")) for i in places]
        return sums.select(F.inline(F.array(*pairs)))

    @staticmethod
    def fault_counts() -> list[Column]:
        """Lines that break the format, and rows whose counts do not fit their totals.

        Everything is computed inside the row, before any count is exploded or shuffled.
        """
        filled = F.filter("counts", lambda c: c.isNotNull())
        total = F.aggregate(filled, F.lit(0).cast("long"), lambda a, c: a + c)
        spread = F.size(F.filter(filled, lambda c: c > 0))
        data = ~F.col("is_header")
        return [
            F.count_if("is_header").alias("header_lines"),
            F.count_if(data & F.exists("counts", lambda c: c.isNull()))
            .alias("rows_with_missing_counts"),
            F.coalesce(F.sum("malformed_cells"), F.lit(0)).alias("malformed_cells"),
            F.count_if(F.col("extra_fields") > 0).alias("rows_with_extra_fields"),
            F.count_if(data & (F.col("total") != total)).alias("total_mismatches"),
            F.count_if(data & (F.col("spread") != spread)).alias("spread_mismatches")]

    def row_faults(self) -> DataFrame:
        """One row of ``fault_counts``."""
        return self.parsed.agg(*self.fault_counts())

    def cells(self) -> DataFrame:
        """Positive counts in long form.

        The explode and the filter run in one generated loop, so zeros leave it at once.
        """
        positive = self.rows().select("marker", "amplicon", F.posexplode("counts").alias(
            "ordinal", "reads")).filter("reads > 0")
        names = F.broadcast(self.marker_samples().drop("marker"))
        return positive.join(names, "ordinal").select("marker", "amplicon", "sample_id", "reads")


def _count(cell: Column) -> Column:
    return cell.try_cast("long")


def _malformed(cell: Column) -> Column:
    """Neither empty nor an unsigned 32-bit number."""
    plain = F.translate(cell, DIGITS, "") == F.lit("")
    return (cell != F.lit("")) & ~(plain & F.coalesce(_count(cell) <= MAX_COUNT, F.lit(False)))


def read_wide(spark: SparkSession, path: str, marker: str) -> WideMatrix:
    """Read a count matrix as text: one split per line, never a thousand-column schema."""
    header = source_header(spark, path)
    fixed = len(METADATA_COLUMNS)
    if tuple(header[:fixed]) != METADATA_COLUMNS:
        raise ContractError(f"unexpected metadata columns in {path}")
    samples = header[fixed:]
    if not samples or len(samples) != len(set(samples)):
        raise ContractError(f"missing or duplicate sample columns in {path}")
    foreign = [s for s in samples if not s.startswith(SAMPLE_PREFIX)]
    if foreign:
        raise ContractError(f"invalid sample ids in {path}: {foreign[:3]}")

    line = F.regexp_replace("value", f"^{BOM}", "")
    fields = F.split("line", "\t", -1)
    values = F.slice("fields", fixed + 1, len(samples))
    # A short line leaves its last counts missing.
    padded = F.concat(values, F.array_repeat(F.lit(""), F.lit(len(samples)) - F.size(values)))
    text = spark.read.text(path).select(line.alias("line")).filter("line <> ''").select(
        "line", F.xxhash64("line").alias("line_hash"),
        (F.col("line") == F.lit("\t".join(header))).alias("is_header"),
        fields.alias("fields")).withColumn("cells", padded).withColumn(
        "counts", F.col("cells").try_cast("array<long>"))
    # Most lines hold plain numbers only; just the others are looked at cell by cell.
    plain = ~F.concat_ws("", "cells").rlike("[^0-9]") \
        & (F.coalesce(F.array_max("counts"), F.lit(0)) <= MAX_COUNT)
    malformed = F.when(plain, 0).otherwise(F.size(F.filter("cells", _malformed)))
    data = lambda value: F.when(~F.col("is_header"), value)
    part = lambda i: data(F.nullif(F.get("fields", F.lit(i)), F.lit("")))
    parsed = text.select(
        F.lit(marker).alias("marker"), "is_header", "line_hash", part(0).alias("amplicon"),
        part(1).alias("taxonomy"), part(2).alias("confidence"), _count(part(3)).alias("total"),
        _count(part(4)).alias("spread"), part(5).alias("sequence"),
        data(F.col("counts")).alias("counts"), data(malformed).alias("malformed_cells"),
        data(F.greatest(F.size("fields") - (fixed + len(samples)), F.lit(0))).alias("extra_fields"))
    return WideMatrix(marker, tuple(samples), parsed)
