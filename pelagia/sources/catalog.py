"""Readiness and identity of the source files, as Spark jobs over files and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.contracts import METADATA_COLUMNS, SAMPLE_PREFIX, SOURCES
from pelagia.sources.storage import data_files
from pelagia.sources.tsv import BOM, header_line

NO_SAMPLES = "<no sample columns>"


def expected_sources(spark: SparkSession) -> DataFrame:
    """source, filename, required columns, and whether sample columns follow them."""
    return spark.createDataFrame([(key, *spec) for key, spec in SOURCES.items()],
                                 "source string, filename string, required array<string>, repeated boolean")


def _same_form(path: str):
    return F.regexp_replace(path, "^file:/+", "file:/")


def _plain(path: str) -> str:
    """The same for a path that the driver has, which may lack its scheme."""
    return "file:/" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else path


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """source, file, size_bytes of every file with content that belongs to a source; contents aren't read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select(_same_form("path").alias("file"), F.col("length").alias("size_bytes")))
    names = F.broadcast(expected_sources(spark).select("source", "filename"))  # four rows
    return found.join(names, F.array_contains(F.split("file", "/"), F.col("filename"))).drop("filename")


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file and header: the first line of every file that belongs to a source."""
    names = [spec[0] for spec in SOURCES.values()]
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(
        "_metadata.file_path", "_metadata.file_block_start", "value")
    mine = lines.where((F.col("file_block_start") == 0) & F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, names))))
    # Lines come in order inside a task, and a file's first block is in one; what is shuffled is one line per task and file.
    found = mine.withColumn("_at", F.monotonically_increasing_id()).groupBy(_same_form("file_path").alias("file")).agg(
        F.min_by("value", "_at").alias("header"))
    return found.select("file", F.regexp_replace("header", f"^{BOM}", "").alias("header"))


def header_contract(spark: SparkSession, folder: str) -> DataFrame:
    """One row per expected source: the headers of all its files against the required columns.

    A source of several files is ready when each of them is. Counts are those of its widest file.
    """
    folder = folder.rstrip("/")
    expected = F.broadcast(expected_sources(spark))
    files = files_of(spark, folder).join(header_lines(spark, folder), "file", "left").join(expected, "source")
    named = files.withColumn("columns", F.when(F.coalesce("header", F.lit("")) == "", F.array().cast("array<string>"))
                             .otherwise(F.split("header", "\t")))
    samples = F.when(F.col("repeated"), F.slice("columns", len(METADATA_COLUMNS) + 1, 1 << 30)).otherwise(F.array().cast("array<string>"))
    cells = named.select("source", "file", F.explode_outer("columns").alias("name"))
    doubled = (cells.groupBy("source", "file", "name").agg(F.count("*").alias("n")).where("n > 1")
               .groupBy("source").agg(F.array_sort(F.collect_set("name")).alias("duplicate_columns")))
    checked = named.withColumn("samples", samples).select(
        "source", "size_bytes", "columns", "samples",
        F.array_except("required", "columns").alias("missing"),
        F.when(F.col("repeated") & (F.size("samples") == 0), F.array(F.lit(NO_SAMPLES)))
        .otherwise(F.filter("samples", lambda c: ~c.startswith(SAMPLE_PREFIX))).alias("invalid"))
    per_source = checked.groupBy("source").agg(
        F.sum("size_bytes").alias("size_bytes"), F.max(F.size("columns")).alias("column_count"),
        F.max(F.size("samples")).alias("sample_column_count"), F.min("size_bytes").alias("least"),
        F.array_distinct(F.flatten(F.collect_list("missing"))).alias("missing_columns"),
        F.array_distinct(F.flatten(F.collect_list("invalid"))).alias("invalid_sample_columns"))
    rows = expected.join(per_source, "source", "left").join(doubled, "source", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("missing_columns", "duplicate_columns", "invalid_sample_columns")}
    faults = F.size(F.concat(*lists.values()))
    return rows.select(
        "source", "filename", F.col("size_bytes").isNotNull().alias("exists"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size_bytes", "column_count", "sample_column_count")],
        *[v.alias(c) for c, v in lists.items()],
        F.coalesce((F.col("least") > 0) & (F.col("column_count") > 0) & (faults == 0), F.lit(False)).alias("ready"))


def line_marks(line_hash: Column) -> list[Column]:
    """What files add up to: their lines, and the sum and xor of the lines' hashes."""
    return [F.count("*").alias("lines"),
            F.coalesce(F.sum(line_hash.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).alias("all_sum"),
            F.coalesce(F.bit_xor(line_hash), F.lit(0).cast("long")).alias("all_xor")]


MARKS = "lines long, all_sum decimal(38,0), all_xor long"
FILE_MARKS = "source string, file string, size_bytes long, modified_ms long, " + MARKS


def text_hash(value: str) -> Column:
    return F.xxhash64(F.regexp_replace(value, f"^{BOM}", ""))


def file_marks(spark: SparkSession, path: str, source: str, known: DataFrame | None = None) -> DataFrame:
    """One row per file of a source (``FILE_MARKS``); those that ``known`` has with the same size and time aren't read again."""
    listed = spark.createDataFrame([(source, _plain(f.path), f.size, f.modified_ms) for f in data_files(spark, path)],
                                   "source string, file string, size_bytes long, modified_ms long")
    keys = listed.columns
    kept = listed.limit(0).join(spark.createDataFrame([], MARKS)) if known is None else listed.join(known, keys, "left_semi").join(known, keys)
    new = [r.file for r in listed.join(kept, keys, "left_anti").collect()]  # a listing, which the driver holds anyway
    if not new:
        return kept
    lines = spark.read.text(new).select(_same_form("_metadata.file_path").alias("file"), "value").filter("value <> ''")
    read = lines.groupBy("file").agg(*line_marks(text_hash("value")))
    found = listed.filter(F.col("file").isin(new)).join(read, "file", "left").fillna(0, ["lines", "all_xor"]) \
        .withColumn("all_sum", F.coalesce("all_sum", F.lit(0).cast("decimal(38,0)")))
    return found.select(*keys, "lines", "all_sum", "all_xor").unionByName(kept.select(*keys, "lines", "all_sum", "all_xor"))


def source_fingerprint(spark: SparkSession, path: str, source: str, marks: DataFrame | None = None) -> DataFrame:
    """One row: bytes, data rows, columns, and a hash over the header and all data lines.

    Equal data has an equal hash at every size, in any order, and in any number of files.
    ``marks`` holds rows of ``line_marks`` that add up to the source, such as those of its files; without it the lines are read.
    """
    files = data_files(spark, path)
    header = header_line(spark, files[0].path)
    if marks is None:
        marks = spark.read.text(path).filter("value <> ''").select(text_hash("value").alias("line_hash")).agg(*line_marks(F.col("line_hash")))
    of_header = F.xxhash64(F.lit(header))
    lines = marks.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
                      F.coalesce(F.sum("all_sum"), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("all_sum"),
                      F.coalesce(F.bit_xor("all_xor"), F.lit(0).cast("long")).alias("all_xor"))
    # Every file repeats the header, which counts once in the identity.
    rows = F.greatest(F.col("lines") - len(files), F.lit(0))
    hash_sum = F.col("all_sum") - of_header.cast("decimal(28,0)") * len(files)
    hash_xor = F.col("all_xor").bitwiseXOR(of_header) if len(files) % 2 else F.col("all_xor")
    identity = F.concat_ws("|", F.lit(header), rows.cast("string"), hash_sum.cast("string"), hash_xor.cast("string"))
    return lines.select(
        F.lit(source).alias("source"), F.lit(path.rsplit("/", 1)[-1]).alias("filename"),
        F.lit(sum(f.size for f in files)).cast("long").alias("size_bytes"),
        F.lit(max(f.modified_ms for f in files)).cast("long").alias("modified_ms"),
        rows.alias("row_count"), F.lit(header.count("\t") + 1).alias("column_count"),
        F.sha2(identity, 256).alias("content_hash"))
