"""Contract checks, profiles and reports over context, metadata and counts.

Every check is an aggregate, so it shuffles partial results only; checks on a whole table
share one scan wherever they read the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.cluster import settle
from pelagia.contracts import (CONTEXT_ID, ContractError, EXPECTED_MARKER_ROWS, EXPECTED_MARKER_SAMPLES,
                               METADATA_COLUMNS, SAMPLE_PREFIX)
from pelagia.functions.taxonomy import path_levels
from pelagia.operators.envelope import beside, beside_by
from pelagia.operators.ordering import quantiles

# --- fixed values: formats of the stored columns -------------------------------------------
AMPLICON_FORMAT = "^[0-9a-f]{32}$"
SEQUENCE_FORMAT = "^[ACGTN]+$"
NUMBER_FORMAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?$"
COORDINATE_TOLERANCE = 1e-9
OUTLIER_REACH = 1.5
# --- end of fixed values ----------------------------------------------------------------------

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def rows_count() -> Column:
    return F.count("*")


# -- context ------------------------------------------------------------------------------------

def key_contract(frame: DataFrame, column: str, label: str) -> DataFrame:
    """Null, duplicate and wrongly prefixed ids of one key column."""
    key = F.col(column)
    per_key = frame.groupBy(key.alias("_key")).agg(rows_count().alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1)), F.lit(0))
        .alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(~F.startswith("_key", F.lit(SAMPLE_PREFIX)), F.col("_n"))),
                   F.lit(0)).alias("invalid_ids"),
    ).select(F.lit(label).alias("label"), "*")


def id_set_equality(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """How many distinct ids each side has alone."""
    sides = (left.select(F.col(left_key).alias("id"), F.lit(1).alias("side"))
             .unionByName(right.select(F.col(right_key).alias("id"), F.lit(2).alias("side"))))
    merged = sides.groupBy("id").agg(F.bit_or("side").alias("seen"))
    return merged.agg(F.count_if(F.col("seen") == 1).alias("left_only"),
                      F.count_if(F.col("seen") == 2).alias("right_only"),
                      F.count_if(F.col("seen") == 3).alias("both")).withColumn(
        "equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def parsed_date(column: str) -> Column:
    """An ISO date or date-time, or null: Spark's own cast would also take a bare year."""
    text = F.col(column)
    return F.when(text.rlike(DATE_FORMAT), text.try_cast("timestamp_ntz"))


def date_parse_errors(frame: DataFrame, column: str) -> DataFrame:
    """Texts that stop being a value when parsed as an ISO date or date-time."""
    text = F.col(column)
    return frame.agg(
        rows_count().alias("row_count"), F.count_if(text.isNull()).alias("null_texts"),
        F.count_if(parsed_date(column).isNull()).alias("null_dates"),
        F.count_if(text.isNotNull() & parsed_date(column).isNull()).alias("parse_errors"))


def require_unique(frame: DataFrame, keys: list[str], label: str) -> None:
    """Raise if a key occurs twice or is null; only the first such key comes to the driver."""
    bad = frame.groupBy(*keys).count().filter(" or ".join(["count > 1", *[f"`{k}` is null" for k in keys]])).head(1)
    if bad:
        raise ContractError(f"{label}: {bad[0].asDict()}")


def context_join(general: DataFrame, stat: DataFrame) -> DataFrame:
    """General columns with the measured columns; ids that aren't unique on either side raise first."""
    require_unique(general, [CONTEXT_ID], "general_key_errors")
    require_unique(stat, [CONTEXT_ID], "stat_key_errors")
    return general.join(stat, CONTEXT_ID)


def coordinate_fault() -> Column:
    """Out of range, or an absolute latitude that does not fit; nulls are no fault."""
    lat, lon, size = F.col("event_latitude"), F.col("event_longitude"), F.col("abs_lat")
    return (~lat.between(-90, 90) | ~lon.between(-180, 180)
            | (F.abs(size - F.abs(lat)) > COORDINATE_TOLERANCE))


def coordinate_errors(frame: DataFrame) -> DataFrame:
    return frame.agg(rows_count().alias("row_count"),
                     F.count_if(coordinate_fault()).alias("coordinate_errors"))


def missing_values(frame: DataFrame) -> DataFrame:
    """Columns that have nulls, with their number; one scan."""
    counts = frame.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count"))
                      for c in frame.columns])
    return counts.select(F.inline(pairs)).filter("null_count > 0")


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def numeric_profile(frame: DataFrame) -> DataFrame:
    """Range, nulls, non-finite values and quartile-fence outliers of every numeric column.

    Values are first counted per (column, value), which bounds the later exact quartiles by
    the number of distinct values and keeps a dominant value from piling up.
    """
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, NUMERIC)]
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"),
                               F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    counts = settle(frame.select(F.inline(pairs)).groupBy("column_name", "value")
                    .agg(rows_count().alias("n")))
    fences = _weighted_quartiles(counts)
    joined = counts.join(F.broadcast(fences), "column_name", "left")
    value, gap = F.col("value"), F.col("q3") - F.col("q1")
    outside = (value < F.col("q1") - OUTLIER_REACH * gap) | (value > F.col("q3") + OUTLIER_REACH * gap)
    real = F.when(~F.isnan(value), value)
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return joined.groupBy("column_name").agg(
        F.min(real).alias("min_value"), F.max(real).alias("max_value"),
        total(value.isNull()).alias("null_count"),
        total(value.isNotNull() & ~_finite(value)).alias("non_finite_count"),
        total(outside).alias("iqr_outlier_count"))


def _weighted_quartiles(counts: DataFrame) -> DataFrame:
    """One row per column name, so the result is bounded by the schema width."""
    return quantiles(counts, ["column_name"], "value", {"q1": 0.25, "q3": 0.75}, weight="n")


def duplicate_rows(frame: DataFrame, label: str) -> DataFrame:
    """Rows beyond the first of each equal row; nulls count as equal."""
    groups = frame.groupBy(*[F.col(f"`{c}`") for c in frame.columns]).agg(rows_count().alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
                      ).select(F.lit(label).alias("label"), "*")


def categorical_domain(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of label columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                      for c in columns])
    return (frame.select(F.inline(pairs)).filter("value is not null").distinct()
            .orderBy("column_name", "value"))


def _per_id(frame: DataFrame, prefix: str, *faults: Column) -> DataFrame:
    """Rows, repeated rows and given faults per sample id, from one scan.

    Equal rows are merged first, so an id with very many copies is small when its rows meet.
    """
    equal = frame.groupBy(*[F.col(f"`{c}`") for c in frame.columns]).agg(rows_count().alias("_n"))
    return equal.groupBy(F.col(CONTEXT_ID).alias(f"{prefix}_id")).agg(
        F.sum("_n").alias(f"{prefix}_rows"), F.sum(F.col("_n") - 1).alias(f"{prefix}_copies"), *faults)


def _key_errors(prefix: str) -> Column:
    """Rows with a null or foreign id, and rows beyond the first of an id."""
    key, n = F.col(f"{prefix}_id"), F.col(f"{prefix}_rows")
    foreign = F.when(F.startswith(key, F.lit(SAMPLE_PREFIX)), F.lit(0)).otherwise(n)
    return F.coalesce(F.sum(F.when(key.isNull(), n).otherwise(n - 1 + foreign)), F.lit(0))


def context_report(general: DataFrame, stat: DataFrame) -> DataFrame:
    """One row of counters over both context sources; every error counter must be zero."""
    context = settle(general.join(stat, CONTEXT_ID))  # repeated ids are counted below, so they don't raise here
    text = F.col("event_date")
    lost_date = text.isNotNull() & parsed_date("event_date").isNull()
    sides = _per_id(general, "general", F.sum(F.when(lost_date, F.col("_n")).otherwise(0)).alias("_dates")) \
        .join(_per_id(stat, "stat"), F.col("general_id").eqNullSafe(F.col("stat_id")), "full")
    only_one = F.col("general_rows").isNull() | F.col("stat_rows").isNull()
    nulls = F.lit(0).cast("long")
    for c in context.columns:
        nulls = nulls + F.col(f"`{c}`").isNull().cast("long")
    zero = F.lit(0)
    return beside(
        context.agg(rows_count().alias("row_count"),
                    F.count_if(coordinate_fault()).alias("coordinate_errors"),
                    F.count_distinct("depth").alias("depth_values"),
                    F.count_distinct("polar").alias("polar_values"),
                    F.coalesce(F.sum(nulls), zero).alias("missing_values")),
        sides.agg(_key_errors("general").alias("general_key_errors"),
                  _key_errors("stat").alias("stat_key_errors"),
                  F.count_if(only_one).alias("unmatched_ids"),
                  F.coalesce(F.sum("_dates"), zero).alias("parse_errors"),
                  F.coalesce(F.sum("general_copies"), zero).alias("general_duplicates"),
                  F.coalesce(F.sum("stat_copies"), zero).alias("stat_duplicates")),
        numeric_profile(context).agg(F.sum("non_finite_count").alias("non_finite_values"),
                                     F.sum("iqr_outlier_count").alias("outlier_values")),
    ).withColumn("column_count", F.lit(len(context.columns)))


CONTEXT_ERRORS = ("general_key_errors", "stat_key_errors", "unmatched_ids", "parse_errors",
                  "coordinate_errors", "non_finite_values")


# -- metadata -----------------------------------------------------------------------------------

def level_mismatch() -> Column:
    return F.size(path_levels("taxonomy")) != F.size(path_levels("confidence"))


def blank_level() -> Column:
    return F.exists(path_levels("taxonomy"), lambda level: F.trim(level) == F.lit(""))


def level_counters() -> list[Column]:
    return [F.count_if(level_mismatch()).alias("level_mismatches"),
            F.count_if(blank_level()).alias("empty_levels")]


def taxonomy_level_checks(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("marker").agg(rows_count().alias("row_count"), *level_counters())


def level_histogram(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("marker", F.size(path_levels("taxonomy")).alias("levels")).agg(
        rows_count().alias("variant_count"))


def _number(text: Column) -> Column:
    """A number, or null: Spark's own cast would also take ``' 5 '`` and ``'5d'``."""
    return F.when(text.rlike(NUMBER_FORMAT), text.try_cast("double"))


def confidence_counters() -> list[Column]:
    """The levels of one row are reduced inside the row, so nothing is exploded."""
    values = F.transform(path_levels("confidence"), _number)
    faulty = F.filter(values, lambda v: v.isNull() | (v < 0) | (v > 100))
    one = F.lit(1)
    return [F.sum(F.coalesce(F.array_size(values), one)).alias("value_count"),
            F.sum(F.coalesce(F.array_size(faulty), one)).alias("invalid_values"),
            F.min(F.array_min(values)).alias("lowest"), F.max(F.array_max(values)).alias("highest")]


def confidence_checks(metadata: DataFrame) -> DataFrame:
    """Values that are no number within 0..100, and the range of those that are numbers."""
    return metadata.groupBy("marker").agg(*confidence_counters())


def pattern_counters() -> list[Column]:
    return [F.count_if(~F.col("amplicon").rlike(AMPLICON_FORMAT)).alias("invalid_amplicons"),
            F.count_if(~F.col("sequence").rlike(SEQUENCE_FORMAT)).alias("invalid_sequences")]


def pattern_checks(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("marker").agg(*pattern_counters())


def _per_variant(metadata: DataFrame) -> DataFrame:
    """Counters of one (marker, amplicon); more than one row only where keys repeat."""
    nulls = F.lit(0)
    for c in METADATA_COLUMNS:
        nulls = nulls + F.col(c).isNull().cast("int")
    return metadata.groupBy("marker", "amplicon").agg(
        rows_count().alias("_rows"), *level_counters(), *confidence_counters(),
        *pattern_counters(), F.sum(nulls).alias("metadata_missing_values"),
        F.min("total").alias("min_total"), F.max("total").alias("max_total"),
        F.min("spread").alias("min_spread"), F.max("spread").alias("max_spread"),
        F.sum("spread").alias("positive_cells"))


LOWEST, HIGHEST = ("lowest", "min_total", "min_spread"), ("highest", "max_total", "max_spread")


def _per_marker(variants: DataFrame, *also: Column) -> DataFrame:
    summed = ("level_mismatches", "empty_levels", "value_count", "invalid_values",
              "invalid_amplicons", "invalid_sequences", "metadata_missing_values", "positive_cells")
    repeated = F.when(F.col("amplicon").isNotNull(), F.col("_rows") - 1).otherwise(F.col("_rows"))
    return variants.groupBy("marker").agg(
        F.sum("_rows").alias("row_count"), F.sum(repeated).alias("duplicate_amplicons"),
        *[F.sum(c).alias(c) for c in summed], *[F.min(c).alias(c) for c in LOWEST],
        *[F.max(c).alias(c) for c in HIGHEST], *also)


def metadata_report(metadata: DataFrame) -> DataFrame:
    """All counters and ranges that need the metadata alone, in one scan and one shuffle."""
    return _per_marker(_per_variant(metadata))


def recomputed_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("marker", "amplicon").agg(
        F.sum("reads").alias("found_total"), F.count_if(F.col("reads") > 0).alias("found_spread"),
        F.max("reads").alias("found_max"))


def reconcile_totals(metadata: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored total and spread against the counts, and keys that only one side has."""
    stored = metadata.select("marker", "amplicon", "total", "spread", F.lit(True).alias("_stored"))
    both = stored.join(recomputed_totals(cells), ["marker", "amplicon"], "full")
    zero = F.lit(0)
    return both.groupBy("marker").agg(
        F.count_if(F.col("_stored")).alias("row_count"),
        F.count_if(F.col("_stored") & (F.col("total") != F.coalesce("found_total", zero)))
        .alias("total_mismatches"),
        F.count_if(F.col("_stored") & (F.col("spread") != F.coalesce("found_spread", zero)))
        .alias("spread_mismatches"),
        F.count_if(F.col("_stored").isNull()).alias("unknown_amplicons"),
        F.coalesce(F.max("found_max"), zero).alias("max_read_count"))


def marker_report(metadata: DataFrame, cells: DataFrame, marker_samples: DataFrame) -> DataFrame:
    """One row per marker with the error counters and the shape of the matrix.

    Metadata counters and recomputed totals meet on the key that both are grouped by, so each
    table is read and shuffled once.
    """
    both = _per_variant(metadata).join(recomputed_totals(cells), ["marker", "amplicon"], "full")
    zero, stored = F.lit(0), F.col("_rows").isNotNull()
    checked = _per_marker(
        both,
        F.count_if(stored & (F.col("min_total") != F.coalesce("found_total", zero)))
        .alias("total_mismatches"),
        F.count_if(stored & (F.col("min_spread") != F.coalesce("found_spread", zero)))
        .alias("spread_mismatches"),
        F.count_if(~stored).alias("unknown_amplicons"),
        F.coalesce(F.max("found_max"), zero).alias("max_read_count"))
    width = marker_samples.groupBy("marker").agg(rows_count().alias("sample_count"))
    report = beside_by("marker", checked, width)
    total_cells = F.col("row_count") * F.col("sample_count")
    return (report.withColumn("total_cells", total_cells)
            .withColumn("nonzero_fraction", F.bround(F.col("positive_cells") / total_cells, 8)))


METADATA_ERRORS = ("duplicate_amplicons", "metadata_missing_values", "level_mismatches",
                   "empty_levels", "invalid_values", "invalid_amplicons", "invalid_sequences")
MARKER_ERRORS = (*METADATA_ERRORS, "total_mismatches", "spread_mismatches", "unknown_amplicons")


def shape_expectations(report: DataFrame, rows: dict[str, int] | None = None,
                       samples: dict[str, int] | None = None) -> DataFrame:
    """Row and sample counts per marker against the expected ones."""
    rows, samples = rows or EXPECTED_MARKER_ROWS, samples or EXPECTED_MARKER_SAMPLES
    expected = report.sparkSession.createDataFrame(
        [(m, rows[m], samples[m]) for m in rows],
        "marker string, expected_rows long, expected_samples long")
    found = report.select("marker", "row_count", "sample_count")
    return found.join(F.broadcast(expected), "marker").withColumn(
        "as_expected", (F.col("row_count") == F.col("expected_rows"))
        & (F.col("sample_count") == F.col("expected_samples")))


# -- coverage -----------------------------------------------------------------------------------

def sample_presence(context: DataFrame, marker_samples: DataFrame) -> DataFrame:
    """One row per sample id with flags for context, v4 and v9."""
    ids = context.select(F.col(CONTEXT_ID).alias("sample_id"), F.lit(1).alias("_where")).unionByName(
        marker_samples.select("sample_id", F.when(F.col("marker") == "v4", 2).otherwise(4)
                              .alias("_where")))
    seen = ids.groupBy("sample_id").agg(F.bit_or("_where").alias("_seen"))
    has = lambda bit: F.col("_seen").bitwiseAND(F.lit(bit)) != 0
    return seen.select("sample_id", has(1).alias("in_context"), has(2).alias("in_v4"),
                       has(4).alias("in_v9"))


def coverage(context: DataFrame, marker_samples: DataFrame) -> DataFrame:
    """Set sizes over sample ids; ids without context are an error."""
    c, v4, v9 = F.col("in_context"), F.col("in_v4"), F.col("in_v9")
    return sample_presence(context, marker_samples).agg(
        F.count_if(c).alias("context_samples"), F.count_if(v4).alias("v4_samples"),
        F.count_if(v9).alias("v9_samples"), F.count_if(v4 & v9).alias("shared_marker_samples"),
        F.count_if(v4 & ~v9).alias("v4_only_samples"),
        F.count_if(v9 & ~v4).alias("v9_only_samples"),
        F.count_if(c & ~v4 & ~v9).alias("context_without_marker_samples"),
        F.count_if(~c).alias("marker_samples_missing_context"))


def coverage_ids(context: DataFrame, marker_samples: DataFrame) -> DataFrame:
    """The ids behind the coverage numbers, one row per id that is not shared by both markers."""
    c, v4, v9 = F.col("in_context"), F.col("in_v4"), F.col("in_v9")
    place = (F.when(~c, "missing_context").when(v4 & ~v9, "v4_only").when(v9 & ~v4, "v9_only")
             .when(~v4 & ~v9, "without_marker"))
    return sample_presence(context, marker_samples).select(
        place.alias("coverage"), "sample_id").filter("coverage is not null")
