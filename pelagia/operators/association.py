"""Rank correlation between a taxon's relative abundance and an environment variable."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.cluster import settle
from pelagia.contracts import CONTEXT_ID, AssociationRequest
from pelagia.functions.stats import correlation_p
from pelagia.operators.abundance import (abundance_counts, abundance_warning_list, resolve_samples,
                                         taxon_abundance)
from pelagia.operators.envelope import Answer, beside, filters_map, page_rows, warning, warning_rows
from pelagia.operators.ordering import HOT_ROWS, attach_by_value, average_ranks, page, window_rank

MIN_SAMPLES = 3
CAUTION_UP_TO = 500


def with_environment(observations: DataFrame, context: DataFrame, variable: str) -> DataFrame:
    values = context.select(F.col(CONTEXT_ID).alias("sample_id"),
                            F.col(variable).cast("double").alias("environment_value"))
    return observations.join(values, "sample_id", "left")


def association_points(observations: DataFrame, context: DataFrame, variable: str) -> DataFrame:
    """Complete pairs only: the environment value and the ratio must both exist."""
    return with_environment(observations, context, variable).filter(
        "environment_value is not null and relative_abundance is not null").select(
        "sample_id", "environment_value", "relative_abundance")


def _ranked(kept: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """Points with their ranks ``_rx`` and ``_ry``.

    Above ``hot_rows`` points each side is ranked over its distinct values with their counts,
    so that neither a common value nor the whole set passes through one task.
    """
    if n <= hot_rows:
        return kept.withColumns({"_rx": window_rank("_x"), "_ry": window_rank("_y")})
    left = settle(average_ranks(kept, "_x", "_rx", hot_rows).withColumnRenamed("_ties", "_tx"))
    right = settle(average_ranks(kept, "_y", "_ry", hot_rows).withColumnRenamed("_ties", "_ty"))
    return attach_by_value(attach_by_value(kept, left, "_x", "_tx"), right, "_y", "_ty")


def spearman(points: DataFrame, x: str, y: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: complete pairs, whether each side varies, rho and its p-value.

    The points are checkpointed, because ranks and pairs must come from the same rows.
    """
    kept = settle(points.select(F.col(x).cast("double").alias("_x"),
                                F.col(y).cast("double").alias("_y")))
    n = kept.count()
    # Ranks have mean (n + 1) / 2; centring first keeps the sums of products exact.
    middle = F.lit((n + 1) / 2.0)
    dx, dy = F.col("_rx") - middle, F.col("_ry") - middle
    sums = _ranked(kept, n, hot_rows).agg(
        F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"),
        (F.min("_rx") < F.max("_rx")).alias("varied_x"), (F.min("_ry") < F.max("_ry")).alias("varied_y"))
    # Five numbers decide the test; the rest is arithmetic on one row.
    row = sums.first()
    varied_x, varied_y = bool(row.varied_x), bool(row.varied_y)
    rho = None
    if n >= MIN_SAMPLES and varied_x and varied_y:
        rho = max(-1.0, min(1.0, row["_xy"] / math.sqrt(row["_xx"] * row["_yy"])))
    return points.sparkSession.createDataFrame(
        [(n, varied_x, varied_y, rho, correlation_p(rho, n))],
        "sample_count long, varied_x boolean, varied_y boolean, rho double, p_value double")


def association_answer(cells: DataFrame, metadata: DataFrame, marker_samples: DataFrame,
                       context: DataFrame, query: AssociationRequest) -> Answer:
    samples = resolve_samples(marker_samples, context, query.sample_ids)
    seen = settle(taxon_abundance(cells, metadata, marker_samples, context, query.taxon,
                                  query.match_mode, query.sample_ids))
    points = association_points(seen, context, query.environment_variable)
    test = spearman(points, "environment_value", "relative_abundance")
    lost = with_environment(seen, context, query.environment_variable).agg(
        F.count_if(F.col("environment_value").isNull()).alias("missing"))
    counts = beside(abundance_counts(seen, metadata, samples, query.taxon, query.match_mode),
                    lost, test, marker_samples.agg(F.count(F.lit(1)).alias("marker_samples")))
    summary = counts.select(
        F.lit(f"18s_{query.marker},context_general,context_stat").alias("source_datasets"),
        F.lit(query.marker).alias("marker"),
        F.lit(query.environment_variable).alias("environment_variable"), "sample_count",
        (F.col("marker_samples") - F.col("sample_count")).alias("excluded_sample_count"),
        "matching_asv_count", "rho", "p_value",
        filters_map({"taxon": query.taxon, "match_mode": query.match_mode,
                     "environment_variable": query.environment_variable,
                     "missing_values": "pairwise_complete",
                     "multiple_testing_correction": "not_applied_single_test"}).alias("filters"))
    few = F.col("sample_count") < MIN_SAMPLES
    constant = ~few & ~(F.col("varied_x") & F.col("varied_y"))
    undefined = ~few & ~constant & (F.col("rho").isNull() | F.isnan("rho"))
    warnings = warning_rows(counts, [
        *abundance_warning_list(),
        warning("missing_environment_values_excluded", F.col("missing") > 0,
                query.environment_variable, F.col("missing")),
        warning("insufficient_samples", few, None, F.col("sample_count")),
        warning("constant_input", constant),
        warning("undefined_correlation", undefined),
        warning("asymptotic_p_value_caution", ~few & ~constant & ~undefined
                & (F.col("sample_count") <= CAUTION_UP_TO), None, F.col("sample_count"))])
    pages = page_rows(counts, ("points", query.point_offset, query.point_limit, F.col("sample_count")))
    return Answer(page(points, ["sample_id"], query.point_offset, query.point_limit),
                  summary, warnings, {"pages": pages})
