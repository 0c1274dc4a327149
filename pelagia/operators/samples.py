"""Search and lookup over the sample context table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.contracts import (CONTEXT_COLUMNS, CONTEXT_ID, SAMPLE_SUMMARY, ContractError,
                               NotFound, SampleSearch)
from pelagia.operators.envelope import Answer, filters_map, warning, warning_rows
from pelagia.operators.ordering import page


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def region_contains(text: str) -> Column:
    return F.contains(F.lower("ocean_region"), F.lit(text.lower()))


def is_polar(flag: bool) -> Column:
    return F.col("polar") == F.lit("Polar" if flag else "Non polar")


def depth_in(codes) -> Column:
    return F.col("depth").isin(list(codes))


def size_in(labels) -> Column:
    return F.col("size_fraction").isin(list(labels))


def temperature_between(low: float | None, high: float | None) -> Column:
    """Closed bounds; a null temperature does not pass."""
    parts = []
    if low is not None:
        parts.append(F.col("temperature") >= F.lit(float(low)))
    if high is not None:
        parts.append(F.col("temperature") <= F.lit(float(high)))
    return _all(parts)


def context_predicate(query: SampleSearch) -> Column:
    """Every condition except the temperature bounds."""
    parts = []
    if query.ocean_region_contains is not None:
        parts.append(region_contains(query.ocean_region_contains))
    if query.polar is not None:
        parts.append(is_polar(query.polar))
    if query.depths:
        parts.append(depth_in(query.depths))
    if query.size_fractions:
        parts.append(size_in(query.size_fractions))
    return _all(parts)


def filter_samples(context: DataFrame, query: SampleSearch) -> DataFrame:
    return context.filter(context_predicate(query)).filter(
        temperature_between(query.temperature_min, query.temperature_max))


def find_samples(context: DataFrame, query: SampleSearch) -> Answer:
    """Filtered samples in id order, with totals over the whole table in one scan."""
    items = page(filter_samples(context, query).select(*SAMPLE_SUMMARY),
                 [CONTEXT_ID], query.offset, query.limit)
    near = F.coalesce(context_predicate(query), F.lit(False))
    full = near & F.coalesce(temperature_between(query.temperature_min, query.temperature_max),
                             F.lit(False))
    counts = context.agg(
        F.count(F.lit(1)).alias("all_samples"), F.count_if(full).alias("sample_count"),
        F.count_if(near).alias("candidate_sample_count"),
        F.count_if(near & F.col("temperature").isNull()).alias("missing_temperature"))
    summary = counts.select(
        F.lit("context_general,context_stat").alias("source_datasets"), "sample_count",
        (F.col("all_samples") - F.col("sample_count")).alias("excluded_sample_count"),
        F.lit(query.offset).alias("offset"), F.lit(query.limit).alias("limit"),
        filters_map(query.echo()).alias("filters"))
    bounded = query.temperature_min is not None or query.temperature_max is not None
    warnings = warning_rows(counts, [warning(
        "missing_filter_values_excluded", F.lit(bounded) & (F.col("missing_temperature") > 0),
        "temperature", F.col("missing_temperature"), F.col("candidate_sample_count"))])
    return Answer(items, summary, warnings)


def sample_info(context: DataFrame, sample_id: str) -> DataFrame:
    """All context columns of one sample; the id filter reaches the Parquet scan."""
    wanted = sample_id.strip()
    if not wanted:
        raise ContractError("sample_id must not be blank")
    return context.filter(F.col(CONTEXT_ID) == F.lit(wanted)).select(*CONTEXT_COLUMNS)


def require_sample(context: DataFrame, sample_id: str) -> DataFrame:
    found = sample_info(context, sample_id)
    if found.isEmpty():
        raise NotFound(f"Unknown sample ID: {sample_id.strip()}")
    return found
