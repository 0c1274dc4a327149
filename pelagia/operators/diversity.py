"""Alpha diversity per sample and per group of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.cluster import settle
from pelagia.contracts import CONTEXT_ID, GROUP_FIELDS, ContractError, DiversityRequest
from pelagia.functions.taxonomy import taxon_match
from pelagia.operators.abundance import _restrict, resolve_samples
from pelagia.operators.envelope import Answer, beside, filters_map, page_rows, warning, warning_rows
from pelagia.operators.ordering import page, quantiles
from pelagia.operators.taxa import matching_cells


def diversity(cells: DataFrame, metadata: DataFrame, marker_samples: DataFrame,
              context: DataFrame, taxon: str | None = None, mode: str = "level",
              requested=None) -> DataFrame:
    """Reads, observed richness and natural-log Shannon index of every selected sample.

    Shannon is taken as ln N - (sum n ln n) / N, which needs one aggregation only.
    """
    samples = resolve_samples(marker_samples, context, requested).filter("available")
    used = _restrict(cells, requested)
    if taxon is not None:
        used = matching_cells(used, metadata, taxon, mode)
    n = F.col("reads").cast("double")
    sums = used.filter("reads > 0").groupBy("sample_id").agg(
        F.sum("reads").alias("_n"), F.count(F.lit(1)).alias("_kinds"),
        F.sum(n * F.ln(n)).alias("_nlogn"))
    total = F.col("_n").cast("double")
    shannon = (F.when(F.col("_kinds") == 1, F.lit(0.0))
               .when(F.col("_n") > 0, F.greatest(F.lit(0.0), F.ln(total) - F.col("_nlogn") / total)))
    return samples.join(sums, "sample_id", "left").select(
        "sample_id", F.coalesce("_n", F.lit(0)).alias("analysis_read_count"),
        F.coalesce("_kinds", F.lit(0)).alias("observed_asv_richness"),
        shannon.alias("shannon_index"))


def with_group(observations: DataFrame, context: DataFrame, field: str) -> DataFrame:
    if field not in GROUP_FIELDS:
        raise ContractError(f"group_by must be one of {', '.join(GROUP_FIELDS)}")
    labels = context.select(F.col(CONTEXT_ID).alias("sample_id"), F.col(field).alias("group"))
    return observations.join(labels, "sample_id", "left")


def diversity_groups(observations: DataFrame, context: DataFrame, field: str) -> DataFrame:
    """Means and exact medians per group; samples without a group value are left out."""
    grouped = settle(with_group(observations, context, field).filter("group is not null"))
    means = grouped.groupBy("group").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count("shannon_index").alias("shannon_sample_count"),
        F.avg("observed_asv_richness").alias("richness_mean"),
        F.avg("shannon_index").alias("shannon_mean"))
    richness = quantiles(grouped, ["group"], "observed_asv_richness", {"richness_median": 0.5})
    shannon = quantiles(grouped, ["group"], "shannon_index", {"shannon_median": 0.5})
    return (means.join(richness, "group", "left").join(shannon, "group", "left")
            .select("group", "sample_count", "shannon_sample_count", "richness_mean",
                    "richness_median", "shannon_mean", "shannon_median"))


def diversity_counts(observations: DataFrame, metadata: DataFrame, samples: DataFrame,
                     context: DataFrame, query: DiversityRequest) -> DataFrame:
    seen = observations.agg(F.count(F.lit(1)).alias("observed"),
                            F.count_if(F.col("analysis_read_count") == 0).alias("zero_reads"))
    hit = F.lit(True) if query.taxon is None else taxon_match(query.taxon, query.match_mode)
    hits = metadata.agg(F.count_if(hit).alias("matching_asv_count"))
    absent = samples.agg(F.count_if(~F.col("available")).alias("unavailable"))
    if query.group_by is None:
        return beside(seen, hits, absent).withColumn("no_group", F.lit(0))
    lost = with_group(observations, context, query.group_by).agg(
        F.count_if(F.col("group").isNull()).alias("no_group"))
    return beside(seen, hits, absent, lost)


def diversity_answer(cells: DataFrame, metadata: DataFrame, marker_samples: DataFrame,
                     context: DataFrame, query: DiversityRequest) -> Answer:
    samples = resolve_samples(marker_samples, context, query.sample_ids)
    seen = settle(diversity(cells, metadata, marker_samples, context, query.taxon,
                            query.match_mode, query.sample_ids))
    counts = diversity_counts(seen, metadata, samples, context, query)
    counts = beside(counts, marker_samples.agg(F.count(F.lit(1)).alias("marker_samples")))
    summary = counts.select(
        F.lit(f"18s_{query.marker}").alias("source_datasets"), F.lit(query.marker).alias("marker"),
        F.col("observed").alias("sample_count"),
        (F.col("marker_samples") - F.col("observed")).alias("excluded_sample_count"),
        "matching_asv_count",
        filters_map({"taxon": query.taxon, "match_mode": query.match_mode,
                     "group_by": query.group_by, "rarefied": False}).alias("filters"))
    warnings = warning_rows(counts, [
        warning("unrarefied_diversity", F.lit(True)),
        warning("samples_missing_marker_excluded", F.col("unavailable") > 0, None,
                F.col("unavailable")),
        warning("missing_group_values_excluded", F.col("no_group") > 0, query.group_by,
                F.col("no_group")),
        warning("taxon_not_found", F.lit(query.taxon is not None)
                & (F.col("matching_asv_count") == 0)),
        warning("zero_reads_in_analysis_set", F.col("zero_reads") > 0, None, F.col("zero_reads"))])
    extra = {"warning_samples": seen.filter("analysis_read_count = 0").select(
        F.lit("zero_reads_in_analysis_set").alias("code"), "sample_id").unionByName(
        samples.filter("not available").select(
            F.lit("samples_missing_marker_excluded").alias("code"), "sample_id"))}
    extra["pages"] = page_rows(counts, ("observations", query.offset, query.limit, F.col("observed")))
    if query.group_by is not None:
        extra["groups"] = diversity_groups(seen, context, query.group_by)
    return Answer(page(seen, ["sample_id"], query.offset, query.limit), summary, warnings, extra)
