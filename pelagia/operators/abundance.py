"""Relative abundance of a taxon per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.cluster import fits_broadcast
from pelagia.contracts import CONTEXT_ID, AbundanceRequest, id_frame
from pelagia.functions.taxonomy import taxon_match
from pelagia.operators.envelope import Answer, beside, filters_map, page_rows, warning, warning_rows
from pelagia.operators.ordering import page
from pelagia.operators.taxa import matching_cells
from pelagia.sources.store import check_ids, of_samples


def resolve_samples(marker_samples: DataFrame, context: DataFrame, requested=None) -> DataFrame:
    """Samples to analyse, with ``available`` telling whether the marker has them.

    Without a request these are all samples of the marker.  Requested ids must exist in the
    context table; those that the marker lacks are kept with ``available`` false.
    """
    own = marker_samples.select("sample_id")
    if requested is None:
        return own.withColumn("available", F.lit(True))
    wanted = id_frame(marker_samples.sparkSession, requested)
    check_ids(wanted, context.select(CONTEXT_ID))
    flagged = own.select(F.col("sample_id").alias("_own"))
    return (wanted.join(flagged, F.col("sample_id") == F.col("_own"), "left")
            .select("sample_id", F.col("_own").isNotNull().alias("available")))


def _restrict(cells: DataFrame, requested) -> DataFrame:
    """Keep the requested samples' cells; a list of ids is pushed down to the scan."""
    if requested is None:
        return cells
    if isinstance(requested, DataFrame):
        return of_samples(cells, requested)
    return cells.filter(F.col("sample_id").isin(list(requested)))


def sample_reads(cells: DataFrame, metadata: DataFrame, taxon: str, mode: str,
                 broadcast_rows: int | None = None) -> DataFrame:
    """Per sample: reads of the taxon and of the whole library.

    One scan when the matching ids can be broadcast; otherwise the library totals, which need
    no join, are aggregated apart from the matching cells.
    """
    hits = metadata.filter(taxon_match(taxon, mode)).select("amplicon")
    small = fits_broadcast(hits) if broadcast_rows is None else fits_broadcast(hits, broadcast_rows)
    library = F.sum("reads").alias("library")
    if small:
        marked = cells.join(F.broadcast(hits.withColumn("_hit", F.lit(True))), "amplicon", "left")
        return marked.groupBy("sample_id").agg(
            F.sum(F.when(F.col("_hit"), F.col("reads"))).alias("taxon_reads"), library)
    matched = matching_cells(cells, metadata, taxon, mode, broadcast_rows)
    taxon_reads = matched.groupBy("sample_id").agg(F.sum("reads").alias("taxon_reads"))
    return cells.groupBy("sample_id").agg(library).join(taxon_reads, "sample_id", "left")


def taxon_abundance(cells: DataFrame, metadata: DataFrame, marker_samples: DataFrame,
                    context: DataFrame, taxon: str, mode: str = "level",
                    requested=None) -> DataFrame:
    """Taxon reads, library reads and their ratio for every selected sample of one marker.

    Samples without cells stay with zeros; an empty library has a null ratio.
    """
    samples = resolve_samples(marker_samples, context, requested).filter("available")
    reads = sample_reads(_restrict(cells, requested), metadata, taxon, mode)
    library = F.coalesce(F.col("library"), F.lit(0))
    hits = F.coalesce(F.col("taxon_reads"), F.lit(0))
    return samples.join(reads, "sample_id", "left").select(
        "sample_id", hits.alias("taxon_read_count"), library.alias("sample_total_read_count"),
        F.when(library > 0, hits / library).alias("relative_abundance"))


def abundance_counts(observations: DataFrame, metadata: DataFrame, samples: DataFrame,
                     taxon: str, mode: str) -> DataFrame:
    """The one-row counts behind summary and warnings."""
    seen = observations.agg(
        F.count(F.lit(1)).alias("observed"),
        F.count_if(F.col("taxon_read_count") > 0).alias("with_taxon"),
        F.count_if(F.col("sample_total_read_count") == 0).alias("zero_libraries"))
    hits = metadata.agg(F.count_if(taxon_match(taxon, mode)).alias("matching_asv_count"))
    absent = samples.agg(F.count_if(~F.col("available")).alias("unavailable"))
    return beside(seen, hits, absent)


def abundance_warning_list() -> list:
    return [
        warning("read_count_is_not_cell_abundance", F.lit(True)),
        warning("taxon_not_found", F.col("matching_asv_count") == 0),
        warning("samples_missing_marker_excluded", F.col("unavailable") > 0, None,
                F.col("unavailable")),
        warning("zero_read_library", F.col("zero_libraries") > 0, None, F.col("zero_libraries")),
    ]


def abundance_answer(cells: DataFrame, metadata: DataFrame, marker_samples: DataFrame,
                     context: DataFrame, query: AbundanceRequest) -> Answer:
    samples = resolve_samples(marker_samples, context, query.sample_ids)
    everything = taxon_abundance(cells, metadata, marker_samples, context, query.taxon,
                                 query.match_mode, query.sample_ids)
    shown = everything if query.include_zero_samples else everything.filter("taxon_read_count > 0")
    counts = abundance_counts(everything, metadata, samples, query.taxon, query.match_mode)
    counts = beside(counts, marker_samples.agg(F.count(F.lit(1)).alias("marker_samples")))
    total = F.col("observed") if query.include_zero_samples else F.col("with_taxon")
    summary = counts.select(
        F.lit(f"18s_{query.marker}").alias("source_datasets"), F.lit(query.marker).alias("marker"),
        total.alias("sample_count"),
        (F.col("marker_samples") - total).alias("excluded_sample_count"), "matching_asv_count",
        filters_map({"taxon": query.taxon, "match_mode": query.match_mode,
                     "include_zero_samples": query.include_zero_samples}).alias("filters"))
    # The ids behind a warning stay rows: their number grows with the samples.
    affected = everything.filter("sample_total_read_count = 0").select(
        F.lit("zero_read_library").alias("code"), "sample_id").unionByName(
        samples.filter("not available").select(
            F.lit("samples_missing_marker_excluded").alias("code"), "sample_id"))
    return Answer(page(shown, ["sample_id"], query.offset, query.limit), summary,
                  warning_rows(counts, abundance_warning_list()),
                  {"warning_samples": affected, "pages": page_rows(counts, ("observations", query.offset, query.limit, total))})
