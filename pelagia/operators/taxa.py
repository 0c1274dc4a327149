"""Search for sequence variants and the samples they occur in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.cluster import fits_broadcast
from pelagia.contracts import METADATA_COLUMNS, TaxaSearch
from pelagia.functions.taxonomy import taxon_match
from pelagia.operators.envelope import Answer, beside, filters_map, page_rows, warning, warning_rows
from pelagia.operators.ordering import page

HEAVY_SHARE = 1000


def matching_variants(metadata: DataFrame, taxon: str, mode: str = "level") -> DataFrame:
    return metadata.filter(taxon_match(taxon, mode)).select(*METADATA_COLUMNS)


def matching_cells(cells: DataFrame, metadata: DataFrame, taxon: str,
                   mode: str = "level", broadcast_rows: int | None = None) -> DataFrame:
    """Counts of the variants that match; both frames hold one marker.

    The matching ids are broadcast when a count shows that they fit.  Otherwise the frequent
    variants (known from their stored spread) are decided by a broadcast of at most
    ``HEAVY_SHARE`` rows, and only the remaining cells are shuffled.
    """
    hits = metadata.filter(taxon_match(taxon, mode)).select("amplicon")
    small = fits_broadcast(hits) if broadcast_rows is None else fits_broadcast(hits, broadcast_rows)
    if small:
        return cells.join(F.broadcast(hits), "amplicon", "left_semi")
    limit = max((metadata.agg(F.sum("spread")).first()[0] or 0) // HEAVY_SHARE, 1)
    heavy = metadata.filter(F.col("spread") > limit)
    heavy_ids = F.broadcast(heavy.select("amplicon"))
    heavy_hits = F.broadcast(heavy.filter(taxon_match(taxon, mode)).select("amplicon"))
    light = metadata.filter(F.coalesce(F.col("spread"), F.lit(0)) <= limit)
    light_hits = light.filter(taxon_match(taxon, mode)).select("amplicon")
    return (cells.join(heavy_hits, "amplicon", "left_semi")
            .unionByName(cells.join(heavy_ids, "amplicon", "left_anti")
                         .join(light_hits, "amplicon", "left_semi")))


def occurrences(matched: DataFrame) -> DataFrame:
    """Reads per sample over the matched cells; samples without reads do not appear."""
    return (matched.groupBy("sample_id").agg(F.sum("reads").alias("read_count"))
            .filter("read_count > 0"))


def find_taxa(metadata: DataFrame, cells: DataFrame, marker_samples: DataFrame,
              query: TaxaSearch) -> Answer:
    """Two independently paged lists for one marker: variants, and samples by reads."""
    variants = matching_variants(metadata, query.taxon, query.match_mode)
    found = occurrences(matching_cells(cells, metadata, query.taxon, query.match_mode))
    asvs = page(variants, [F.desc("total"), "amplicon"], query.asv_offset, query.asv_limit)
    samples = page(found, [F.desc("read_count"), "sample_id"],
                   query.sample_offset, query.sample_limit)
    totals = beside(variants.agg(F.count(F.lit(1)).alias("asv_total")),
                    found.agg(F.count(F.lit(1)).alias("sample_count")),
                    marker_samples.agg(F.count(F.lit(1)).alias("marker_samples")))
    summary = totals.select(
        F.lit(f"18s_{query.marker}").alias("source_datasets"), F.lit(query.marker).alias("marker"),
        "asv_total", "sample_count",
        (F.col("marker_samples") - F.col("sample_count")).alias("excluded_sample_count"),
        filters_map({"taxon": query.taxon, "match_mode": query.match_mode}).alias("filters"))
    warnings = warning_rows(totals, [warning("read_count_is_not_cell_abundance", F.lit(True))])
    pages = page_rows(totals, ("asvs", query.asv_offset, query.asv_limit, F.col("asv_total")),
                      ("samples", query.sample_offset, query.sample_limit, F.col("sample_count")))
    return Answer(asvs, summary, warnings, {"samples": samples, "pages": pages})
