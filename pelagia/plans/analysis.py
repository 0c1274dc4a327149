"""The six read-only calls over any provider of context, metadata, cells and marker_samples."""

from __future__ import annotations

from pelagia.contracts import (AbundanceRequest, AssociationRequest, DiversityRequest,
                               SampleSearch, TaxaSearch)
from pelagia.operators.abundance import abundance_answer
from pelagia.operators.association import association_answer
from pelagia.operators.diversity import diversity_answer
from pelagia.operators.envelope import Answer, filters_map
from pelagia.operators.samples import find_samples, require_sample
from pelagia.operators.taxa import find_taxa

from pyspark.sql import functions as F


class Analysis:
    """Validated requests in, lazy result bundles out."""

    def __init__(self, tables) -> None:
        self.tables = tables

    def _marker(self, marker: str, query=None):
        """Counts, metadata and samples; a taxon is looked up in the tables' index, where they have one."""
        t = self.tables
        metadata, index = t.metadata(marker), getattr(t, "taxon_index", lambda: None)()
        if index is not None and query is not None:
            metadata = index.narrowed(metadata, marker, query.taxon, query.match_mode)
        return t.cells(marker), metadata, t.marker_samples(marker)

    def find_samples(self, **request) -> Answer:
        return find_samples(self.tables.context(), SampleSearch.of(request))

    def get_sample_info(self, sample_id: str) -> Answer:
        found = require_sample(self.tables.context(), sample_id)
        summary = found.select(
            F.lit("context_general,context_stat").alias("source_datasets"),
            F.lit(1).cast("long").alias("sample_count"),
            F.lit(0).cast("long").alias("excluded_sample_count"),
            filters_map({"sample_id": sample_id.strip()}).alias("filters"))
        nothing = found.limit(0).selectExpr("'' as code", "'' as message")
        return Answer(found, summary, nothing)

    def find_taxa(self, **request) -> Answer:
        query = TaxaSearch.of(request)
        cells, metadata, samples = self._marker(query.marker, query)
        return find_taxa(metadata, cells, samples, query)

    def taxon_abundance(self, **request) -> Answer:
        query = AbundanceRequest.of(request)
        return abundance_answer(*self._marker(query.marker, query), self.tables.context(), query)

    def diversity_analysis(self, **request) -> Answer:
        query = DiversityRequest.of(request)
        return diversity_answer(*self._marker(query.marker), self.tables.context(), query)

    def environment_association(self, **request) -> Answer:
        query = AssociationRequest.of(request)
        return association_answer(*self._marker(query.marker), self.tables.context(), query)
