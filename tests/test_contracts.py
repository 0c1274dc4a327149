import pytest

from pelagia.contracts import (AbundanceRequest, AssociationRequest, ContractError, DiversityRequest,
                               SampleSearch, TaxaSearch)
from pelagia.operators.envelope import source_file


def test_search_normalises_its_filters():
    query = SampleSearch(ocean_region_contains="  test ocean ", polar=False,
                         depths=["表层", "surface", " Surface   Layer", "srf", "dcm"],
                         size_fractions=[" 0.8-5 ", "0.8-5"], temperature_max=21.5)
    assert query.depths == ("SRF", "DCM")
    assert query.size_fractions == ("0.8-5",)
    assert query.echo() == {"ocean_region_contains": "test ocean", "polar": "false",
                            "depths": "SRF,DCM", "size_fractions": "0.8-5",
                            "temperature_max": "21.5"}


@pytest.mark.parametrize("make", [
    lambda: SampleSearch(temperature_min=20, temperature_max=10),
    lambda: SampleSearch(depths=["abyss"]),
    lambda: SampleSearch(size_fractions=[" "]),
    lambda: SampleSearch(ocean_region_contains=" "),
    lambda: SampleSearch(ocean_region_contains="x" * 201),
    lambda: SampleSearch(limit=501),
    lambda: SampleSearch(limit=0),
    lambda: SampleSearch(offset=-1),
    lambda: SampleSearch.of({"sql": "select 1"}),
    lambda: TaxaSearch(marker="v5", taxon="x"),
    lambda: TaxaSearch(marker="v4", taxon=" "),
    lambda: TaxaSearch(marker="v4", taxon="x", match_mode="regex"),
    lambda: AbundanceRequest(marker="v4", taxon="x", sample_ids=[]),
    lambda: AbundanceRequest(marker="v4", taxon="x", sample_ids=["A", " A"]),
    lambda: AbundanceRequest(marker="v4", taxon="x", sample_ids=[str(i) for i in range(501)]),
    lambda: DiversityRequest(marker="v4", group_by="station"),
    lambda: DiversityRequest(marker="v4", taxon=""),
    lambda: AssociationRequest(marker="v4", taxon="x", environment_variable="salinity"),
    lambda: AssociationRequest(marker="v4", taxon="x", environment_variable="par", point_limit=501),
])
def test_requests_are_closed_and_bounded(make):
    with pytest.raises(ContractError):
        make()


def test_source_keys_name_their_files():
    assert source_file("context_general") == "context_general.tsv"
    assert source_file("other") == "other"
