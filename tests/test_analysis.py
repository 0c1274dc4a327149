import math

import pytest
from pyspark.sql import functions as F

from pelagia.contracts import ContractError, NotFound, SampleSearch
from pelagia.operators.abundance import sample_reads, taxon_abundance
from pelagia.operators.association import spearman
from pelagia.operators.charts import abundance_bars, diversity_bars
from pelagia.operators.diversity import diversity
from pelagia.operators.samples import find_samples
from pelagia.operators.taxa import matching_cells
from pelagia.plans.analysis import Analysis


@pytest.fixture(scope="module")
def analysis(store):
    return Analysis(store)


def codes(answer):
    return {r.code for r in answer.warnings.collect()}


def test_find_samples_combines_filters(analysis):
    answer = analysis.find_samples(ocean_region_contains="test ocean", polar=False,
                                   depths=["表层", "surface"], size_fractions=["0.8-5"],
                                   temperature_max=21.5, limit=10)
    assert [r.sample_id_pangaea for r in answer.items.collect()] == ["TARA_TEST_001"]
    summary = answer.summary.first()
    assert (summary.sample_count, summary.excluded_sample_count) == (1, 1)
    assert summary.filters["depths"] == "SRF"
    assert answer.warnings.count() == 0


def test_missing_temperature_is_counted_after_the_other_filters(store):
    context = store.context().withColumn("temperature", F.lit(None).cast("double")).withColumn(
        "ocean_region", F.when(F.col("sample_id_pangaea") == "TARA_TEST_001", "Target Ocean")
        .otherwise("Other Ocean"))
    answer = find_samples(context, SampleSearch(ocean_region_contains="target", temperature_min=20))
    assert answer.summary.first().sample_count == 0
    row = answer.warnings.first()
    assert (row.code, row.field, row.sample_count, row.candidate_sample_count) == (
        "missing_filter_values_excluded", "temperature", 1, 1)


def test_sample_info(analysis):
    row = analysis.get_sample_info(" TARA_TEST_002 ").items.first()
    assert (row.temperature, row.depth_bathy, len(row)) == (22.0, -200, 39)
    with pytest.raises(NotFound):
        analysis.get_sample_info("TARA_UNKNOWN")
    with pytest.raises(ContractError):
        analysis.get_sample_info("  ")


def test_find_taxa_matches_a_level_and_ranks_samples(analysis):
    answer = analysis.find_taxa(marker="v4", taxon="dinoflagellata")
    assert [r.taxonomy for r in answer.items.collect()] == ["Root;Eukaryota;Dinoflagellata"]
    assert [(r.sample_id, r.read_count) for r in answer.extra["samples"].collect()] == [
        ("TARA_TEST_002", 2), ("TARA_TEST_001", 1)]
    assert codes(answer) == {"read_count_is_not_cell_abundance"}


def test_level_and_substring_are_different_modes(analysis):
    level = analysis.find_taxa(marker="v9", taxon="flagellata").summary.first()
    assert (level.asv_total, level.excluded_sample_count) == (0, 2)
    part = analysis.find_taxa(marker="v9", taxon="flagellata", match_mode="contains").summary.first()
    assert part.asv_total == 1


def test_pages_past_the_end_are_empty_and_independent(analysis):
    answer = analysis.find_taxa(marker="v4", taxon="Root", asv_offset=2, asv_limit=1,
                                sample_offset=1, sample_limit=1)
    assert answer.summary.first().asv_total == 2
    assert answer.items.collect() == []
    assert [r.sample_id for r in answer.extra["samples"].collect()] == ["TARA_TEST_002"]


def test_abundance_is_relative_to_the_library(analysis):
    answer = analysis.taxon_abundance(marker="v4", taxon="Dinoflagellata")
    rows = answer.items.collect()
    assert [(r.sample_id, r.taxon_read_count, r.sample_total_read_count, r.relative_abundance)
            for r in rows] == [("TARA_TEST_001", 1, 2, 0.5), ("TARA_TEST_002", 2, 2, 1.0)]
    assert answer.summary.first().matching_asv_count == 1


def test_unknown_taxon_keeps_zero_samples(analysis):
    answer = analysis.taxon_abundance(marker="v9", taxon="NotATaxon")
    rows = answer.items.collect()
    assert [(r.taxon_read_count, r.relative_abundance) for r in rows] == [(0, 0.0), (0, 0.0)]
    assert "taxon_not_found" in codes(answer)
    dropped = analysis.taxon_abundance(marker="v9", taxon="NotATaxon", include_zero_samples=False)
    assert dropped.summary.first().excluded_sample_count == 2
    assert dropped.items.count() == 0


def test_requested_samples_without_the_marker_are_reported(store, analysis):
    class Partial:
        context, cells, metadata = store.context, store.cells, store.metadata

        def marker_samples(self, marker):
            return store.marker_samples(marker).filter("sample_id = 'TARA_TEST_001'")

    answer = Analysis(Partial()).taxon_abundance(
        marker="v4", taxon="Dinoflagellata", sample_ids=["TARA_TEST_002", "TARA_TEST_001"])
    assert [r.sample_id for r in answer.items.collect()] == ["TARA_TEST_001"]
    rows = {r.code: r.sample_count for r in answer.warnings.collect()}
    assert rows["samples_missing_marker_excluded"] == 1
    assert [tuple(r) for r in answer.extra["warning_samples"].collect()] == [
        ("samples_missing_marker_excluded", "TARA_TEST_002")]
    with pytest.raises(ContractError, match="Unknown sample IDs"):
        analysis.diversity_analysis(marker="v4", sample_ids=["TARA_UNKNOWN"])


def test_diversity_and_groups(analysis):
    answer = analysis.diversity_analysis(marker="v4", group_by="polar")
    first, second = answer.items.collect()
    assert first.observed_asv_richness == 2
    assert first.shannon_index == pytest.approx(math.log(2))
    assert (second.observed_asv_richness, second.shannon_index) == (1, 0.0)
    group = answer.extra["groups"].first()
    assert (group.group, group.sample_count, group.shannon_sample_count) == ("Non polar", 2, 2)
    assert (group.richness_mean, group.richness_median) == (1.5, 1.5)
    assert codes(answer) == {"unrarefied_diversity"}


def test_diversity_of_one_taxon(analysis):
    answer = analysis.diversity_analysis(marker="v4", taxon="Dinoflagellata")
    assert {(r.observed_asv_richness, r.shannon_index) for r in answer.items.collect()} == {(1, 0.0)}
    nothing = analysis.diversity_analysis(marker="v4", taxon="NotATaxon")
    assert {(r.analysis_read_count, r.shannon_index) for r in nothing.items.collect()} == {(0, None)}
    assert {"taxon_not_found", "zero_reads_in_analysis_set"} <= codes(nothing)
    assert nothing.extra["warning_samples"].count() == 2


def test_association_needs_three_samples(analysis):
    answer = analysis.environment_association(marker="v4", taxon="Dinoflagellata",
                                              environment_variable="temperature")
    row = answer.summary.first()
    assert (row.sample_count, row.rho, row.p_value) == (2, None, None)
    assert "insufficient_samples" in codes(answer)


class Frames:
    """Tables given directly."""

    def __init__(self, spark, counts, env, taxa):
        cells = [("v4", a, s, n) for (a, s), n in counts.items() if n > 0]
        self._cells = spark.createDataFrame(cells, "marker string, amplicon string, sample_id string, reads long")
        total = {a: [n for (b, _), n in counts.items() if b == a and n > 0] for a in taxa}
        self._metadata = spark.createDataFrame(
            [("v4", a, t, "100", sum(total[a]), len(total[a]), "A") for a, t in taxa.items()],
            "marker string, amplicon string, taxonomy string, confidence string, total long, "
            "spread long, sequence string")
        self._samples = spark.createDataFrame([("v4", s, i) for i, s in enumerate(sorted(env))],
                                              "marker string, sample_id string, ordinal long")
        self._context = spark.createDataFrame([(s, v, "Polar") for s, v in env.items()],
                                              "sample_id_pangaea string, temperature double, polar string")

    def cells(self, marker=None):
        return self._cells

    def metadata(self, marker=None):
        return self._metadata

    def marker_samples(self, marker=None):
        return self._samples

    def context(self):
        return self._context


def test_association_cautions_and_constants(spark):
    env = {f"TARA_{i}": float(i) if i != 4 else None for i in range(6)}
    counts = {("a", s): i for i, s in enumerate(env)} | {("b", s): 10 for s in env if s != "TARA_5"}
    frames = Frames(spark, counts, env, {"a": "Root;X", "b": "Root;Y"})
    up = Analysis(frames).environment_association(marker="v4", taxon="x", environment_variable="temperature")
    row = up.summary.first()
    assert (row.sample_count, row.rho, row.p_value) == (5, 1.0, 0.0)
    assert {"missing_environment_values_excluded", "asymptotic_p_value_caution"} <= codes(up)
    flat = Analysis(frames).environment_association(marker="v4", taxon="none", environment_variable="temperature")
    assert flat.summary.first().rho is None
    assert {"constant_input", "taxon_not_found"} <= codes(flat)


def test_random_matrix_against_plain_formulas(spark):
    import random
    rng = random.Random(7)
    ids = [f"TARA_{i:02d}" for i in range(40)]
    env = {s: rng.choice([None, round(rng.uniform(0, 9), 1)]) for s in ids}
    taxa = {f"v{i}": f"Root;{'Hit' if i % 3 == 0 else 'Miss'};{i}" for i in range(15)}
    counts = {(a, s): rng.choice([0, 0, 1, rng.randint(2, 500)]) for a in taxa for s in ids}
    for a in taxa:
        counts[(a, ids[0])] = 0
    frames = Frames(spark, counts, env, taxa)
    parts = frames.cells(), frames.metadata(), frames.marker_samples(), frames.context()

    found = {r.sample_id: r for r in diversity(*parts).collect()}
    for s in ids:
        reads = [counts[(a, s)] for a in taxa if counts[(a, s)] > 0]
        n = sum(reads)
        assert found[s].analysis_read_count == n and found[s].observed_asv_richness == len(reads)
        if n == 0:
            assert found[s].shannon_index is None
        else:
            plain = -sum(r / n * math.log(r / n) for r in reads)
            assert found[s].shannon_index == pytest.approx(plain, abs=1e-12)
            assert 0 <= found[s].shannon_index <= math.log(len(reads)) + 1e-12

    ratio = {r.sample_id: r.relative_abundance for r in taxon_abundance(*parts, "hit").collect()}
    for s in ids:
        n = sum(counts[(a, s)] for a in taxa)
        hit = sum(counts[(a, s)] for a, t in taxa.items() if "Hit" in t)
        assert ratio[s] == (hit / n if n else None)

    row = Analysis(frames).environment_association(
        marker="v4", taxon="hit", environment_variable="temperature").summary.first()
    import pandas as pd
    pairs = pd.DataFrame([(env[s], ratio[s]) for s in ids if env[s] is not None and ratio[s] is not None])
    assert row.sample_count == len(pairs)
    want = pairs[0].rank().corr(pairs[1].rank())
    assert row.rho == pytest.approx(want, abs=1e-12)
    pairs = spark.createDataFrame(pairs.set_axis(["x", "y"], axis=1))
    small, large = (spearman(pairs, "x", "y", hot_rows=h).first() for h in (1000, 3))
    assert tuple(small) == tuple(large) and small.rho == row.rho
    assert spearman(pairs, "y", "x").first().rho == row.rho


def test_large_match_sets_take_the_same_result_without_a_broadcast(store):
    cells, metadata = store.cells("v4"), store.metadata("v4")
    wide = sorted(map(tuple, matching_cells(cells, metadata, "root").collect()))
    split = sorted(map(tuple, matching_cells(cells, metadata, "root", broadcast_rows=0)
                       .select(*matching_cells(cells, metadata, "root").columns).collect()))
    assert wide == split and len(wide) == 3
    one = sorted(map(tuple, sample_reads(cells, metadata, "other", "level").select(
        "sample_id", F.coalesce("taxon_reads", F.lit(0)), "library").collect()))
    two = sorted(map(tuple, sample_reads(cells, metadata, "other", "level", broadcast_rows=0).select(
        "sample_id", F.coalesce("taxon_reads", F.lit(0)), "library").collect()))
    assert one == two == [("TARA_TEST_001", 1, 2), ("TARA_TEST_002", 0, 2)]


def test_bars_rank_nulls_as_zero_and_drop_them(spark):
    rows = spark.createDataFrame([("a", None), ("b", 0.0), ("c", 0.5)],
                                 "sample_id string, relative_abundance double")
    assert [tuple(r) for r in abundance_bars(rows).collect()] == [("c", 0.5), ("b", 0.0)]
    first = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", None)],
                                  "sample_id string, shannon_index double")
    assert [r.x for r in diversity_bars(first).collect()] == ["a", "b"]


# -- taxon index ---------------------------------------------------------------------------------

TAXA = [("Dinoflagellata", "level"), ("DINOFLAGELLATA", "level"), ("Dino", "level"), ("", "level"), ("dino", "contains"), ("a;d", "contains"),
        ("la", "contains"), ("", "contains"), ("aaaa", "contains"), ("absent", "level"), ("absent", "contains"), ("é", "contains"), ("group 7;", "contains")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    from pelagia.sources import taxon_index
    paths = [f"Root;Eukaryota;Group {i % 40};Kind {i % 7};Line {i}" for i in range(400)]
    paths += ["Root;Dinoflagellata;X", "Root;dinoflagellata", "Dinoflagellata", " Dinoflagellata;a", None, "", "aaa;aaaaa", "Ébène;a;da", "ab"]
    rows = [(m, f"{m}{i:04d}", p, "100", i, 1, "ACGT") for m in ("v4", "v9") for i, p in enumerate(paths)]
    metadata = spark.createDataFrame(rows, "marker string, amplicon string, taxonomy string, confidence string, total long, spread long, sequence string")
    folder = str(tmp_path_factory.mktemp("index"))
    taxon_index.build(metadata, folder, 16)
    return metadata, taxon_index.TaxonIndex(spark, folder, 16)


@pytest.mark.parametrize("taxon, mode", TAXA)
def test_index_finds_what_the_predicate_finds(indexed, taxon, mode):
    from pelagia.functions.taxonomy import taxon_match
    metadata, index = indexed
    found = index.variants("v4", taxon, mode)
    wanted = metadata.filter("marker = 'v4'").filter(taxon_match(taxon, mode)).select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def files_read(frame):
    """The scans' own count of files."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in scans if m.contains("numFiles"))


def test_lookups_list_the_folders_that_they_need(indexed):
    metadata, index = indexed
    whole = files_read(index.table("variants", "v4"))
    for taxon, mode in (("Line 77", "level"), ("line 77", "contains"), ("root;dino", "contains")):
        assert 0 < files_read(index.variants("v4", taxon, mode)) <= whole / 5
    assert index.narrowed(metadata, "v4", "root", "level", most=10) is metadata
    assert index.narrowed(metadata, "v4", "Line 7", "level", most=10).count() == 1


def test_an_index_of_nothing(spark, tmp_path, indexed):
    from pelagia.sources import taxon_index
    taxon_index.build(indexed[0].limit(0), str(tmp_path / "empty"))
    index = taxon_index.TaxonIndex(spark, str(tmp_path / "empty"))
    assert index.variants("v4", "root").count() == 0 == index.variants("v4", "root", "contains").count()


def test_answers_are_the_same_with_and_without_the_index(store):
    from pelagia.plans.analysis import Analysis

    class Bare:
        def __getattr__(self, name):
            return (lambda: None) if name == "taxon_index" else getattr(store, name)

    assert store.taxon_index() is not None
    for taxon, mode in (("Dinoflagellata", "level"), ("dino", "contains"), ("absent", "level")):
        request = {"marker": "v4", "taxon": taxon, "match_mode": mode}
        for call in ("find_taxa", "taxon_abundance"):
            one, two = (getattr(Analysis(t), call)(**request) for t in (store, Bare()))
            for part in ("items", "summary", "warnings"):
                assert [str(r) for r in getattr(one, part).collect()] == [str(r) for r in getattr(two, part).collect()]


def test_matrix_counts_need_one_shuffle_of_their_own(spark):
    from pelagia.sources.binding import Binding
    b = Binding(spark, "/root/testdata/sf0.001")
    owners = b.raw("orders").selectExpr("o_orderkey", "cast(o_custkey % 3 as int) as place")
    rows = b._matrix_rows(owners)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(marker") == 1 and "place" not in "".join(line for line in plan.splitlines() if "hashpartitioning(marker" in line).split("hashpartitioning(")[1].split(")")[0]
    lines = b.raw("lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_linestatus = 'O'")
    assert rows.filter("marker = 'v4'").agg(F.sum("total")).first() == lines.agg(F.sum(F.col("l_quantity").cast("long"))).first()


def test_counts_are_added_up_once(spark):
    """The bounds of the stored ranges are sampled from added-up counts on disk, not from the join."""
    from pelagia.sources.binding import Binding
    frame, _, _ = Binding(spark, "/root/testdata/sf0.001")._build_counts()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert frame.groupBy("marker", "amplicon", "sample_id").count().filter("count > 1").isEmpty()
