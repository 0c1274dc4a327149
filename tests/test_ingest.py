import pytest

from pelagia.contracts import GENERAL_SCHEMA, SOURCES, ContractError
from pelagia.operators.quality import context_join
from pelagia.plans.preprocess import preprocess
from pelagia.sources.catalog import header_contract, source_fingerprint
from pelagia.sources.store import Store, abundance_slice, context_by_ids, marker_data
from pelagia.sources.tsv import read_wide, scan_typed_tsv
from tests.conftest import VARIANT_A, make_source, write_lines

V4 = SOURCES["18s_v4"][0]


def states(folder):
    return {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.glob("*.tsv")}


def test_life_cycle_processed_skipped_verified(spark, source, tmp_path):
    target = tmp_path / "processed"
    before = states(source)
    first = preprocess(spark, str(source), str(target), enforce_shape=False)
    second = preprocess(spark, str(source), str(target), enforce_shape=False)
    forced = preprocess(spark, str(source), str(target), force=True, enforce_shape=False)
    assert [first.status, second.status, forced.status] == ["processed", "skipped", "verified"]
    assert states(source) == before
    assert {k: a.fingerprint for k, a in first.manifest.artifacts.items()} == \
        {k: a.fingerprint for k, a in forced.manifest.artifacts.items()}
    assert not [p for p in target.iterdir() if p.name.startswith(".build")]
    store = Store(spark, str(target))
    assert context_by_ids(store.context(), ["TARA_TEST_001"]).count() == 1
    assert dict(store.context().dtypes)["event_date"] == "timestamp_ntz"
    part = abundance_slice(store.cells("v4"), store.marker_samples("v4"), ["TARA_TEST_002"])
    assert [r.reads for r in part.collect()] == [2]
    assert marker_data(store.metadata("v4"), store.cells("v4"), "dinoflagellata").count() == 0
    assert marker_data(store.metadata("v4"), store.cells("v4"), "Dinoflagellata").count() == 2
    assert store.report("missing_values").count() == 0 and store.report("coverage_ids").count() == 0
    assert {(r.column_name, r.value) for r in store.report("categories").collect()} == {
        ("depth", "SRF"), ("polar", "Non polar")}


def test_changed_source_replaces_generation(spark, source, tmp_path):
    target = tmp_path / "processed"
    first = preprocess(spark, str(source), str(target), enforce_shape=False)
    make_source(source, samples=3)
    second = preprocess(spark, str(source), str(target), enforce_shape=False)
    assert second.status == "processed"
    assert first.manifest.generation != second.manifest.generation
    assert [p.name for p in target.glob("generation-*")] == [second.manifest.generation]


@pytest.mark.parametrize("old, new, message", [
    ("\t3\t2\t", "\t4\t2\t", "total_mismatches"),
    ("\t3\t2\t", "\t3\t1\t", "spread_mismatches"),
    ("100;99;98.5", "100;99", "level_mismatches"),
    ("100;99;98.5", "100;99; 5 ", "invalid_values"),
    ("100;99;98.5", "100;99;101", "invalid_values"),
    ("Root;Eukaryota;", "Root; ;", "empty_levels"),
    ("ACGTN", "ACGTX", "invalid_sequences"),
    (VARIANT_A, VARIANT_A.upper(), "invalid_amplicons"),
    ("\t1\t2\n", "\t1\t\n", "rows_with_missing_counts"),
    ("\t1\t2\n", "\t1\n", "rows_with_missing_counts"),
    ("\t1\t2\n", "\t1\t2\t0\n", "rows_with_extra_fields"),
    ("\t1\t2\n", "\t1\t4294967296\n", "malformed_cells"),
    ("\t1\t2\n", "\t3\t-1\n", "malformed_cells"),
])
def test_bad_matrix_leaves_no_output(spark, source, tmp_path, old, new, message):
    path = source / V4
    text = path.read_text(encoding="utf-8")
    assert old in text
    path.write_text(text.replace(old, new), encoding="utf-8")
    target = tmp_path / "processed"
    with pytest.raises(ContractError, match=message):
        preprocess(spark, str(source), str(target), enforce_shape=False)
    assert list(target.iterdir()) == []


def test_shape_is_enforced_by_default(spark, source, tmp_path):
    with pytest.raises(ContractError, match="1434"):
        preprocess(spark, str(source), str(tmp_path / "processed"))


def test_target_inside_source_is_refused(spark, source):
    with pytest.raises(ContractError):
        preprocess(spark, str(source), f"{source}/processed")


@pytest.mark.parametrize("file, old, new, message", [
    ("context_general", "2010-01-01T12:00:00", "someday", "parse_errors"),
    ("context_general", "2010-01-01T12:00:00", "2010", "parse_errors"),
    ("context_general", "TARA_TEST_002\t", "TARA_TEST_001\t", "general_key_errors"),
    ("context_stat", "TARA_TEST_002", "OTHER_002", "stat_key_errors"),
    ("context_general", "\t10.0\t-20.0\t", "\t91.0\t-20.0\t", "coordinate_errors"),
    ("context_stat", "\t21\t", "\tNaN\t", "non_finite_values"),
])
def test_bad_context_is_refused(spark, source, tmp_path, file, old, new, message):
    path = source / SOURCES[file][0]
    text = path.read_text(encoding="utf-8")
    assert old in text
    path.write_text(text.replace(old, new, 1), encoding="utf-8")
    with pytest.raises(ContractError, match=message):
        preprocess(spark, str(source), str(tmp_path / "processed"), enforce_shape=False)


def test_typed_scan_keeps_quotes_and_reads_bom_and_nulls(spark, source):
    path = source / SOURCES["context_general"][0]
    text = path.read_text(encoding="utf-8").replace("Test Ocean", 'Te"st', 1).replace("pico", "", 1)
    path.write_text("﻿" + text, encoding="utf-8")
    rows = {r.sample_id_pangaea: r for r in
            scan_typed_tsv(spark, str(path), GENERAL_SCHEMA).collect()}
    assert rows["TARA_TEST_001"].ocean_region == 'Te"st'
    assert rows["TARA_TEST_001"].sizeplot is None
    assert rows["TARA_TEST_002"].event_latitude == 20.0


def test_typed_scan_refuses_other_headers(spark, source):
    path = source / SOURCES["context_general"][0]
    path.write_text(path.read_text().replace("sample_material\tevent_date", "event_date\tsample_material"))
    with pytest.raises(ContractError):
        scan_typed_tsv(spark, str(path), GENERAL_SCHEMA)


def test_header_audit(spark, source):
    rows = sorted(header_contract(spark, str(source)).collect(), key=lambda r: list(SOURCES).index(r.source))
    assert [r.ready for r in rows] == [True] * 4
    assert [r.sample_column_count for r in rows] == [0, 0, 2, 2]
    (source / SOURCES["context_general"][0]).write_text("sample_id_pangaea\tunexpected\nTARA_1\t1\n")
    write_lines(source / SOURCES["18s_v9"][0], [["amplicon", "amplicon", "X_1"]])
    rows = {r.source: r for r in header_contract(spark, str(source)).collect()}
    assert "event_date" in rows["context_general"].missing_columns
    assert rows["18s_v9"].duplicate_columns == ["amplicon"]
    assert rows["18s_v9"].invalid_sample_columns == ["<no sample columns>"]
    (source / SOURCES["18s_v9"][0]).unlink()
    rows = {r.source: r for r in header_contract(spark, str(source)).collect()}
    assert not rows["18s_v9"].exists and not rows["18s_v9"].ready


def test_equal_lines_have_one_identity_in_any_files(spark, source, tmp_path):
    path = source / V4
    row = source_fingerprint(spark, str(path), "18s_v4").first()
    assert (row.row_count, row.column_count, row.size_bytes) == (1, 8, path.stat().st_size)
    header, line = path.read_text(encoding="utf-8").splitlines()
    other = line.replace(VARIANT_A, VARIANT_A[::-1])
    marks = set()
    for name, files in (("one", [[header, line, other]]), ("turned", [[header, other, line]]), ("two", [[header, other], [header, line]]),
                        ("three", [[header], [header, line], [header, other]])):
        (tmp_path / name).mkdir()
        for i, lines in enumerate(files):
            (tmp_path / name / f"{i}.tsv").write_text("\n".join(lines) + "\n" * (i != 1), encoding="utf-8")
        found = source_fingerprint(spark, str(tmp_path / name), "18s_v4").first()
        assert found.row_count == 2
        marks.add(found.content_hash)
    assert len(marks) == 1 and row.content_hash not in marks


def test_every_file_of_a_source_is_audited(spark, source):
    path = source / V4
    text = path.read_text(encoding="utf-8")
    path.unlink()
    path.mkdir()
    (path / "a.tsv").write_text(text, encoding="utf-8")
    (path / "b.tsv").write_text(text, encoding="utf-8")
    ready = {r.source: r.ready for r in header_contract(spark, str(source)).collect()}
    assert ready == dict.fromkeys(SOURCES, True)
    (path / "b.tsv").write_text(text.replace("taxonomy\t", "taxa\t").replace("TARA_TEST_002", "X_2"), encoding="utf-8")
    row = {r.source: r for r in header_contract(spark, str(source)).collect()}["18s_v4"]
    assert (row.missing_columns, row.invalid_sample_columns, row.ready) == (["taxonomy"], ["X_2"], False)
    (path / "b.tsv").write_text("")  # an empty file has neither header nor rows and is left out
    assert {r.source: r.ready for r in header_contract(spark, str(source)).collect()}["18s_v4"]
    (path / "a.tsv").write_text("")
    row = {r.source: r for r in header_contract(spark, str(source)).collect()}["18s_v4"]
    assert (row.exists, row.size_bytes, row.ready) == (False, 0, False)


def test_wide_to_long_drops_zeros_but_keeps_samples(spark, tmp_path):
    folder = make_source(tmp_path / "s", samples=3, second_variant=True)
    matrix = read_wide(spark, str(folder / V4), "v4")
    assert matrix.cells().count() == 4
    assert matrix.marker_samples().count() == 3
    assert {(r.amplicon[:4], r.sample_id[-1], r.reads) for r in matrix.cells().collect()} == {
        ("0123", "1", 1), ("0123", "2", 2), ("0123", "3", 3), ("fedc", "1", 1)}


def test_store_checks_ids_and_artifacts(spark, store, tmp_path):
    with pytest.raises(ContractError, match="Unknown sample IDs"):
        abundance_slice(store.cells("v9"), store.marker_samples("v9"), ["TARA_UNKNOWN"])
    with pytest.raises(ContractError, match="duplicates"):
        context_by_ids(store.context(), ["TARA_TEST_001", "TARA_TEST_001"])
    with pytest.raises(ContractError, match="manifest"):
        Store(spark, str(tmp_path))
    assert store.integrity().filter("present and size_matches").count() == 4


def test_joins_refuse_doubled_keys_before_they_join(spark, store):
    context = store.context().select("sample_id_pangaea", "station")
    stat = store.context().select("sample_id_pangaea", "temperature")
    assert context_join(context, stat).count() == 2
    with pytest.raises(ContractError, match="stat_key_errors"):
        context_join(context, stat.unionByName(stat.limit(1)))
    with pytest.raises(ContractError, match="general_key_errors"):
        context_join(context.unionByName(context), stat)
    with pytest.raises(ContractError, match="metadata_key_errors"):
        marker_data(store.metadata("v4").unionByName(store.metadata("v4")), store.cells("v4"))


def test_marker_data_of_some_samples(spark, store):
    rows = marker_data(store.metadata("v4"), store.cells("v4"), sample_ids=["TARA_TEST_001"]).collect()
    assert {r.sample_id for r in rows} == {"TARA_TEST_001"} and len(rows) == 2
    with pytest.raises(ContractError, match="Unknown sample IDs"):
        marker_data(store.metadata("v4"), store.cells("v4"), sample_ids=["TARA_NONE"], marker_samples=store.marker_samples("v4"))
