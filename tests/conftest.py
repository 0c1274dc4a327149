from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pelagia.cluster import local_session  # noqa: E402
from pelagia.contracts import GENERAL_SCHEMA, METADATA_COLUMNS, SOURCES, STAT_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"
VARIANT_A = "0123456789abcdef0123456789abcdef"
VARIANT_B = "fedcba9876543210fedcba9876543210"


@pytest.fixture(scope="session")
def spark():
    session = local_session("pelagia-tests", 4, 4)
    yield session
    session.stop()


def write_lines(path: Path, rows: list[list[str]]) -> None:
    path.write_text("".join("\t".join(r) + "\n" for r in rows), encoding="utf-8")


def make_source(folder: Path, samples: int = 2, second_variant: bool = False) -> Path:
    """A small valid set of four sources."""
    folder.mkdir(parents=True, exist_ok=True)
    ids = [f"TARA_TEST_{i:03d}" for i in range(1, samples + 1)]
    general, stat = [GENERAL_SCHEMA.names], [STAT_SCHEMA.names]
    for i, sample in enumerate(ids, start=1):
        general.append([sample, f"BIOSAMPLE_{i}", f"ENA_{i}", "water", f"2010-01-0{i}T12:00:00",
                        str(10.0 * i), str(-20.0 * i), "0-100" if i == 1 else "5", "Trades Biome",
                        "Test Ocean", "Test Province", f"ST{i}", "SRF", "0.8-5", "0.8", "5", "SRF",
                        "pico", f"ST{i}", "Trades", "Non polar", str(10.0 * i), "yes", "yes", "no"])
        stat.append([sample, str(10 + i), str(-100 * i), "0.1", str(20 + i), "0.2", "0.01", "50",
                     "25", "40", "0.1", "0.2", "0.3", "0.4", "-1.0"])
    write_lines(folder / SOURCES["context_general"][0], general)
    write_lines(folder / SOURCES["context_stat"][0], stat)
    counts = [str(i) for i in range(1, samples + 1)]
    matrix = [[*METADATA_COLUMNS, *ids],
              [VARIANT_A, "Root;Eukaryota;Dinoflagellata", "100;99;98.5",
               str(sum(map(int, counts))), str(samples), "ACGTN", *counts]]
    if second_variant:
        matrix.append([VARIANT_B, "Root;Eukaryota;Other", "100;99;98", "1", "1", "ACGT",
                       "1", *["0"] * (samples - 1)])
    for key in ("18s_v4", "18s_v9"):
        write_lines(folder / SOURCES[key][0], matrix)
    return folder


@pytest.fixture
def source(tmp_path):
    return make_source(tmp_path / "source")


@pytest.fixture(scope="session")
def store(spark, tmp_path_factory):
    """A published store with two variants and two samples."""
    from pelagia.plans.preprocess import preprocess
    from pelagia.sources.store import Store
    root = tmp_path_factory.mktemp("store")
    folder = make_source(root / "source", second_variant=True)
    preprocess(spark, str(folder), str(root / "processed"), enforce_shape=False)
    return Store(spark, str(root / "processed"))
