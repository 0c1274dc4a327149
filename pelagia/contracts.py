"""Fixed schemas, allow-lists and validated request objects."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: names and types of the stored tables ---------------------------------

SAMPLE_PREFIX = "TARA_"
CONTEXT_ID = "sample_id_pangaea"
MARKERS = ("v4", "v9")

GENERAL_SCHEMA = T.StructType([
    T.StructField("sample_id_pangaea", T.StringType()),
    T.StructField("sample_id_biosamples", T.StringType()),
    T.StructField("sample_id_ena", T.StringType()),
    T.StructField("sample_material", T.StringType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("event_latitude", T.DoubleType()),
    T.StructField("event_longitude", T.DoubleType()),
    T.StructField("depth_nominal", T.StringType()),
    T.StructField("marine_biome", T.StringType()),
    T.StructField("ocean_region", T.StringType()),
    T.StructField("biogeo_province", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("depth", T.StringType()),
    T.StructField("size_fraction", T.StringType()),
    T.StructField("lower_size_fraction", T.DoubleType()),
    T.StructField("upper_size_fraction", T.DoubleType()),
    T.StructField("depthplot", T.StringType()),
    T.StructField("sizeplot", T.StringType()),
    T.StructField("station_plot", T.StringType()),
    T.StructField("biomeplot", T.StringType()),
    T.StructField("polar", T.StringType()),
    T.StructField("abs_lat", T.DoubleType()),
    T.StructField("uniq", T.StringType()),
    T.StructField("complete", T.StringType()),
    T.StructField("coral_station", T.StringType()),
])

STAT_SCHEMA = T.StructType([
    T.StructField("sample_id_pangaea", T.StringType()),
    T.StructField("par", T.DoubleType()),
    T.StructField("depth_bathy", T.IntegerType()),
    T.StructField("lyapunov_exp", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("chla", T.DoubleType()),
    T.StructField("backscattering", T.DoubleType()),
    T.StructField("depth_chl_max", T.IntegerType()),
    T.StructField("mixed_layer_depth_sigma", T.IntegerType()),
    T.StructField("depth_max_brunt_väisälä", T.IntegerType()),
    T.StructField("nitrite", T.DoubleType()),
    T.StructField("phosphate", T.DoubleType()),
    T.StructField("nitrate_nitrite", T.DoubleType()),
    T.StructField("silicate", T.DoubleType()),
    T.StructField("nstar", T.DoubleType()),
])

METADATA_COLUMNS = ("amplicon", "taxonomy", "confidence", "total", "spread", "sequence")

# Columns a header must hold before a source counts as ready.
REQUIRED_GENERAL = ("sample_id_pangaea", "event_date", "event_latitude", "event_longitude",
                    "depth_nominal", "ocean_region", "station", "depth", "size_fraction",
                    "lower_size_fraction", "upper_size_fraction", "polar")
REQUIRED_STAT = ("sample_id_pangaea", "par", "temperature", "chla", "nitrite", "phosphate",
                 "nitrate_nitrite", "silicate")

# Source key -> (file name, required columns, holds repeated sample columns).
SOURCES = {
    "context_general": ("context_general.tsv", REQUIRED_GENERAL, False),
    "context_stat": ("context_stat.tsv", REQUIRED_STAT, False),
    "18s_v4": ("TARA-Oceans_18S-V4_dada2_table.tsv", METADATA_COLUMNS, True),
    "18s_v9": ("TARA-Oceans_18S-V9_dada2_table.tsv", METADATA_COLUMNS, True),
}

# Shape of the published campaign data.
EXPECTED_CONTEXT_ROWS = 1_434
EXPECTED_MARKER_SAMPLES = {"v4": 1_011, "v9": 1_069}
EXPECTED_MARKER_ROWS = {"v4": 152_155, "v9": 181_388}

DEPTHS = ("DCM", "FSW", "MES", "MIX", "SRF", "ZZZ")
DEPTH_ALIASES = {"surface": "SRF", "surface layer": "SRF", "表层": "SRF", "表面": "SRF"}
MATCH_MODES = ("level", "contains")
GROUP_FIELDS = ("polar", "ocean_region", "depth", "size_fraction")
ENVIRONMENT_VARIABLES = (
    "event_latitude", "event_longitude", "abs_lat", "lower_size_fraction", "upper_size_fraction",
    "par", "depth_bathy", "lyapunov_exp", "temperature", "chla", "backscattering",
    "depth_chl_max", "mixed_layer_depth_sigma", "depth_max_brunt_väisälä", "nitrite",
    "phosphate", "nitrate_nitrite", "silicate", "nstar",
)
SAMPLE_SUMMARY = ("sample_id_pangaea", "event_date", "event_latitude", "event_longitude",
                  "ocean_region", "station", "depth", "size_fraction", "polar", "temperature")
SPAN_KINDS = ("workflow", "node", "llm", "tool", "service", "data", "skill", "subagent")
SPAN_STATUSES = ("running", "completed", "failed")

MAX_COUNT = 4_294_967_295
MAX_PAGE = 500
MAX_TEXT = 200
MAX_IDS = 500

# --- end of fixed values ----------------------------------------------------------------

CONTEXT_COLUMNS = tuple(GENERAL_SCHEMA.names) + tuple(STAT_SCHEMA.names[1:])


class ContractError(ValueError):
    """A request or a table breaks a declared rule."""


class NotFound(LookupError):
    """The requested entity does not exist."""


def _text(name: str, value: str) -> str:
    if not isinstance(value, str) or len(value) > MAX_TEXT:
        raise ContractError(f"{name} must be text of at most {MAX_TEXT} characters")
    if not value.strip():
        raise ContractError(f"{name} must not be blank")
    return value.strip()


def _choice(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ContractError(f"{name} must be one of {', '.join(allowed)}")


def _window(offset: int, limit: int) -> None:
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ContractError(f"offset must be >= 0 and limit within 1..{MAX_PAGE}")


def _ids(values: list[str] | None) -> tuple[str, ...] | None:
    if values is None:
        return None
    cleaned = tuple(v.strip() for v in values)
    if not cleaned or len(cleaned) > MAX_IDS or not all(cleaned):
        raise ContractError(f"sample_ids must hold 1..{MAX_IDS} non-blank ids")
    if len(set(cleaned)) != len(cleaned):
        raise ContractError("sample_ids must not contain duplicates")
    return cleaned


def normal_depth(label: str) -> str:
    """Collapse blanks, resolve aliases, upper-case, and check the code."""
    collapsed = " ".join(label.split())
    code = DEPTH_ALIASES.get(collapsed.casefold(), collapsed.upper())
    _choice("depth", code, DEPTHS)
    return code


class Request:
    """Closed request: unknown keys are refused."""

    @classmethod
    def of(cls, payload: dict[str, Any]):
        unknown = set(payload) - {f.name for f in fields(cls)}
        if unknown:
            raise ContractError(f"unknown request fields: {sorted(unknown)}")
        return cls(**payload)

    def _set(self, **values: Any) -> None:
        for name, value in values.items():
            object.__setattr__(self, name, value)


@dataclass(frozen=True)
class SampleSearch(Request):
    ocean_region_contains: str | None = None
    polar: bool | None = None
    depths: tuple[str, ...] | list[str] = ()
    size_fractions: tuple[str, ...] | list[str] = ()
    temperature_min: float | None = None
    temperature_max: float | None = None
    offset: int = 0
    limit: int = 100

    def __post_init__(self) -> None:
        if self.ocean_region_contains is not None:
            self._set(ocean_region_contains=_text("ocean_region_contains",
                                                  self.ocean_region_contains))
        sizes = [s.strip() for s in self.size_fractions]
        if not all(sizes):
            raise ContractError("size_fractions must not be blank")
        self._set(depths=tuple(dict.fromkeys(normal_depth(d) for d in self.depths)),
                  size_fractions=tuple(dict.fromkeys(sizes)))
        low, high = self.temperature_min, self.temperature_max
        if low is not None and high is not None and low > high:
            raise ContractError("temperature_min must not exceed temperature_max")
        _window(self.offset, self.limit)

    def echo(self) -> dict[str, str]:
        """The filters that were really set."""
        named = {
            "ocean_region_contains": self.ocean_region_contains,
            "polar": None if self.polar is None else str(self.polar).lower(),
            "depths": ",".join(self.depths) or None,
            "size_fractions": ",".join(self.size_fractions) or None,
            "temperature_min": None if self.temperature_min is None else str(self.temperature_min),
            "temperature_max": None if self.temperature_max is None else str(self.temperature_max),
        }
        return {k: v for k, v in named.items() if v is not None}


@dataclass(frozen=True)
class TaxaSearch(Request):
    marker: str
    taxon: str
    match_mode: str = "level"
    asv_offset: int = 0
    asv_limit: int = 100
    sample_offset: int = 0
    sample_limit: int = 100

    def __post_init__(self) -> None:
        _choice("marker", self.marker, MARKERS)
        _choice("match_mode", self.match_mode, MATCH_MODES)
        self._set(taxon=_text("taxon", self.taxon))
        _window(self.asv_offset, self.asv_limit)
        _window(self.sample_offset, self.sample_limit)


@dataclass(frozen=True)
class AbundanceRequest(Request):
    marker: str
    taxon: str
    match_mode: str = "level"
    sample_ids: tuple[str, ...] | list[str] | None = None
    include_zero_samples: bool = True
    offset: int = 0
    limit: int = 100

    def __post_init__(self) -> None:
        _choice("marker", self.marker, MARKERS)
        _choice("match_mode", self.match_mode, MATCH_MODES)
        self._set(taxon=_text("taxon", self.taxon), sample_ids=_ids(self.sample_ids))
        _window(self.offset, self.limit)


@dataclass(frozen=True)
class DiversityRequest(Request):
    marker: str
    sample_ids: tuple[str, ...] | list[str] | None = None
    taxon: str | None = None
    match_mode: str = "level"
    group_by: str | None = None
    offset: int = 0
    limit: int = 100

    def __post_init__(self) -> None:
        _choice("marker", self.marker, MARKERS)
        _choice("match_mode", self.match_mode, MATCH_MODES)
        if self.group_by is not None:
            _choice("group_by", self.group_by, GROUP_FIELDS)
        if self.taxon is not None:
            self._set(taxon=_text("taxon", self.taxon))
        self._set(sample_ids=_ids(self.sample_ids))
        _window(self.offset, self.limit)


@dataclass(frozen=True)
class AssociationRequest(Request):
    marker: str
    taxon: str
    environment_variable: str
    match_mode: str = "level"
    sample_ids: tuple[str, ...] | list[str] | None = None
    point_offset: int = 0
    point_limit: int = 200

    def __post_init__(self) -> None:
        _choice("marker", self.marker, MARKERS)
        _choice("match_mode", self.match_mode, MATCH_MODES)
        _choice("environment_variable", self.environment_variable, ENVIRONMENT_VARIABLES)
        self._set(taxon=_text("taxon", self.taxon), sample_ids=_ids(self.sample_ids))
        _window(self.point_offset, self.point_limit)


def id_frame(spark, ids, column: str = "sample_id") -> DataFrame:
    """Requested ids as a one-column frame; accepts a list or a frame."""
    if isinstance(ids, DataFrame):
        return ids.select(ids[ids.columns[0]].alias(column))
    return spark.createDataFrame([(i,) for i in ids], f"{column} string")
