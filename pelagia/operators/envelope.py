"""Result bundles: items, a one-row summary, and warnings as rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.contracts import SOURCES

# --- fixed values: warning codes ----------------------------------------------------------
MESSAGES = {
    "read_count_is_not_cell_abundance":
        "Read counts and ratios of them are sequencing signals, not cell abundances.",
    "taxon_not_found": "No sequence variant matches the requested taxon.",
    "samples_missing_marker_excluded":
        "Requested samples without data for this marker were left out.",
    "zero_read_library": "Relative abundance is undefined where a sample has no reads.",
    "unrarefied_diversity":
        "Richness and Shannon index come from unrarefied reads; sequencing depth matters.",
    "zero_reads_in_analysis_set":
        "The Shannon index is undefined where the analysed variants have no reads.",
    "missing_group_values_excluded": "Samples without a group value were left out of the groups.",
    "missing_environment_values_excluded":
        "Samples without the environment value were left out of the correlation.",
    "missing_filter_values_excluded":
        "Samples without a temperature were left out by the temperature filter.",
    "insufficient_samples": "A rank correlation needs at least three complete samples.",
    "constant_input": "A rank correlation is undefined for constant input.",
    "undefined_correlation": "The rank correlation gave no finite result.",
    "asymptotic_p_value_caution":
        "The asymptotic p-value is most accurate above 500 samples; read it with care.",
}
# --- end of fixed values --------------------------------------------------------------------


@dataclass
class Answer:
    """Lazy frames of one call; nothing runs until a frame is used."""

    items: DataFrame
    summary: DataFrame
    warnings: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def warning(code: str, when: Column, field_name: str | None = None,
            sample_count: Column | None = None, candidates: Column | None = None) -> Column:
    """A warning struct where ``when`` holds, else null."""
    nothing = F.lit(None).cast("long")
    return F.when(when, F.struct(
        F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"),
        F.lit(field_name).cast("string").alias("field"),
        (nothing if sample_count is None else sample_count.cast("long")).alias("sample_count"),
        (nothing if candidates is None else candidates.cast("long"))
        .alias("candidate_sample_count")))


def warning_rows(stats: DataFrame, warnings: list[Column]) -> DataFrame:
    """Explode the warnings that apply to a one-row frame of counts."""
    applicable = F.filter(F.array(*warnings), lambda w: w.isNotNull())
    return stats.select(F.inline(applicable))


def page_rows(counts: DataFrame, *lists: tuple[str, int, int, Column]) -> DataFrame:
    """One row per paged list of an answer: its name, offset and limit, and how many entries there are in all."""
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("list"), F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"),
        total.cast("long").alias("total")) for name, offset, limit, total in lists])))


def beside(*frames: DataFrame) -> DataFrame:
    """Put one-row frames of numbers next to each other without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def beside_by(key: str, *frames: DataFrame) -> DataFrame:
    """The same for frames of numbers with one row per key."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in stacked.columns if c != key])


def filters_map(values: dict[str, object]) -> Column:
    pairs: list[Column] = []
    for key, value in values.items():
        if value is not None:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            pairs += [F.lit(key), F.lit(text)]
    if not pairs:
        return F.from_json(F.lit("{}"), "map<string,string>")
    return F.create_map(*pairs)


def source_file(key: str) -> str:
    """File name behind a source key; an unknown key names itself."""
    return SOURCES[key][0] if key in SOURCES else key
