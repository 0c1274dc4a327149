"""Plot-ready frames over the page that a call returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = 20


def sample_map(items: DataFrame) -> DataFrame:
    return items.select(F.col("event_longitude").alias("x"), F.col("event_latitude").alias("y"),
                        F.col("sample_id_pangaea").alias("label"))


def occurrence_bars(samples: DataFrame) -> DataFrame:
    """The first bars of the ranked page."""
    top = samples.orderBy(F.desc("read_count"), "sample_id").limit(BARS)
    return top.select(F.col("sample_id").alias("x"), F.col("read_count").cast("double").alias("y"))


def abundance_bars(observations: DataFrame) -> DataFrame:
    """Highest ratios; a null ranks as zero and is dropped after the cut."""
    rank = F.coalesce("relative_abundance", F.lit(0.0))
    top = observations.orderBy(rank.desc(), "sample_id").limit(BARS)
    return top.filter("relative_abundance is not null").select(
        F.col("sample_id").alias("x"), F.col("relative_abundance").alias("y"))


def diversity_bars(observations: DataFrame) -> DataFrame:
    """The first samples in id order that have an index."""
    first = observations.filter("shannon_index is not null").orderBy("sample_id").limit(BARS)
    return first.select(F.col("sample_id").alias("x"), F.col("shannon_index").alias("y"))


def association_scatter(points: DataFrame) -> DataFrame:
    return points.select(F.col("environment_value").alias("x"),
                         F.col("relative_abundance").alias("y"), F.col("sample_id").alias("label"))
