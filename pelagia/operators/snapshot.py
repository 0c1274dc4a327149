"""Content fingerprints and records of stored tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.sources.storage import total_size
from pelagia.sources.store import Artifact, Manifest


def row_mark(columns: list[str]) -> Column:
    """60 bits of the MD5 of a row's values, each as its length and text, or ``-`` for null; SQL engines can compute it."""
    texts = [F.col(f"`{c}`").cast("string") for c in sorted(columns)]
    whole = F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts], F.lit(""))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def content_fingerprint(frame: DataFrame) -> DataFrame:
    """Row count, hash sum and hash xor: equal for equal rows, whatever their order or files."""
    mark = row_mark(frame.columns)
    return frame.agg(F.count("*").alias("row_count"),
                     F.sum(mark.cast("decimal(28,0)")).alias("hash_sum"),
                     F.bit_xor(mark).alias("hash_xor"))


def artifact_record(frame: DataFrame, name: str, path: str, sample_columns: int = 0) -> Artifact:
    row = content_fingerprint(frame).first()
    text = "|".join(str(v) for v in (sorted(frame.columns), *row))
    return Artifact(name, name, total_size(frame.sparkSession, path), row.row_count,
                    len(frame.columns), hashlib.sha256(text.encode()).hexdigest(),
                    {f.name: f.dataType.simpleString() for f in frame.schema.fields},
                    sample_columns)


def artifact_records(spark, manifest: Manifest) -> DataFrame:
    """One row per stored table."""
    return spark.createDataFrame(
        [(a.name, a.path, a.bytes, a.rows, a.columns, a.fingerprint, a.sample_columns)
         for a in manifest.artifacts.values()],
        "artifact string, path string, size_bytes long, row_count long, column_count int, "
        "fingerprint string, sample_column_count int")


def dataset_status(spark, manifest: Manifest) -> DataFrame:
    """Sources with their size and, for the matrices, the number of sample columns."""
    samples = {"18s_v4": manifest.coverage["v4_samples"], "18s_v9": manifest.coverage["v9_samples"]}
    return spark.createDataFrame(
        [(key, record["filename"], True, record["size_bytes"], record["row_count"],
          record["column_count"], samples.get(key, 0)) for key, record in manifest.sources.items()],
        "source string, filename string, ready boolean, size_bytes long, row_count long, "
        "column_count int, sample_column_count long")
