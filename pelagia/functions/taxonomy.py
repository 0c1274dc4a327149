"""Predicates over taxonomy paths such as ``Root;Eukaryota;Dinoflagellata``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia.contracts import ContractError


def taxon_match(taxon: str, mode: str = "level", path: Column | str = "taxonomy") -> Column:
    """Case-insensitive match of one whole level, or of a literal substring.

    Levels are compared as stored: they are not trimmed.
    """
    lowered = F.lower(F.col(path) if isinstance(path, str) else path)
    wanted = F.lit(taxon.lower())
    if mode == "level":
        return F.array_contains(F.split(lowered, ";", -1), wanted)
    if mode == "contains":
        return F.contains(lowered, wanted)
    raise ContractError(f"unknown match mode: {mode}")


def path_levels(path: str) -> Column:
    return F.split(F.col(path), ";", -1)
