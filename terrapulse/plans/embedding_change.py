"""Change between two years of embeddings over one area."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from terrapulse.operators import change as CH


@dataclass
class ChangeProducts:
    pixels: DataFrame
    candidates: DataFrame
    summary: DataFrame


def run(year1: DataFrame, year2: DataFrame, percentile: float = 95.0) -> ChangeProducts:
    """All pixels with their distance, the changed ones, and the summary row."""
    pixels = CH.detect_change(year1, year2, percentile)
    return ChangeProducts(pixels, pixels.where("changed"), CH.change_summary(pixels))
