"""Supplier intake and risk bands; scores come from an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.functions import scoring as S
from terrapulse.functions import text as X


def run(suppliers: DataFrame, scores: DataFrame, selected_material: str) -> DataFrame:
    """Suppliers with their material, scores and band; an unscored supplier keeps NULLs."""
    named = suppliers.withColumn(
        "raw_material", X.raw_material(F.col("source_commodity"), selected_material)
    )
    joined = named.join(scores, "supplier_id", "left")
    return joined.withColumn("risk_band", S.risk_band(F.col("risk_score")))
