"""Spectral index and scene-mask expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scene classes kept (vegetation, bare soil, water, unclassified).
VALID_SCENE_CLASSES = (4, 5, 6, 7)
# Reflectance offset (digital numbers) and scale.
REFLECTANCE_OFFSET = -1000.0
REFLECTANCE_SCALE = 1.0 / 10000.0


def ndvi(red: Column, nir: Column) -> Column:
    """Normalised difference; NULL when the denominator is zero."""
    return (nir - red) / F.nullif(nir + red, F.lit(0.0))


def scene_is_valid(scl: Column) -> Column:
    return scl.isin(*VALID_SCENE_CLASSES)


def apply_mask(value: Column, valid: Column) -> Column:
    return F.when(valid, value)


def masked_ndvi(red: Column, nir: Column, scl: Column) -> Column:
    return apply_mask(ndvi(red, nir), scene_is_valid(scl))


def reflectance(dn: Column) -> Column:
    return (dn + F.lit(REFLECTANCE_OFFSET)) * F.lit(REFLECTANCE_SCALE)


def harmonize_reflectance(cube: DataFrame, bands: tuple[str, ...] = ("red", "nir")) -> DataFrame:
    """Scale the reflectance bands present in ``cube``; the class band is left alone."""
    present = [b for b in bands if b in cube.columns]
    return cube.withColumns({b: reflectance(F.col(b)) for b in present})
