"""Mann-Kendall test and Theil-Sen slope per pixel."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

# Ship the kernel itself to the executors, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREND_TYPE = "sen_slope double, mk_s double, mk_pvalue double, mk_z double, trend_class double"
_BLOCK = 256


def _block_statistics(y: np.ndarray, alpha: float, min_valid: int) -> pd.DataFrame:
    """Statistics of a block of equally long series (rows), NaN where a month is missing.

    One pass per lag feeds both the sign sum and the slopes; the sign sum does not depend on
    whether gaps are collapsed, and slopes keep the original month distance.
    """
    rows, months = y.shape
    n = np.isfinite(y).sum(axis=1)
    sign_sum = np.zeros(rows)
    slopes = np.full((rows, max(months * (months - 1) // 2, 1)), np.nan)
    start = 0
    for lag in range(1, months):
        step = y[:, lag:] - y[:, :-lag]
        sign_sum += np.nansum(np.sign(step), axis=1)
        slopes[:, start : start + months - lag] = step / lag
        start += months - lag
    ordered = np.sort(y, axis=1)
    ties = np.zeros(rows)
    run = np.ones(rows)
    for i in range(1, months + 1):
        same = ordered[:, i] == ordered[:, i - 1] if i < months else np.zeros(rows, dtype=bool)
        ties += np.where(same, 0.0, run * (run - 1) * (2 * run + 5))
        run = np.where(same, run + 1, 1.0)
    variance = (n * (n - 1) * (2 * n + 5) - ties) / 18.0
    safe = np.where(variance > 0, variance, 1.0)
    z = np.where(variance > 0, (sign_sum - np.sign(sign_sum)) / np.sqrt(safe), 0.0)
    p = np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z])
    enough = n >= min_valid
    slope = np.full(rows, np.nan)
    measurable = enough & (n >= 2)
    if measurable.any():
        slope[measurable] = np.nanmedian(slopes[measurable], axis=1)
    found = pd.DataFrame(
        {
            "sen_slope": slope,
            "mk_s": sign_sum,
            "mk_pvalue": p,
            "mk_z": z,
            "trend_class": np.where(p < alpha, np.sign(z), 0.0),
        }
    )
    return found.where(pd.Series(enough), None)


def trend_of(series: Column, alpha: float = 0.05, min_valid: int = 6) -> Column:
    """Trend struct of an array column of equally spaced values (NULL = missing month).

    No built-in covers the complementary error function or the median of pairwise slopes without
    materialising every pair as a row, so the pairs live in an Arrow batch of the task.
    """

    @pandas_udf(TREND_TYPE)
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [
                _block_statistics(
                    np.stack([np.asarray(v, dtype="float64") for v in batch[i : i + _BLOCK]]),
                    alpha,
                    min_valid,
                )
                for i in range(0, len(batch), _BLOCK)
            ]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                columns=[c.split()[0] for c in TREND_TYPE.split(", ")]
            )

    return kernel(series)


def pack_series(monthly: DataFrame, pixel: str = "pixel_id", value: str = "v") -> DataFrame:
    """One row per pixel with its values in month order (at most one value per calendar month)."""
    entry = F.struct("mi", F.col(value).cast("double").alias("v"))
    packed = monthly.groupBy(pixel).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return packed.select(pixel, F.transform("s", lambda e: e.getField("v")).alias("series"))


def trend_table(
    monthly: DataFrame,
    alpha: float = 0.05,
    min_valid: int = 6,
    pixel: str = "pixel_id",
    value: str = "v",
) -> DataFrame:
    """``(pixel, sen_slope, mk_s, mk_pvalue, mk_z, trend_class)``; all NULL below ``min_valid``."""
    packed = pack_series(monthly, pixel, value)
    return packed.select(pixel, trend_of(F.col("series"), alpha, min_valid).alias("t")).select(
        pixel, "t.*"
    )
