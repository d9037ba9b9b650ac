"""Exact quantiles: per key for groups that the keys bound, and of a whole column without a task that holds it.

A group of ``grouped_quantile`` is bounded by what its keys mean (the scenes of a pixel in a month), so the built-in
``percentile`` serves. ``column_quantiles`` and ``narrowed_quantile`` find the wanted ranks by narrowing: every value
falls into an order-preserving bucket that is a pure function of the value, bucket counts (a map-side combined
aggregate) locate the bucket of each wanted rank, and only the rows of that bucket go on to the next, 4096 times
finer, level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 4096


def _mantissa(value: Column) -> tuple[Column, Column]:
    """Binary exponent and fraction in [0,1) of the magnitude (0 for 0)."""
    magnitude = F.abs(value)
    exponent = F.floor(F.log2(F.nullif(magnitude, F.lit(0.0)))).cast("int")
    fraction = magnitude / F.pow(F.lit(2.0), exponent) - F.lit(1.0)
    return exponent, fraction


def coarse_bucket(value: Column) -> Column:
    """Order-preserving bucket: sign, exponent and the leading 12 bits of the fraction."""
    exponent, fraction = _mantissa(value)
    magnitude = (exponent + 1100).cast("bigint") * _STEPS + F.floor(fraction * _STEPS)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(value).cast("bigint") * magnitude
    )


def _fine(value: Column) -> Column:
    """The next 12 bits of the fraction, ordered like the value inside one coarse bucket."""
    _, fraction = _mantissa(value)
    scaled = fraction * _STEPS
    step = F.floor((scaled - F.floor(scaled)) * _STEPS)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(value).cast("bigint") * step
    )


def _narrow(rows: DataFrame, ranks: DataFrame, keys: list[str], bucket: Column) -> tuple:
    """Keep, per wanted rank, the rows of the bucket that holds it; ranks become bucket-relative."""
    group = [*keys, "want"]
    bucketed = rows.withColumn("bucket", bucket)
    counts = bucketed.groupBy(*group, "bucket").agg(F.sum("weight").alias("held"))
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        counts.withColumn("upto", F.sum("held").over(upto))
        .join(ranks, group)
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("held")))
        .select(*group, "bucket", (F.col("rank") - F.col("upto") + F.col("held")).alias("rank"))
    )
    kept = bucketed.join(located.select(*group, "bucket"), [*group, "bucket"]).drop("bucket")
    return kept, located.drop("bucket")


def narrowed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]
) -> DataFrame:
    """``(keys, quantiles)``: the linear-interpolation quantiles of each key, in the order of ``shares``.

    Two narrowing levels find all wanted ranks together. A key without a value has no row.
    """
    keys, last = list(keys), 2 * len(shares) - 1
    marked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    distinct = marked.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("weight"))
    position = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    totals = distinct.groupBy(*keys).agg(F.sum("weight").alias("n"))
    ranks = totals.select(
        *keys,
        F.explode(
            F.array(
                *[F.struct(F.lit(2 * i).alias("want"), F.floor(x).alias("rank")) for i, x in enumerate(position)],
                *[F.struct(F.lit(2 * i + 1).alias("want"), F.ceil(x).alias("rank")) for i, x in enumerate(position)],
            )
        ).alias("w"),
    ).select(*keys, "w.want", "w.rank")
    rows = distinct.withColumn("want", F.explode(F.sequence(F.lit(0), F.lit(last))))
    wanted = ranks
    for bucket in (coarse_bucket(F.col("v")), _fine(F.col("v"))):
        rows, wanted = _narrow(rows, wanted, keys, bucket)
    group = [*keys, "want"]
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        rows.withColumn("upto", F.sum("weight").over(upto))
        .join(wanted, group)
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("weight")))
    )
    ends = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("want") == w, F.col("v"))).alias(f"e{w}") for w in range(last + 1)]
    )
    named = ends.join(totals, keys) if keys else ends.withColumn("n", totals.scalar())
    between = [
        F.col(f"e{2 * i}") + (F.col(f"e{2 * i + 1}") - F.col(f"e{2 * i}")) * (x - F.floor(x))
        for i, x in enumerate(position)
    ]
    return named.select(*keys, F.array(*between).alias("quantiles"))


def grouped_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, alias: str, also: Sequence[Column] = ()
) -> DataFrame:
    """Quantile of ``value`` per key, next to the aggregates in ``also``; NULL for a key without a value.

    For keys whose groups are small by their meaning; see ``narrowed_quantiles`` for others.
    """
    return df.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(float(p))).alias(alias), *also)


def column_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row with the array ``quantiles`` of the whole column; no row without a value."""
    return narrowed_quantiles(df, [], value, shares)
