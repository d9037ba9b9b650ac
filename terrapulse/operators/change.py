"""Embedding change between two years, and land-use classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.operators import trees as T
from terrapulse.operators.quantiles import column_quantiles
from terrapulse.session import checkpointed


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two vectors, with a tiny term guarding zero norms."""
    norms = (F.sqrt(_dot(a, a)) + F.lit(1e-12)) * (F.sqrt(_dot(b, b)) + F.lit(1e-12))
    return F.lit(1.0) - _dot(a, b) / norms


def aligned_distance(
    year1: DataFrame, year2: DataFrame, key: str = "pixel_id", vector: str = "embedding"
) -> DataFrame:
    """``(key, change_distance)`` of the pixels present in both years."""
    a = year1.select(key, F.col(vector).alias("_a"))
    b = year2.select(key, F.col(vector).alias("_b"))
    return a.join(b, key).select(key, cosine_distance(F.col("_a"), F.col("_b")).alias("change_distance"))


def flag_by_percentile(
    df: DataFrame, value: str, percentile: float = 95.0, flag: str = "changed"
) -> DataFrame:
    """Adds ``threshold`` (0 for an empty input) and the strict flag ``value > threshold``."""
    found = column_quantiles(df, value, [percentile / 100.0]).select(F.col("quantiles")[0])
    threshold = F.coalesce(found.scalar(), F.lit(0.0))
    return df.withColumn("threshold", threshold).withColumn(flag, F.col(value) > F.col("threshold"))


def detect_change(
    year1: DataFrame,
    year2: DataFrame,
    percentile: float = 95.0,
    key: str = "pixel_id",
    vector: str = "embedding",
) -> DataFrame:
    """The join of the two years runs once; threshold and flag read the stored distances."""
    distances = checkpointed(aligned_distance(year1, year2, key, vector))
    return flag_by_percentile(distances, "change_distance", percentile)


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.count_if("changed").alias("n_changed"),
        F.coalesce(F.round(F.max("threshold"), 4), F.lit(0.0)).alias("threshold"),
    )


@dataclass
class TrainedForest:
    """A fitted forest, its cross-validated accuracy (None when too few rows) and its classes."""

    model: object
    class_names: list[str]
    cv_accuracy: float | None
    n_samples: int


#: The deepest trees that the library grows.
MAX_DEPTH = 30


def _fit(ready: DataFrame, rows: int, width: int, order: str, trees: int, depth: int):
    """Few rows go whole to tasks that grow a tree each; more are shuffled to tasks that grow trees or parts of them."""
    if T.fits(rows, width):
        return T.train(ready, "_label", order, trees, depth)
    return T.train_stored(ready, "_label", order, trees, depth, width)


def stratified_fold(df: DataFrame, label: str, order: str, folds: int) -> DataFrame:
    """Adds ``_fold``: rows of a label are counted off in the order of a digest of ``order``.

    The count runs within stretches of the digest, to which the sizes of the stretches before are
    added, so no task holds a label.
    """
    dealt = df.withColumn("_digest", F.xxhash64(order)).withColumn("_part", F.shiftright("_digest", 54))
    sizes = dealt.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(label, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_digest", order))
    placed = dealt.withColumn("_at", within).join(before, [label, "_part"])
    fold = ((F.col("_at") - 1 + F.col("_before")) % folds).cast("int")
    return placed.withColumn("_fold", fold).drop("_digest", "_part", "_at", "_before")


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def train_forest(
    samples: DataFrame,
    label: str = "label",
    vector: str = "embedding",
    order: str = "pixel_id",
    trees: int = 100,
    folds: int = 5,
    depth: int = MAX_DEPTH,
) -> TrainedForest:
    """Random forest with stratified cross-validation; folds are capped by the smallest class, and none without folds."""
    named = _features(samples, vector).withColumn("_name", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="_name", outputCol="_label", stringOrderType="alphabetAsc")
    indexed = indexer.fit(named)
    ready = indexed.transform(named)
    sizes = ready.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width"))
    row = sizes.agg(F.sum("n").alias("total"), F.min("n").alias("smallest"), F.max("width").alias("width")).first()
    accuracy = None
    if folds and row["total"] >= 4 and row["smallest"] >= 2:
        k = max(2, min(folds, row["smallest"]))
        folded = checkpointed(stratified_fold(ready, "_label", order, k).drop("features"))
        folded = _features(folded, vector)
        metric = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
        scores = []
        for i in range(k):
            fitted = _fit(folded.where(F.col("_fold") != i), row["total"], row["width"], order, trees, depth)
            scores.append(metric.evaluate(fitted.transform(folded.where(F.col("_fold") == i))))
        accuracy = sum(scores) / k
    model = _fit(ready, row["total"], row["width"], order, trees, depth)
    return TrainedForest(model, list(indexed.labels), accuracy, row["total"])


def classify_pixels(trained: TrainedForest, pixels: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``predicted_class`` and ``confidence`` (the largest class probability)."""
    scored = trained.model.transform(_features(pixels, vector))
    names = F.array(*[F.lit(n) for n in trained.class_names])
    return scored.select(
        *pixels.columns,
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_class"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
