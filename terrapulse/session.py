"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrapulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The local tables are a few MB: without this every stage is folded into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        # Medians keep one small map per group; the default turns to sorting after 128 groups.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"terrapulse-core-{context.applicationId}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for part in sorted(root.glob("terrapulse/**/*.py")):
                archive.write(part, part.relative_to(root))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)


_PRIVATE_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; without the setting a private one, in local mode only.

    A folder of one machine loses rows on a cluster, so there its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE_ROOTS:
        _PRIVATE_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _PRIVATE_ROOTS[app]


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Cut the lineage with a table bucketed and sorted by ``key`` in the shared checkpoint folder.

    What reads it is partitioned by the key already: windows, groupings and joins by the key need no exchange. There
    are as many buckets as shuffle partitions, one file each.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(count, key).sortWithinPartitions(key)
    dealt.write.bucketBy(count, key).sortBy(key).option("path", f"{checkpoint_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles and sorts both sides.

    For sides that grow with the data: a stored table is judged by its compressed bytes and a generator by its input, so
    without the hint a join may send hundreds of megabytes through the driver as one broadcast.
    """
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared checkpoint folder.

    Later steps read it back as columns, so they prune and push down, and a lost executor costs a
    re-read and not the whole lineage.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
