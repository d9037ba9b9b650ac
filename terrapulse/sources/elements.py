"""Elements of large JSON documents, read by many tasks.

A collection is one JSON document, often one line. Its elements name their kind (``{"type": "Feature", ...``), so the
text is cut where the kind stands, which Spark's reader does across byte ranges; each piece then is an element without
its first member. The cut is right if, file by file, every piece but the last ends where an element's type is due. A
document of another form (the type not first, the kind's name as a value elsewhere) is read as a whole instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_DUE = r'\{\s*"type"\s*:\s*$'
_GOES_ON = r"^\s*[,}]"


def pieces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``value``: the text between the places where ``"kind"`` stands."""
    return spark.read.text(path, lineSep=f'"{kind}"')


def splits_at(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether cutting at the kind's name gives the elements of every file and nothing else."""
    read = pieces(spark, path, kind).select("_metadata.file_path", F.col("value").rlike(_DUE).alias("due"), F.col("value").rlike(_GOES_ON).alias("on"))
    files = read.groupBy("file_path").agg(F.count_if(~F.col("due")).alias("ends"), F.count_if(~F.col("on")).alias("heads"), F.count("*").alias("n"))
    odd = files.where("ends <> 1 or heads <> 1 or n < 2").limit(1)
    return odd.isEmpty() and not files.limit(1).isEmpty()


def read_elements(spark: SparkSession, path: str, kind: str, array: str, schema: str) -> DataFrame:
    """The elements of ``kind`` in the array named ``array`` as the columns of ``schema`` (members besides the type).

    Elements of other kinds are left out; of a document that names no kinds all are taken.
    """
    if splits_at(spark, path, kind):
        text = pieces(spark, path, kind).where(F.col("value").rlike(_GOES_ON))
        # What follows the element's closing bracket, up to the next one, is no part of the value that is parsed.
        element = F.from_json(F.concat(F.lit(f'{{"type":"{kind}"'), "value"), f"type string, {schema}")
        return text.select(element.alias("e")).select("e.*").drop("type")
    element = StructType([StructField("type", StringType()), *StructType.fromDDL(schema)])
    whole = spark.read.schema(StructType([StructField(array, ArrayType(element))])).json(path, multiLine=True)
    found = whole.select(F.explode(array).alias("e")).select("e.*")
    return found.where(F.coalesce(F.col("type") == kind, F.lit(True))).drop("type")

