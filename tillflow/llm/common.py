"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.workspace import shared_folder

#: Fixed by the word definition of all operators: ASCII white space.
SPACES = r"[ \t\n\x0B\f\r]"
NO_SPACE = r"[^ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound Arrow batches by bytes, as very long texts may stand side by side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def once(column: Column, name: str) -> Column:
    """``column`` under ``name``, computed once however often it is used.

    Catalyst copies a projected expression into every later use, lambdas
    included; a one-element ``explode`` is a border it does not cross.
    """
    return F.explode(F.array(column)).alias(name)


def empty_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
