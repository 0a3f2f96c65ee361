"""Readers and writers."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_raw(spark: SparkSession, path: str, columns: Sequence[str], header: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header (without `multi_line`, fields hold no line breaks, and Spark splits large files), every column text (nothing is inferred, so that keys like 000001-01 stay), quoted fields with line breaks allowed; projected to `columns`."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("inferSchema", False)
    if header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return reader.csv(path).select(*(F.col(f"`{c}`") for c in columns))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A written data set read again, NA as null."""
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path)


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").option("compression", "gzip" if compress else "none").csv(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Predictions or metrics by model, tag and seed; a new run replaces those partitions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "tag", "seed").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a session within one process may do without that setting and gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fingerprint(df: DataFrame, parameters: str) -> str:
    """A name for a data set's content and the parameters applied to it, whatever the order of rows."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return f"{row[0]}-{row[1]}-{parameters}"
