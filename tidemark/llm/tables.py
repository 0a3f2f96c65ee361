"""Reading tables and cutting lineage in places that every executor shares."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (`spark.checkpoint.dir`), which all executors share.  Where that is unset, a session within one process (a local test) gets a folder of its own; on a cluster it is an error, since other executors couldn't read one of this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and cut off from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes, and rows, that go to a Python worker at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends rows to Python workers in batches bounded by bytes, where it hasn't been set to less: long texts by the thousand would fill both sides' memory."""
    conf = df.sparkSession.conf
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", str(conf.get(name, None)).lower())
        if not now or not 0 < int(now[1]) <= most:
            conf.set(name, str(most))
    return df


def parallelism(spark: SparkSession) -> int:
    """The number of partitions that the session asks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_name(name: str, taken: Iterable[str]) -> str:
    """`name` with as many underscores before it as it takes to differ from all of `taken`, whatever their case."""
    lower = {x.lower() for x in taken}
    name = f"_{name}"
    while name.lower() in lower:
        name = f"_{name}"
    return name


#: Keys that are joined by broadcast because very many rows have them, at most.
HOT_KEYS = 4096


def joined_on_hot(rows: DataFrame, by_key: DataFrame, key: str, weight: str, count: int, most: int = HOT_KEYS) -> DataFrame:
    """Inner join of `rows`, of which there are `count`, with `by_key`, one row for each key; its column `weight`, how many of `rows` have the key, is left out.

    A key that more than one in `most` rows have would meet in one task: those keys,
    fewer than `most`, are joined by broadcast, the others by a shuffle.
    """
    few = F.broadcast(by_key.filter(F.col(weight) > max(32, count // most)).drop(weight))
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(by_key.drop(weight), key))
