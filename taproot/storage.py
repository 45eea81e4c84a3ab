"""Tables between the rounds of an iterative plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table with at most so many narrow rows may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 200_000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session takes a folder of its own; on a cluster that would be an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="taproot-"))
        found = _own[0]
    return found.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which Spark joins by a shuffle, unless the other side has a broadcast hint.

    Spark takes the size of a Parquet file for that of its rows. Repetitive strings take a tenth of it, so millions of them would be
    broadcast through the driver. The hint holds up to the next join or union.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read again: its lineage ends there, and any executor can read it. With more than `BROADCAST_ROWS` rows it is `shuffled`."""
    path, count = f"{shared_dir(df.sparkSession)}/taproot/{uuid.uuid4().hex}", Observation()
    df.observe(count, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found if count.get["rows"] <= BROADCAST_ROWS else shuffled(found)
