"""Facts of a folder's source files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taproot.sources.files import facts


def arriving(spark: SparkSession, folder: str, glob: str = "*.swift") -> DataFrame:
    """A stream of (path, source, error): each file once, whole."""
    lines = spark.readStream.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder)
    return lines.select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/").alias("path"), F.col("value").alias("source"), F.lit(None).cast("string").alias("error"))


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*.swift", once: bool = False) -> StreamingQuery:
    """Appends the facts of new files to a Parquet table. A batch that is run again replaces its own folder, so no file's
    facts come twice. ``once`` takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        facts(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = arriving(spark, folder, glob).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
