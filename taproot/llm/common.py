"""Helpers shared by the training-data operators: shared tables, size-checked broadcasts, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side with at most so many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a local session takes a temporary folder of its own; on a cluster that would be an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="taproot-")
        shared_dir.own = found
    return found.rstrip("/")


class Stored:
    """A table written to the shared folder: cuts lineage, and survives lost executors."""

    def __init__(self, df: DataFrame, compression: str = "zstd") -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/taproot/{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Counted(Stored):
    """A stored table that is counted as it is written, without a query of its own: ``rows``."""

    def __init__(self, df: DataFrame) -> None:
        count = Observation()
        super().__init__(df.observe(count, F.count(F.lit(1)).alias("rows")))
        self.rows: int = count.get["rows"]


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    return Stored(df, compression).read()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows.

    ``df`` must be cheap to count (a stored table). Larger sides come back without a hint and the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` stored, with a broadcast hint if at most ``rows`` rows were written."""
    kept = Counted(df)
    return F.broadcast(kept.read()) if kept.rows <= rows else kept.read()


def joined_by_hub(rows: DataFrame, hubs: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with one row per key, of which ``count`` tells how many rows it has and ``total`` their sum.

    A small side is broadcast. Else keys with very many rows (at most `BROADCAST_ROWS` of them, by ``total``) are broadcast,
    and all others are joined by a shuffle, in which no key is hot.
    """
    if hubs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hubs), key)
    most = -(-total // BROADCAST_ROWS)
    hot = F.broadcast(hubs.where(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(hubs.where(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes (as the plan knows them) that a partition of an explicit shuffle has at most, about.
PARTITION_BYTES = 512 << 20


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of all of ``df`` takes: the session's number, or more where its size asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # plans over tables in memory know no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES) if known else 1)


def crc32_of_id(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def sparing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, giving Arrow's free memory back after each batch: workers stay for later stages and would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for b in f(batches):
            yield b
            del b
            pool.release_unused()
        pool.release_unused()

    return run


def local_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A few rows of the driver as a DataFrame, by way of Arrow, so that no Python worker starts for them."""
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns, strict=True)}))


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def ranked(df: DataFrame, keys: list[Column], name: str = "rank", ranges: list[Column] | None = None, parts: int | None = None) -> DataFrame:
    """A gapless rank from 0 in the order of ``keys``, without a single-task window.

    ``ranges`` are narrower keys in the same order that the range partition looks at; equal ones stay in one task. ``parts`` tells how
    many partitions to take where the plan's own estimate is no use, as behind a join.

    Rows are range-partitioned and sorted; each partition counts its own rows, and the counts (one row per
    partition) give every partition its first rank. The numbered rows are stored, so the ranks are stable.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            local = pa.array(range(at, at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), local], names=[*b.schema.names, "_part", "_local"])
            at += n

    one = stored(df.repartitionByRange(parts or partitions(df), *(ranges or keys)).sortWithinPartitions(*keys).mapInArrow(number, schema))
    counts = {r["_part"]: r["n"] for r in one.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _first long")
    return one.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_local")).drop("_part", "_local", "_first")
