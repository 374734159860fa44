"""Tables between two steps, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_OWN: list[tempfile.TemporaryDirectory] = []
#: Spark's setting that shuffle files go as soon as the statement that made them has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Spark's bound of the bytes of one Arrow batch, and what the operators set it to where the session has Spark's own default.
_BATCH_BYTES, BATCH_BYTES, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where all runs in one process on one machine (tests) and the session names
    none, a temporary folder is made; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"master {master}: set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="sensemill-"))
        at = f"file://{_OWN[0].name}"
    return at.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most (or one row), unless the session has a bound of its own."""
    now = spark.conf.get(_BATCH_BYTES, None)
    if now is None or now.rstrip("b") == str(_DEFAULT_BATCH):
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the statements inside, which must be executed there."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Bytes of input, as Spark estimates them, for each file of a table between two steps.
FILE_BYTES, MOST_FILES = 64 << 20, 1 << 20


def read_bytes(df: DataFrame) -> int:
    """Bytes of all tables that a DataFrame reads; what its joins may make of them is no matter."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


class Workspace:
    """Tables written to the shared folder during one operator call; they go when the driver's JVM ends, if not before.

    With ``input``, the table that a call works on, exchanges have one partition for each
    FILE_BYTES of that, or one for each core if that is more, and so have tables files.
    """

    def __init__(self, spark: SparkSession, name: str, input: DataFrame | None = None):
        self.spark = spark
        self.files = None
        if input is not None and (size := read_bytes(input)) < 1 << 60:  # more stands for unknown
            self.files = min(max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)), MOST_FILES)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        path, fs = self._hadoop(self.root)
        fs.deleteOnExit(path)

    def _hadoop(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """Write a table and read it back: cuts the lineage, and survives lost executors.

        What follows reads the table alone, so the shuffle files behind it go at once.
        ``few``: few tasks write it, each several partitions in turn; for plans without
        hash joins, whose maps would add up in a task.
        """
        with self.sized():
            (self.gathered(df) if few else df).write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def gathered(self, df: DataFrame) -> DataFrame:
        """The same rows in no more partitions than a table has files; see ``few``."""
        return df.coalesce(self.files) if self.files else df

    @contextmanager
    def sized(self) -> Iterator[None]:
        """Settings of the statements that write tables: shuffle files go with the statement, partitions follow the input."""
        partitions = str(self.files) if self.files else self.spark.conf.get(_PARTITIONS)
        with setting(self.spark, CLEAN_UP, "true"), setting(self.spark, _PARTITIONS, partitions):
            yield

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, fs = self._hadoop(self.path(name))
        fs.delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with their place (from 0, long) in the order of the columns ``order``, which tell rows apart.

    Range partitions, written so that they stay as they are; a place is that in the
    partition plus the sizes of those before, one number for each partition.  Nothing
    is sorted or counted in one task.  Nulls come first.
    """
    work = Workspace(df.sparkSession, "numbered")
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = work.keep(dealt, "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(*df.columns, (F.col("_before") + at).alias(name))

