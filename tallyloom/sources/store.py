"""A table of files in which a write replaces only the buckets it touches.

Rows lie in buckets by the hash of their key. A write reads the buckets that its rows fall into,
makes them anew below ``data/version=<n>`` and then appends the touched buckets with their version to
``commits``, as one file. A reader takes for each bucket the version committed last, so a
write that broke off is never seen, and the next one replaces what it left. There is
one writer at a time. ``vacuum`` deletes what no reader takes any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete, exists

COMMIT = "version long, bucket long, rows long"


@dataclass
class Store:
    """``path``; ``key`` and ``schema`` of the rows; number of ``buckets``, chosen so that one fits a task."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64

    def _commits(self) -> DataFrame:
        log = f"{self.path}/commits"
        if not exists(self.spark, log):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(log)

    def versions(self) -> dict[int, tuple[int, int]]:
        """Version and rows of each bucket; at most as many entries as buckets."""
        last = self._commits().groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("v"))
        return {r.bucket: (r.v.version, r.v.rows) for r in last.collect()}

    def _folder(self, version: int, bucket: int | None = None) -> str:
        folder = f"{self.path}/data/version={version}"
        return folder if bucket is None else f"{folder}/bucket={bucket}"

    def bucket_of(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        found = {b: v for b, (v, n) in self.versions().items() if n and (only is None or b in only)}
        folders = [self._folder(v, b) for b, v in sorted(found.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, incoming: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Replace the rows of the touched buckets by ``fold(their rows, incoming)``; returns these buckets.

        ``fold`` may change rows only in buckets of keys of ``incoming``.
        """
        touched = {r.bucket for r in self.bucket_of(incoming.select(self.key)).select("bucket").distinct().collect()}
        if not touched:
            return touched
        version = 1 + max((v for v, _ in self.versions().values()), default=0)
        new = fold(self.read(touched), incoming).select(*self.schema.names)
        folder = self._folder(version)
        self.bucket_of(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        self._commit(version, touched)
        return touched

    def _commit(self, version: int, touched: set[int]) -> None:
        written = self.spark.read.schema(f"{self.schema[self.key].name} {self.schema[self.key].dataType.simpleString()}, bucket long")
        counts = {r.bucket: r.n for r in written.parquet(self._folder(version)).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        rows = [(version, b, counts.get(b, 0)) for b in sorted(touched)]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vacuum(self) -> int:
        """Delete the folders of buckets that a later version replaced; returns how many."""
        current = {(v, b) for b, (v, _) in self.versions().items()}
        old = [(r.version, r.bucket) for r in self._commits().filter("rows > 0").select("version", "bucket").collect()]
        gone = [self._folder(v, b) for v, b in sorted(set(old) - current)]
        return sum(delete(self.spark, folder) for folder in gone)


def compact_batches(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Put the batch folders of a stream's output together as ``fold`` of their rows, below ``path``-compact.

    The folder appears whole or not at all; a reader takes the last one and the batches after it.
    """
    df, last = _since(spark, path)
    newest = df.agg(F.max("batch")).first()[0]
    if newest is None or newest == last:
        return
    folder = f"{path.rstrip('/')}-compact"
    fold(df.drop("batch")).withColumn("batch", F.lit(newest).cast("long")).write.mode("overwrite").parquet(f"{folder}/upto={newest}")
    spark.createDataFrame([(newest,)], "upto long").coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def _since(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """The rows of the last compact folder and of the batches after it, and the batch up to which it goes."""
    folder = f"{path.rstrip('/')}-compact"
    df = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    if not exists(spark, f"{folder}/commits"):
        return df, None
    last = spark.read.schema("upto long").parquet(f"{folder}/commits").agg(F.max("upto")).first()[0]
    whole = spark.read.parquet(f"{folder}/upto={last}").withColumn("batch", F.col("batch").cast("long"))
    return whole.unionByName(df.filter(F.col("batch") > last)), last


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stream's output folder, from its compact folder where there is one."""
    return _since(spark, path)[0].drop("batch")
