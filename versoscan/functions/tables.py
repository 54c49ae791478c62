"""Tables that a job writes once and reads several times: files in the folder that driver and executors share.

A table with a key is dealt into buckets by it before it is written, a file a bucket, so that whatever groups, joins or
runs windows by this key later finds its rows together and shuffles nothing. Readers get only the columns they use, and
Spark knows the files' sizes, so it broadcasts a table only where it has measured it to be small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from versoscan.functions.lineage import shared_dir


BUCKET_BYTES = 32 << 20


class Tables:
    """The tables of one job. ``discard`` deletes them; DataFrames read from them can't be used any more then."""

    def __init__(self, spark: SparkSession, name: str = "job", folder: str | None = None):
        self.spark, self.name = spark, f"{name}_{uuid.uuid4().hex}"
        self.folder = folder or f"{shared_dir(spark)}/{self.name}"
        self.written: list[str] = []
        self.buckets = 0

    def put(self, name: str, df: DataFrame, *key: str, buckets: int | None = None) -> DataFrame:
        """Writes df and gives the table back; equal values of ``key`` are in one bucket."""
        path = f"{self.folder}/{name}"
        if not key:
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        n = buckets or self._buckets(df)
        table = f"{self.name}_{name}"
        df.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).option("path", path).format("parquet").saveAsTable(table)
        self.written.append(table)
        return self.spark.table(table)

    def _buckets(self, df: DataFrame) -> int:
        """One number for all tables of the job, so that they meet in place: as many as the first needs by the size that
        Spark estimates, at least one a core and at most the session's shuffle partitions."""
        if not self.buckets:
            most, cores = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            self.buckets = min(most, max(cores, -(-size // BUCKET_BYTES)))
        return self.buckets

    def bytes(self) -> int:
        """What the tables take."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(at).getLength() if files.exists(at) else 0

    def discard(self) -> None:
        for table in self.written:
            self.spark.sql(f"drop table if exists `{table}`")
        self.written = []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
