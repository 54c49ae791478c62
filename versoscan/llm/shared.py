"""What the operators share: reading the tables, cutting lineage, and components of a graph."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HOT_SHARE, SALTS = 2000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on a single machine one of our own."""
    context = spark.sparkContext
    if (given := context.getConf().get("spark.checkpoint.dir")) or (given := spark.conf.get("spark.checkpoint.dir", None)):
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(given)
        return given.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_apart(rows: DataFrame, keys: DataFrame, on: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose key is one of keys(*on, n, *keep), with the columns of ``keep``; n is the number of rows of each key,
    and keys is to be a table read back.

    A key with more than one in HOT_SHARE of these rows is dealt over SALTS tasks. There are at most HOT_SHARE such keys,
    so their hashes fit into an expression; each of them stands in ``keys`` once a salt.
    """
    hot, salted = hot_keys(keys, on)
    salt = F.when(F.xxhash64(*on).isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long")
    return rows.withColumn("salt", salt).join(salted.select(*on, *keep, "salt").hint("shuffle_hash"), [*on, "salt"]).drop("salt")


def hot_keys(keys: DataFrame, on: list[str]) -> tuple[list[int], DataFrame]:
    """The hashes of the keys(*on, n) that have more than one in HOT_SHARE of all rows, at most HOT_SHARE of them, and
    keys with ``salt``, in which these stand once a salt and the others once, at 0."""
    most = (keys.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    h = F.xxhash64(*on)
    hot = [r[0] for r in keys.where(F.col("n") > most).select(h).distinct().collect()]
    many = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return hot, keys.withColumn("salt", F.explode(F.when(h.isin(hot), many).otherwise(F.array(F.lit(0).cast("long"))) if hot else F.array(F.lit(0).cast("long"))))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b): undirected, without nulls. Returns (node, component), component the least node reachable.

    Alternating large-star and small-star steps: every step regroups links around the least neighbour by a partially
    aggregated minimum and a join, so a node with very many links is never gathered in one place. Each round is
    checkpointed. It raises if ``rounds`` don't suffice (they are logarithmic in the longest path).
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        # stable once every link leads to a node that has no lower one, with one link a node
        check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if check == before:
            break
        before = check
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
