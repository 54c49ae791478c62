"""A store of answers by their content, so that nothing is asked of a judge twice, neither within a run nor by a later one.

A request's key is the hash of its state as canonical JSON and of its questions. Answers are kept by this key and the
kind of request in Parquet files below the store's folder; a store belongs to one judge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.functions import text as X
from versoscan.functions.tables import Tables
from versoscan.operators.requests import state_hash

CALL = ["model", "input_tokens", "output_tokens"]
Answers = Callable[[DataFrame], DataFrame]


def asked_hash(requests: DataFrame) -> Column:
    """SHA-256 of what is asked: the columns among lines (as state), heading, context, body, document and candidates that
    a request has, and its questions with their keys."""
    fields: dict[str, Column] = {}
    for name, column in (("lines", "state"), ("heading", "heading"), ("context", "context"), ("block", "body"), ("document", "document"), ("candidates", "candidates")):
        if column in requests.columns:
            c = F.col(column)
            value = X.json_strings(c) if column == "state" else X.json_strings(F.transform(c, lambda x: x["text"])) if column == "candidates" else X.json_string(c)
            fields[name] = F.coalesce(value, F.lit("null"))
    return F.sha2(F.concat(state_hash(fields), F.to_json("questions")), 256)


class AnswerStore:
    """Answers below ``path``. Only one run at a time should add to a store; if two do, either answer may be taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def known(self, kind: str) -> DataFrame | None:
        """(asked_hash, answers, model, input_tokens, output_tokens) of a kind; None if there are none yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/{kind}").dropDuplicates(["asked_hash"])

    def ask(self, kind: str, requests: DataFrame, judge: Answers, keys: list[str], keep: dict[str, Column], tables: Tables) -> DataFrame:
        """(keys.., keep.., answers, model, input_tokens, output_tokens, reused) of each request, ``keys`` its key without
        nulls. The judge gets one request of each content that the store doesn't know; its answers are added first.

        What is joined are keys, hashes and answers. States go to the judge from where they were made, and are shuffled
        only where the new requests are too many to be sent to all tasks.
        """
        hashed = requests.withColumn("asked_hash", asked_hash(requests))
        index = tables.put(f"{kind}_asked", hashed.select(*keys, *(c.alias(name) for name, c in keep.items()), "asked_hash"))
        before = self.known(kind)
        fresh = index if before is None else index.join(before.select("asked_hash"), "asked_hash", "left_anti")
        first = fresh.groupBy("asked_hash").agg(F.min(F.struct(*keys)).alias("k")).select("asked_hash", *(F.col(f"k.{k}").alias(k) for k in keys))
        first = tables.put(f"{kind}_new", first)
        judge(hashed.join(first, [*keys, "asked_hash"], "left_semi")).select("asked_hash", "answers", *CALL).write.mode("append").parquet(f"{self.path}/{kind}")
        answered = index.join(self.known(kind), "asked_hash")
        return answered.join(first.withColumn("new", F.lit(True)), [*keys, "asked_hash"], "left").withColumn("reused", F.col("new").isNull()).drop("new", "asked_hash")


def ask(requests: DataFrame, judge: Answers, keys: list[str], keep: dict[str, Column]) -> DataFrame:
    """The same without a store: every request is asked."""
    return judge(requests).select(*keys, *(c.alias(name) for name, c in keep.items()), "answers", *CALL, F.lit(False).alias("reused"))
