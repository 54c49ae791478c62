"""A training-data pipeline over ``documents``: STAGES in order, each reading what the one before kept.

1. quality: documents that the quality rules reject go. 2. near-duplicates: of each component of documents
whose five-word shingles have a Jaccard similarity of 0.8 or more one stays, the one with the least doc_id. 3. decontamination: documents
that hold a passage of the benchmark go, each row judged by its own text. 4. personal data: every span found is replaced by a mark of its kind, n_chars
follows the text. 5. packing: the pieces of token sequences.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them again, except the last.
Null texts count as empty (the quality stage rejects them); further columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm import decontaminate, nearcopies, packing, pii, quality
from versoscan.llm.shared import remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_ITEM_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    scored = quality.score_quality(docs, trees, carry=rest).where("kept")
    return scored.select("doc_id", *(F.col(f"in_{c}").alias(c) for c in rest))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least (doc_id, hash of its columns) stays, once if it is repeated."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    found = nearcopies.near_copies(keyed)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("id"), F.col("first.row").alias("kept")).hint("shuffle_hash")
    # the row's hash covers doc_id; joining and then dropping repeats by it shuffles the text once
    rows = keyed.join(kept, keyed["row"] == kept["kept"]).where(keyed["doc_id"].eqNullSafe(kept["id"]))
    return rows.dropDuplicates(["row", "doc_id"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Items of fewer than LEAST_ITEM_WORDS words, which clean documents hold by chance, count where they are the whole text."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), whole_below=LEAST_ITEM_WORDS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_of(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: The trees, the random field and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, before)  # all that it was kept for is written
        before = f"{top}/{name}"
    return docs
