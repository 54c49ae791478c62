"""The tables that the registered queries work on, derived from the given tables.

``documents`` has no Markdown, so its lines are given list markers, fences, tables and headings by a rule on doc_id and
line number. Judge answers, recorded runs and labels come from hashes of their keys, which any engine can compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.functions.text import hash_probability
from versoscan.operators import rules
from versoscan.operators.structure import analyze
from versoscan.plans.lint import Judge

RULESET = "tech-doc"
OWN_RULES = {"categories": [{"name": "voice", "threshold": 1.0}, {"name": "substance", "enabled": False}, rules._category("length", "文の長さ", severity="error", scope="both", levels_document=["長い", "短い"])]}
REPS = 5
EXPERIMENT_VARIANTS = ("current", "confidence", "junction", "negative", "role")
QS = (1, 5, 20)
PAIRS_PER_REQUEST = 10
OFFSET = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents, dealt out anew only where their files split into fewer parts than there are cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of documents with line syntax."""
    d = F.col("doc_id")

    def dress(line: Column, p: Column) -> Column:
        s = F.replace(line, F.lit(". "), F.lit("。"))
        h = (d * 7 + p * 13 + (p * p) % 5) % 29
        front = (d % 6 == 0) & (p < 3)
        out = F.when(front & (p == 1), "title: x").when(front, "---").when(h == 0, F.concat(F.lit("# "), s))
        # an item that goes on behind code of its own
        out = out.when(h.isin(1, 2), F.concat(F.lit("- "), s)).when(h == 3, F.concat(F.lit("- "), s, F.lit("\n  ```\n  code\n  ```\n  "), s)).when(h == 4, F.concat(F.lit("  - "), s)).when(h == 5, F.concat(F.lit("  "), s))
        out = out.when(h.isin(6, 7), F.concat(F.lit("| "), s, F.lit(" |"))).when(h.isin(8, 9), "```").when(h == 10, "~~~").when(h.isin(11, 12, 13), "")
        return out.when(h.isin(14, 15), F.concat(F.lit("1. "), s)).when(h == 16, F.concat(F.lit("* "), s)).when(h == 17, "---").when(h == 18, "  ```").otherwise(s)

    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), dress), "\n")
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def analyzed(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    return analyze(markdown(spark, sf_dir), by_document=by_document)


def category_table(spark: SparkSession) -> DataFrame:
    return rules.merge_categories(rules.read_ruleset(spark, RULESET), rules.categories(spark, OWN_RULES))


def _used(model: str) -> dict[str, Column]:
    """The usage of a request, from the number of its questions."""
    n = F.size("questions").cast("long")
    return {"model": F.lit(model), "input_tokens": n * 7, "output_tokens": n}


def boundary_answers(requests: DataFrame) -> DataFrame:
    """The hash judge: an answer's probability comes from the request's keys."""
    answer = lambda q: F.struct(q["key"].alias("key"), hash_probability(F.lit("b"), F.col("doc_id"), q["i"]).alias("prob"))
    return requests.withColumns({"answers": F.transform("questions", answer), **_used("judge-a")})


def score_answers(requests: DataFrame) -> DataFrame:
    """A score is between 0 and the number of levels less one."""
    block = F.coalesce("block", F.lit(-1))

    def answer(q: Column) -> Column:
        key = [F.col("scope"), F.col("doc_id"), block, q["key"]]
        return F.struct(q["key"].alias("key"), (hash_probability(F.lit("s"), *key) * (F.size(q["levels"]) - 1)).alias("score"), hash_probability(F.lit("c"), *key).alias("confidence"))

    return requests.withColumns({"answers": F.transform("questions", answer), **_used("judge-b")})


def locate_answers(requests: DataFrame, run: str = "l") -> DataFrame:
    answer = lambda q: F.struct(q["key"].alias("key"), hash_probability(F.lit(run), F.col("scope"), F.col("doc_id"), F.coalesce("block", F.lit(-1)), F.col("category"), q["cand"]).alias("prob"))
    return requests.withColumns({"answers": F.transform("questions", answer), **_used("judge-a")})


def hash_judge() -> Judge:
    return Judge(boundary_answers, score_answers, locate_answers)


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc, i, j): neighbouring lines of documents."""
    n = F.size(F.split("text", "\n", -1))
    i = F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))).alias("i")
    return documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("doc"), i).withColumn("j", F.col("i") + 1)


def recorded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded runs: a document's pairs, ten a request, five times; a few requests were answered by another model."""
    d = F.col("doc_id")
    rows = eval_pairs(spark, sf_dir).select("doc_id", "doc", "i", "j", F.floor(F.col("i") / PAIRS_PER_REQUEST).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))).alias("rep"))
    rows = rows.withColumn("p", hash_probability(F.lit("r"), "doc_id", "i", "rep"))
    requests = rows.groupBy("doc_id", "doc", "rep", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pairs"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("b"), "i"), "p"))).alias("probs"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    variant = pick(EXPERIMENT_VARIANTS, d % 5)
    model = F.when(hash_probability(F.lit("m"), "doc_id", "rep", "chunk") < 0.02, "m2").otherwise("m1")
    return requests.select(
        F.concat_ws("#", "doc_id", "rep").alias("run_id"), pick(("E-E", "E-C", "E-A"), d % 3).alias("experiment"), "doc", "rep", variant.alias("variant"),
        F.when(variant == "negative", -1).otherwise(1).alias("polarity"), pick(QS, F.floor(d / 3) % 3).alias("q"), model.alias("model"), "pairs", "probs", "chunk",
    )


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc, i, j, label, stratum, note) for six in ten pairs."""
    h = lambda salt: hash_probability(F.lit(salt), "doc_id", "i")
    label = F.when(h("t") < 0.45, "boundary").when(h("t") < 0.9, "continue").otherwise("either")
    rows = eval_pairs(spark, sf_dir).where(h("k") < 0.6)
    return rows.select("doc_id", "doc", "i", "j", label.alias("label"), F.lit("plain").alias("stratum"), F.when(h("n") < 0.3, "見出し").otherwise("").alias("note"))
