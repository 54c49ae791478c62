"""Reports of lint results: one JSON record and a few text lines a document, exit codes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_SCORE = 3.0  # fixed value: the score of a run without scores


def file_summary(docs: DataFrame, blocks: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, blocks, violations, errors) of every document."""
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    v = merged.groupBy("doc_id").agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    out = docs.select("doc_id").join(b, "doc_id", "left").join(v, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blocks", "violations", "errors")))


def usage_summary(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """(doc_id, calls, input_tokens, output_tokens, models) of every document, from its requests."""
    u = calls.groupBy("doc_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))).alias("models"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(u, "doc_id", "left").select("doc_id", zero("calls"), zero("input_tokens"), zero("output_tokens"), F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def exit_codes(docs: DataFrame, merged: DataFrame) -> DataFrame:
    errors = merged.where("severity = 'error'").select("doc_id").distinct()
    return docs.select("doc_id").join(errors.withColumn("code", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("code", F.lit(0)).alias("exit_code"))


def run_exit_code(codes: DataFrame) -> DataFrame:
    """One row: the run's exit code, the highest of its documents' (0 without any), and how many documents fail."""
    return codes.agg(F.coalesce(F.max("exit_code"), F.lit(0)).alias("exit_code"), F.count_if(F.col("exit_code") > 0).alias("failed"), F.count("*").alias("documents"))


def fail_under(merged: DataFrame, scores: DataFrame, limit: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., exit_code, worst): 1 if there is an error, or if the least score of all (3.0 without any) is below the limit;
    one row for everything, or one a group."""
    both = scores.select(*by, "score", F.lit(0).alias("error")).unionByName(merged.select(*by, F.lit(None).cast("double").alias("score"), (F.col("severity") == "error").cast("int").alias("error")))
    worst = both.groupBy(*by).agg(F.coalesce(F.max("error"), F.lit(0)).alias("errors"), F.coalesce(F.min("score"), F.lit(NO_SCORE)).alias("worst"))
    return worst.select(*by, F.when((F.col("errors") == 1) | (F.col("worst") < limit), 1).otherwise(0).alias("exit_code"), "worst")


def _where(c_start: str, c_end: str, mark: str) -> Column:
    return F.when(F.col(c_start).isNotNull(), F.format_string(f" L%d-{mark}%d", F.col(c_start), F.col(c_end))).otherwise("")


def skipped_lines(skipped: DataFrame) -> DataFrame:
    """(doc_id, line): a warning for each skipped unit."""
    name = F.coalesce("category", "stage", F.lit("?"))
    return skipped.select("doc_id", F.concat(name, _where("start", "end", "L"), F.lit(" skipped ("), F.col("reason"), F.lit(")")).alias("line"))


def report_lines(summary: DataFrame, merged: DataFrame, skipped: DataFrame, usage: DataFrame) -> DataFrame:
    """(doc_id, part, line): the header, a line a finding, a line a skipped unit, the usage; part orders them."""
    head = summary.select("doc_id", F.lit(0).alias("part"), F.format_string("%s: %d blocks, %d violations", F.col("doc_id").cast("string"), "blocks", "violations").alias("line"))
    figure = F.when(F.col("probability").isNotNull(), F.format_string("P=%.2f", "probability")).otherwise(F.format_string("score=%.1f", "score"))
    body = merged.select("doc_id", F.lit(1).alias("part"), F.concat(F.format_string("  L%d-%d [%s] %s ", "start", "end", "severity", "category"), figure, F.lit(" "), F.substring("text", 1, 70)).alias("line"))
    name = F.coalesce("category", "stage", F.lit("?"))
    skips = skipped.select("doc_id", F.lit(2).alias("part"), F.concat(F.lit("  skipped: "), name, F.lit(" ("), F.col("reason"), F.lit(")"), _where("start", "end", "")).alias("line"))
    models = F.when(F.size("models") > 0, F.concat(F.lit(" ["), F.array_join("models", ", "), F.lit("]"))).otherwise("")
    last = usage.select("doc_id", F.lit(3).alias("part"), F.concat(F.format_string("  usage: %d calls, input=%d, output=%d", "calls", "input_tokens", "output_tokens"), models).alias("line"))
    return head.unionByName(body).unionByName(skips).unionByName(last)


def report_json(docs: DataFrame, blocks: DataFrame, scores: DataFrame, merged: DataFrame, skipped: DataFrame, summary: DataFrame, usage: DataFrame) -> DataFrame:
    """(doc_id, report): one nested record a document as JSON text, nulls kept; lists are in order of place."""
    pair = F.struct("score", "confidence")
    by_block = scores.where("scope = 'block'").groupBy("doc_id", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", pair)))).alias("scores"))
    b = blocks.join(by_block, ["doc_id", "block"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.struct("start", "end").alias("k"), F.to_json("scores").alias("s")))).alias("b"))
    b = b.select("doc_id", F.transform("b", lambda x: F.struct(F.array(x["k"]["start"], x["k"]["end"]).alias("lines"), F.from_json(F.coalesce(x["s"], F.lit("{}")), "map<string,struct<score:double,confidence:double>>").alias("scores"))).alias("blocks"))
    d = scores.where("scope = 'document'").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", pair)))).alias("doc_scores"))
    v = merged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "col", "category", "scope", "severity", F.round("probability", 3).alias("probability"), "score", "confidence", "text"))).alias("violations"))
    s = skipped.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("stage", "category", "reason", "start", "end"))).alias("skipped"))
    u = usage.select("doc_id", F.struct("calls", "input_tokens", "output_tokens", "models").alias("usage"))
    m = summary.select("doc_id", F.struct("blocks", "violations", "errors").alias("summary"))
    out = docs.select("doc_id")
    for part in (b, d, v, s, m, u):
        out = out.join(part, "doc_id", "left")
    empty = {"blocks": b, "violations": v, "skipped": s}
    for c, df in empty.items():
        out = out.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    record = F.struct(F.col("doc_id").alias("file"), "blocks", F.coalesce("doc_scores", F.create_map().cast(d.schema["doc_scores"].dataType)).alias("doc_scores"), "violations", "skipped", "summary", "usage")
    return out.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("report"))
