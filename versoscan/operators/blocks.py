"""Blocks from boundary answers, and what surrounds a block: its heading and the text before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versoscan.functions import text as X
from versoscan.operators.judge import with_probability
from versoscan.operators.structure import lines_of, masked_text, prose_lines

CUT_AT = 0.5  # fixed value: probability from which a pair is a boundary
CONTEXT_CHARS = 2000  # fixed value


def cuts_in(questions: str, answers: str) -> Column:
    """The lines j at which the answers to a boundary request say that a block begins."""
    yes = F.filter(with_probability(F.col(questions), F.col(answers)), lambda x: x["prob"] >= CUT_AT)
    return F.transform(yes, lambda x: x["q"]["j"])


def boundary_cuts(answered: DataFrame) -> DataFrame:
    """(doc_id, j): pairs of answered boundary requests whose answer says that a block begins before line j."""
    return answered.select("doc_id", F.explode(cuts_in("questions", "answers")).alias("j"))


def forced_cuts(analyzed: DataFrame) -> DataFrame:
    """(doc_id, j): pairs across masked lines, except the list items that go on behind them.

    A narrow pass over the documents: only the lines between two prose lines are looked at for each pair."""
    prose = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.get("kinds", k).isNull() & ~X.is_blank(F.get("lines", k)))

    def across(prose: Column) -> Column:
        between = lambda i, j: F.slice("kinds", i + 2, j - i - 1)
        return F.filter(prose, lambda j, n: (n > 0) & F.exists(between(F.get(prose, n - 1), j), lambda kind: kind.isNotNull()))

    kept = F.transform("continuations", lambda p: p["j"])
    return analyzed.select("doc_id", F.explode(F.array_except(X.bound(prose, across), kept)).alias("j"))


def _numbered(prose: DataFrame, cuts: DataFrame) -> DataFrame:
    """Prose lines with ``block``, a running count of the cuts of their document."""
    cut = cuts.groupBy("doc_id").agg(F.collect_set("j").alias("cuts"))
    marks = F.map_from_arrays("cuts", F.transform("cuts", lambda _: F.lit(1)))
    joined = prose.join(cut.withColumn("cuts", marks), "doc_id", "left")
    w = Window.partitionBy("doc_id").orderBy("idx")
    return joined.withColumn("block", F.sum(F.coalesce(F.element_at("cuts", F.col("idx")), F.lit(0))).over(w).cast("int")).drop("cuts")


def block_ids(analyzed: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, idx, block) of prose lines. Everything is partitioned by doc_id once."""
    return _numbered(prose_lines(lines_of(analyzed)), cuts).select("doc_id", "idx", "block")


def build_blocks(analyzed: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, block, start, end, text): 1-based lines; blank and masked lines inside a block belong to its text."""
    return with_block_text(ids.groupBy("doc_id", "block").agg((F.min("idx") + 1).alias("start"), (F.max("idx") + 1).alias("end")), analyzed)


def block_lines(analyzed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block, idx, line) of all lines of each block, from a slice of the document's lines."""
    both = blocks.join(analyzed.select("doc_id", "lines"), "doc_id")
    rows = both.select("doc_id", "block", "start", F.posexplode(F.slice("lines", F.col("start"), F.col("end") - F.col("start") + 1)).alias("k", "line"))
    return rows.select("doc_id", "block", (F.col("start") - 1 + F.col("k")).alias("idx"), "line")


def title(line: Column, kind: Column) -> Column:
    """The text of a heading without its marks; null for other lines."""
    return F.when(kind.isNull() & X.lstrip(line).startswith("#"), X.strip(F.regexp_replace(X.strip(line), "^#+", "")))


def _with_heading(lines: DataFrame) -> DataFrame:
    """lines with ``heading``, the title of the last heading before each, empty if there is none."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("heading", F.coalesce(F.last(title(F.col("line"), F.col("kind")), ignorenulls=True).over(w), F.lit("")))


def _with_context_from(prose: DataFrame, limit: int) -> DataFrame:
    """Prose lines with ``from_idx``, the first of the lines before each that fit the limit together, by a range over
    running character totals; the nearest is taken in any case."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    upto = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = Window.partitionBy("doc_id").orderBy("upto").rangeBetween(-limit, -1)
    return prose.withColumn("upto", upto).withColumn("from_idx", F.coalesce(F.min("idx").over(fits), F.lag("idx").over(order))).drop("upto")


def context_before(lines: Column, kinds: Column, from_idx: Column, start: Column, limit: int) -> Column:
    """The prose of the 0-based line ``from_idx`` up to the 1-based line ``start``, at most its last ``limit`` characters."""
    at = F.filter(F.sequence(from_idx, start - 2), lambda k: F.get(kinds, k).isNull() & ~X.is_blank(F.get(lines, k)))
    text = F.when(from_idx.isNotNull(), F.array_join(F.transform(at, lambda k: F.get(lines, k)), "\n")).otherwise("")
    return F.substring(text, -limit, limit)


def _at_starts(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    return lines.join(blocks.select("doc_id", "block", (F.col("start") - 1).alias("idx")), ["doc_id", "idx"])


def nearest_heading(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block, heading): the last unmasked line before the block that starts with #, without its marks."""
    return _at_starts(_with_heading(lines), blocks).select("doc_id", "block", "heading")


def preceding_context(analyzed: DataFrame, blocks: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(doc_id, block, context): the prose lines before the block, from the nearest on while they fit the limit; the
    nearest is taken in any case and cut to its end. Lines are sliced at block starts only."""
    starts = _at_starts(_with_context_from(prose_lines(lines_of(analyzed)), limit), blocks).select("doc_id", "block", (F.col("idx") + 1).alias("start"), "from_idx")
    context = context_before(F.col("lines"), F.col("kinds"), F.col("from_idx"), F.col("start"), limit)
    return starts.join(analyzed.select("doc_id", "lines", "kinds"), "doc_id").select("doc_id", "block", context.alias("context"))


def place_blocks(analyzed: DataFrame, cuts: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(doc_id, block, start, end, heading, from_idx): where each block lies and where its context begins; no text of it.

    One pass over the lines of each document: headings, cuts and context starts share the partitioning by doc_id.
    """
    rows = _with_context_from(prose_lines(_with_heading(lines_of(analyzed))), limit)
    return _numbered(rows, cuts).groupBy("doc_id", "block").agg(
        (F.min("idx") + 1).alias("start"), (F.max("idx") + 1).alias("end"), F.min_by("heading", "idx").alias("heading"), F.min_by("from_idx", "idx").alias("from_idx")
    )


def with_block_text(placed: DataFrame, analyzed: DataFrame) -> DataFrame:
    """placed(doc_id, start, end, ..) with ``text``, the lines of each block."""
    text = F.array_join(F.slice("lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    return placed.join(analyzed.select("doc_id", "lines"), "doc_id").withColumn("text", text).drop("lines")


def with_block_state(placed: DataFrame, analyzed: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """placed(doc_id, start, end, from_idx, ..) with text, context, body, lines and kinds, sliced from the document's lines."""
    both = placed.join(analyzed.select("doc_id", F.col("lines").alias("all_lines"), F.col("kinds").alias("all_kinds")), "doc_id")
    start, n = F.col("start"), F.col("end") - F.col("start") + 1
    lines, kinds = F.slice("all_lines", start, n), F.slice("all_kinds", start, n)
    context = context_before(F.col("all_lines"), F.col("all_kinds"), F.col("from_idx"), start, limit)
    return both.select(*placed.columns, F.array_join(lines, "\n").alias("text"), context.alias("context"), masked_text(lines, kinds).alias("body"), lines.alias("lines"), kinds.alias("kinds"))


def block_states(analyzed: DataFrame, cuts: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(doc_id, block, start, end, heading, from_idx, text, context, body, lines, kinds): each block with what is sent about it."""
    return with_block_state(place_blocks(analyzed, cuts, limit), analyzed, limit)
