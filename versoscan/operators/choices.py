"""Request tables of the boundary experiments, and the scoring of forced choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versoscan.functions import text as X
from versoscan.operators.structure import boundary_question

# fixed values
OPTIONS, CONTROLS, SIGNIFICANT = 6, 3, 4
QUESTIONS_PER_REQUEST = (1, 5, 20)
CONFIDENCE_CLAUSE = " Report the calibrated probability, not just yes or no."
JUNCTION = "The document is given as numbered lines in state.lines. Judge only the junction between `lines[%d]` and `lines[%d]`: does the topic, role, or structure change there? Do not judge any other pair."
ROLE = "The document is given as numbered lines in state.lines. Does the role of the text change between `lines[%d]` and `lines[%d]` — a shift in topic, a move between prose and a list, or the start of a new section?"
NEGATIVE = "The document is given as numbered lines in state.lines. Do `lines[%d]` and `lines[%d]` belong to the same continuous block, with no boundary between them?"


def question_variants(pairs: DataFrame, reps: int) -> DataFrame:
    """(doc, i, j, variant, polarity, rep, question): every wording of every pair, ``reps`` times."""
    i, j = F.col("i"), F.col("j")
    current = boundary_question(i, j)
    asked = [("current", 1, current), ("confidence", 1, F.concat(current, F.lit(CONFIDENCE_CLAUSE)))]
    asked += [(v, polarity, F.format_string(text, i, j)) for v, polarity, text in (("junction", 1, JUNCTION), ("role", 1, ROLE), ("negative", -1, NEGATIVE))]
    rows = pairs.select("doc", "i", "j", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(p).alias("polarity"), q.alias("question")) for v, p, q in asked))).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return rows.select("doc", "i", "j", "x.variant", "x.polarity", "rep", "x.question")


def pair_chunks(pairs: DataFrame, sizes: tuple[int, ...] = QUESTIONS_PER_REQUEST) -> DataFrame:
    """(doc, i, j, q, chunk): the requests that hold each pair, for each number of questions a request."""
    numbered = pairs.select("doc", "i", "j", (F.row_number().over(Window.partitionBy("doc").orderBy("i", "j")) - 1).alias("k"))
    return numbered.select("doc", "i", "j", "k", F.explode(F.array(*map(F.lit, sizes))).alias("q")).select("doc", "i", "j", "q", F.floor(F.col("k") / F.col("q")).cast("int").alias("chunk"))


def shrink_state(lines: DataFrame, endpoints: DataFrame, windows: DataFrame, budget: int) -> DataFrame:
    """(doc, idx): the lines of each window that are kept, ends of pairs first, then lines around them.

    Lines enter by their distance to the nearest end of a pair, all of one distance together, while the JSON size of
    the state stays within the budget; the ends themselves are kept over budget too. lines(doc, idx, line),
    endpoints(doc, idx), windows(doc, start, end).
    """
    order = Window.partitionBy("doc").orderBy("idx")
    ends = endpoints.select("doc", "idx").distinct().withColumn("is_end", F.lit(True))
    rows = lines.join(windows, "doc").where("idx between start and end").join(ends, ["doc", "idx"], "left")
    at_end = F.when(F.col("is_end"), F.col("idx"))
    before = F.last(at_end, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at_end, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("distance", F.least(F.col("idx") - before, after - F.col("idx")))
    by_distance = Window.partitionBy("doc").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    # {"lines": [..]} takes 12 characters, and a comma and space between lines
    size = F.sum(X.json_string_chars(F.col("line")) + 2).over(by_distance) - 2 + len('{"lines": []}')
    return rows.withColumn("size", size).where((F.col("distance") == 0) | (F.col("size") <= budget)).select("doc", "idx")


def choice_pools(window_labels: DataFrame, other_labels: DataFrame, offset: int) -> DataFrame:
    """(doc, label, i, j): labelled pairs of two sources as lines of the document, each once, without either."""
    shifted = window_labels.withColumns({"doc": F.when(F.col("doc") == "window", "plan").otherwise(F.col("doc")), "i": F.when(F.col("doc") == "window", F.col("i") + offset).otherwise(F.col("i")), "j": F.when(F.col("doc") == "window", F.col("j") + offset).otherwise(F.col("j"))})
    other = other_labels.withColumn("doc", F.when(F.col("doc") == "plan_eb", "plan").otherwise(F.col("doc")))
    both = shifted.select("doc", "label", "i", "j").union(other.select("doc", "label", "i", "j"))
    return both.where("label in ('boundary', 'continue')").distinct()


def choice_questions(pools: DataFrame, questions: int, options: int = OPTIONS, seed: int = 0) -> DataFrame:
    """(doc, question, slot, i, j, label, reused, truncated): one boundary and up to five continues a question.

    Boundaries are spaced evenly; continues are taken unused first, then again from the head. As each question takes
    ``options - 1``, the unused ones of question k are the ranks from k * (options - 1) on. The order of the options
    comes from a hash of the seed and the pair.
    """
    order = Window.partitionBy("doc", "label").orderBy("i", "j")
    ranked = pools.select("*", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("doc", "label")).alias("n"))
    asked = ranked.where("label = 'boundary'").select("doc", "n").distinct().select("doc", F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.lit(questions - 1))).alias("question"))
    bounds = asked.join(ranked.where("label = 'boundary'"), "doc").where(F.col("r") == F.floor(F.col("question") * F.col("nb") / questions)).select("doc", "question", "i", "j", "label", F.lit(False).alias("reused"))
    take = options - 1
    first = F.least(F.col("question") * take, F.col("n"))
    fresh = (F.col("r") >= first) & (F.col("r") < first + take)
    missing = F.greatest(F.lit(take) - (F.col("n") - first), F.lit(0))
    again = (F.col("r") < first) & (F.col("r") < missing)
    conts = asked.join(ranked.where("label = 'continue'"), "doc").where(fresh | again).select("doc", "question", "i", "j", "label", again.alias("reused"))
    rows = bounds.unionByName(conts)
    unit = Window.partitionBy("doc", "question")
    slot = F.row_number().over(unit.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "question", "i", "j")), "i", "j")) - 1
    return rows.select("doc", "question", slot.alias("slot"), "i", "j", "label", "reused", (F.count("*").over(unit) < options).alias("truncated"))


def choice_requests(specs: DataFrame) -> DataFrame:
    """(doc, question, options): one request a question, its options as pairs of lines in the order of their slots."""
    return specs.groupBy("doc", "question").agg(F.sort_array(F.collect_list(F.struct("slot", "i", "j"))).alias("options"))


def choice_accuracy(specs: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: correct answers(doc, question, slot) over questions, and whether there are enough for a control run."""
    right = specs.where("label = 'boundary'").select("doc", "question", F.col("slot").alias("right"))
    return right.join(answers, ["doc", "question"], "left").agg(F.count("*").alias("questions"), F.count_if(F.col("slot") == F.col("right")).alias("correct"), (F.count_if(F.col("slot") == F.col("right")) >= SIGNIFICANT).alias("control"))


def top_confidence(answers: DataFrame, n: int = CONTROLS) -> DataFrame:
    """The n answers(doc, question, slot, confidence) a document with the highest confidence, ties in question order."""
    w = Window.partitionBy("doc").orderBy(F.desc("confidence"), "question")
    return answers.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def control_unchanged(main: DataFrame, control: DataFrame) -> DataFrame:
    """One row: whether every control choice equals the main one."""
    both = control.select("doc", "question", F.col("slot").alias("c")).join(main.select("doc", "question", F.col("slot").alias("m")), ["doc", "question"], "left")
    return both.agg(F.coalesce(F.bool_and(F.col("c").eqNullSafe(F.col("m"))), F.lit(True)).alias("unchanged"), F.count("*").alias("controls"))
