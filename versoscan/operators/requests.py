"""What is asked of the judge: scoring and locating requests, their sizes, gates and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versoscan.functions import text as X
from versoscan.operators.blocks import CONTEXT_CHARS, context_before
from versoscan.operators.judge import QUESTIONS
from versoscan.operators.rules import AUTHOR_CLAUSE, active_categories
from versoscan.operators.structure import masked_slice, masked_text, sentences

# fixed values: characters of a document, of a scoring request and of a locating request
DOCUMENT_CHARS, SCORE_CHARS, LOCATE_CHARS = 32000, 32000, 32000
SKIP = ["doc_id", "stage", "category", "reason", "start", "end"]


def masked_documents(analyzed: DataFrame) -> DataFrame:
    return analyzed.select("doc_id", masked_text(F.col("lines"), F.col("kinds")).alias("masked"))


def state_chars() -> Column:
    """Length of a block's state as JSON."""
    return X.json_object_chars({c: X.json_string_chars(F.col(c)) for c in ("heading", "context", "body")})


def instruction() -> Column:
    return F.concat("description", F.lit(AUTHOR_CLAUSE))


def questions_chars(cats: DataFrame, document: bool = False) -> DataFrame:
    """One row: the length of all scoring questions as JSON, name -> [instruction, levels]."""
    levels = F.when(document & (F.size("levels_document") > 0), F.col("levels_document")).otherwise(F.col("levels")) if document else F.col("levels")
    one = X.json_string_chars(F.col("name")) + 2 + 2 + 2 + X.json_string_chars(instruction()) + X.json_strings_chars(levels)
    return cats.select(one.alias("n")).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.when(F.count("*") > 0, 2 + 2 * (F.count("*") - 1)).otherwise(0)).alias("question_chars"))


def block_payloads(states: DataFrame, cats: DataFrame) -> DataFrame:
    """states with ``payload``: the characters of a scoring request."""
    total = questions_chars(active_categories(cats, "block"))
    return states.crossJoin(F.broadcast(total)).withColumn("payload", state_chars() + F.col("question_chars")).drop("question_chars")


def score_questions(cats: DataFrame, scope: str) -> DataFrame:
    """One row: ``questions`` (key, instruction, levels) of the categories asked about blocks or about documents."""
    levels = F.when((F.lit(scope) == "document") & (F.size("levels_document") > 0), F.col("levels_document")).otherwise(F.col("levels"))
    one = F.struct("pos", F.col("name").alias("key"), instruction().alias("instruction"), levels.alias("levels"))
    rows = active_categories(cats, scope).agg(F.sort_array(F.collect_list(one)).alias("q"))
    return F.broadcast(rows.select(F.transform("q", lambda x: F.struct(x["key"].alias("key"), x["instruction"].alias("instruction"), x["levels"].alias("levels"))).alias("questions")))


def block_score_requests(payloads: DataFrame, cats: DataFrame, limit: int = SCORE_CHARS) -> DataFrame:
    """One row a block that fits: its state, and a question a category."""
    return payloads.where(F.col("payload") <= limit).crossJoin(score_questions(cats, "block")).select("doc_id", "block", "heading", "context", "body", "questions")


def has_prose() -> Column:
    return F.exists(F.arrays_zip("lines", "kinds"), lambda x: x["kinds"].isNull() & ~X.is_blank(x["lines"]))


def document_score_requests(analyzed: DataFrame, cats: DataFrame, limit: int = DOCUMENT_CHARS) -> DataFrame:
    """One row a document that fits and has prose: its text, and a question a category, with the document's own levels
    where there are some."""
    docs = masked_documents(analyzed.where(has_prose())).where(F.length("masked") <= limit)
    return docs.crossJoin(score_questions(cats, "document")).select("doc_id", F.col("masked").alias("document"), "questions")


def _skipped(df: DataFrame, reason: str, **given: Column) -> DataFrame:
    null = {"stage": "string", "category": "string", "start": "int", "end": "int"}
    return df.select("doc_id", *(given[c].alias(c) if c in given else F.lit(reason).alias(c) if c == "reason" else F.lit(None).cast(null[c]).alias(c) for c in SKIP[1:]))


def no_prose_skips(analyzed: DataFrame, cats: DataFrame) -> DataFrame:
    names = F.broadcast(active_categories(cats, "document").select("name"))
    return _skipped(analyzed.where(~has_prose()).select("doc_id").crossJoin(names), "no_evaluable_prose", category=F.col("name"))


def uninspected_pairs(analyzed: DataFrame) -> DataFrame:
    pairs = analyzed.select("doc_id", F.explode("uninspected").alias("p"))
    return _skipped(pairs, "window_state_too_large", stage=F.lit("segment"), start=F.col("p.i") + 1, end=F.col("p.j") + 1)


def size_skips(analyzed: DataFrame, payloads: DataFrame, cats: DataFrame, document: int = DOCUMENT_CHARS, score: int = SCORE_CHARS) -> DataFrame:
    """Documents and blocks too large to be scored, for each category that would have."""
    names = lambda scope: F.broadcast(active_categories(cats, scope).select("name"))
    large = masked_documents(analyzed).where(F.length("masked") > document).select("doc_id").crossJoin(names("document"))
    blocks = payloads.where(F.col("payload") > score).crossJoin(names("block"))
    return _skipped(large, "state_too_large", category=F.col("name")).unionByName(_skipped(blocks, "score_state_too_large", category=F.col("name"), start=F.col("start"), end=F.col("end")))


UNIT = ["doc_id", "scope", "block"]
AT = ["doc_id", "of"]  # a unit's key without nulls: ``of`` is the block, -1 for the whole document


def _unit_lines(units: DataFrame, analyzed: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """units with their state (heading, context and body of a block, or document) and their document's lines and spans."""
    both = units.join(analyzed.select("doc_id", F.col("lines").alias("all_lines"), F.col("kinds").alias("all_kinds"), F.col("spans").alias("all_spans")), "doc_id")
    in_block = F.col("scope") == "block"
    masked = F.when(in_block, masked_slice(F.col("all_lines"), F.col("all_kinds"), F.col("start"), F.col("end"))).otherwise(masked_text(F.col("all_lines"), F.col("all_kinds")))
    context = F.when(in_block, context_before(F.col("all_lines"), F.col("all_kinds"), F.col("from_idx"), F.col("start"), limit))
    return both.withColumn("masked", masked).select(*units.columns, context.alias("context"), F.when(in_block, F.col("masked")).alias("body"), F.when(~in_block, F.col("masked")).alias("document"), "all_lines", "all_spans")


def flagged_units(flagged: DataFrame, placed: DataFrame, analyzed: DataFrame) -> DataFrame:
    """The store of spans: a row a unit of flagged(doc_id, scope, block, category) that has sentences.

    (doc_id, of, scope, block, start, end, heading, from_idx, asked, spans, state_chars): ``asked`` are its categories,
    ``spans`` the places (line, col, chars) of its sentences, ``state_chars`` the characters of its state with them. No
    text is kept but a block's heading: states and sentences are cut from the document's lines again where they are
    needed. Sentences were found once a document; a unit takes those of its lines within the row, so nothing but the
    units' numbers is shuffled.
    """
    units = flagged.groupBy(*UNIT).agg(F.sort_array(F.collect_list("category")).alias("asked"))
    null = lambda kind: F.lit(None).cast(kind)
    in_block = units.where("scope = 'block'").join(placed.select("doc_id", "block", "start", "end", "heading", "from_idx"), ["doc_id", "block"])
    whole = units.where("scope = 'document'").select(*UNIT, "asked", F.lit(1).alias("start"), null("int").alias("end"), null("string").alias("heading"), null("int").alias("from_idx"))
    rows = _unit_lines(in_block.select(*whole.columns).unionByName(whole), analyzed)
    inside = lambda s: (F.col("scope") == "document") | s["line"].between(F.col("start"), F.col("end"))
    rows = rows.withColumn("found", F.filter("all_spans", inside)).where(F.size("found") > 0)
    chars = X.json_string_chars
    fields = {"candidates": F.aggregate("found", F.lit(0), lambda a, s: a + s["json"]) + 2 * F.size("found")}
    size = F.when(F.col("scope") == "block", X.json_object_chars({"heading": chars(F.col("heading")), "context": chars(F.col("context")), "block": chars(F.col("body"))} | fields)).otherwise(X.json_object_chars({"document": chars(F.col("document"))} | fields))
    spans = F.transform("found", lambda s: F.struct(s["line"].alias("line"), s["col"].alias("col"), s["chars"].alias("chars")))
    return rows.select("doc_id", F.coalesce("block", F.lit(-1)).alias("of"), "scope", "block", "start", "end", "heading", "from_idx", "asked", spans.alias("spans"), size.alias("state_chars"))


def _with_payload(units: DataFrame, cats: DataFrame) -> DataFrame:
    """A row a unit and category it is asked about, with ``locate`` and ``payload``, the characters sent."""
    rows = units.select(*(c for c in units.columns if c != "asked"), F.explode("asked").alias("category"))
    asked = cats.select(F.col("name").alias("category"), "locate", X.json_string_chars(F.col("locate")).alias("locate_chars"))
    rows = rows.join(F.broadcast(asked), "category")
    # {"s0": "... Candidate: `candidates[0]`", ...}: key and question each hold the number, of 1 digit, of 2 from ten on, ..
    n = F.size("spans")
    digits = n + sum((F.greatest(n - 10**k, F.lit(0)) for k in range(1, 9)), F.lit(0))
    chars = n * (len('"s": ') + F.col("locate_chars") + len(" Candidate: `candidates[]`")) + 2 * digits + 2 * n
    return rows.withColumn("payload", F.col("state_chars") + chars).drop("locate_chars")


def locate_skips(units: DataFrame, cats: DataFrame, limit: int = LOCATE_CHARS) -> DataFrame:
    """Units too large to be asked about their sentences, for each category."""
    return _skipped(_with_payload(units.select(*AT, "asked", "spans", "state_chars"), cats).where(F.col("payload") > limit), "locate_state_too_large", category=F.col("category"))


def locate_requests(units: DataFrame, analyzed: DataFrame, cats: DataFrame, limit: int = LOCATE_CHARS) -> DataFrame:
    """One row a unit of flagged_units and category that fits: state, candidates (line, col, text), their places as spans
    and questions.

    Each sentence is asked about by its number. A block's heading, context and body are its state, or the masked document.
    """
    rows = _unit_lines(units, analyzed)
    text = lambda s: F.substring(F.get("all_lines", s["line"] - 1), s["col"] + 1, s["chars"])
    candidates = F.transform("spans", lambda s: F.struct(s["line"].alias("line"), s["col"].alias("col"), text(s).alias("text")))
    state = ["heading", "context", "body", "document"]
    rows = rows.select(*AT, "scope", "block", "asked", "spans", "state_chars", *state, candidates.alias("candidates"))
    rows = _with_payload(rows, cats).where(F.col("payload") <= limit)
    number = F.sequence(F.lit(0), F.size("spans") - 1)
    question = lambda k: F.struct(F.concat(F.lit("s"), k).alias("key"), k.alias("cand"), F.concat(F.col("locate"), F.lit(" Candidate: `candidates["), k, F.lit("]`")).alias("question"))
    return rows.select(*UNIT, "of", "category", *state, "candidates", "spans", F.transform(number, question).alias("questions"), "payload")


def located_probabilities(answered: DataFrame, values: tuple[str, ...] = ("prob",)) -> DataFrame:
    """(doc_id, scope, block, category, cand, line, col, chars, values..): a row a sentence asked about, from
    answered(doc_id, of, category, probs), whose probs hold cand, the place and the values."""
    scope, block = F.when(F.col("of") < 0, "document").otherwise("block").alias("scope"), F.when(F.col("of") >= 0, F.col("of")).alias("block")
    rows = answered.select("doc_id", scope, block, "category", F.explode("probs").alias("x"))
    return rows.select(*UNIT, "category", "x.cand", "x.line", "x.col", "x.chars", *(f"x.{v}" for v in values))


WHOLE = -1  # chars of a row that stands for all of its lines


def span_texts(rows: DataFrame, analyzed: DataFrame, line: str = "line") -> DataFrame:
    """rows(doc_id, line, col, chars, ..) with ``text`` in place of ``chars``; with an ``end``, WHOLE chars are the lines up to it.

    Rows stream past their document's lines, where both lie by doc_id; a text is cut at once, and no row takes lines along.
    """
    text = F.substring(F.get("lines", F.col(line) - 1), F.col("col") + 1, F.col("chars"))
    if "end" in rows.columns:
        text = F.when(F.col("chars") == WHOLE, F.array_join(F.slice("lines", F.col(line), F.col("end") - F.col(line) + 1), "\n")).otherwise(text)
    return rows.join(analyzed.select("doc_id", "lines"), "doc_id").select(*(c for c in rows.columns if c != "chars"), text.alias("text"))


def question_chunks(questions: DataFrame, unit: list[str], order: str, size: int = QUESTIONS) -> DataFrame:
    """questions with ``chunk``, the request that carries them: ``size`` questions of a unit each, in order."""
    return questions.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*unit).orderBy(order)) - 1) / size).cast("int"))


def state_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a state as canonical JSON: fields (given as JSON texts) in the order of their names."""
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), fields[name]) for name in sorted(fields)))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def input_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
