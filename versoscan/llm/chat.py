"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; runs of one role are merged into blocks; blocks are
concatenated into one training text. User blocks stand between ``[INST]`` and ``[/INST]``, assistant blocks end with
``</s>``, blocks of any other role name it: ``[ROLE]system[TEXT]...[/ROLE]``. ``[NEXT]`` separates the turns that were
merged, so that every turn can be read back. A control string in a text or role gets a backslash after its first
character (``[INST]`` becomes ``[\\INST]``, ``[\\INST]`` becomes ``[\\\\INST]``), which reading takes out again; all
other text stays as it is.

The loss mask is a list of runs (loss, chars), in code points, that covers the formatted text: a run for each control
string and each text, empty texts have none. Texts of the assistant carry the loss, control strings never do.

Hot conversations, those with more than one in HOT_SHARE of all rows, are first collected in pieces of PIECE turn
numbers, over many tasks; their pieces are merged by the same expression as turns. There are at most HOT_SHARE of them.

Defined results: turns are sorted by turn, then role, then text, nulls first; a null text is empty and a null role the
role without a name; repeated rows are turns each; rows with a null conv_id make one conversation; an empty table gives
an empty result; columns of other names are left out. A formatted conversation is one value, so it is bounded by
Spark's 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm.shared import HOT_SHARE, table

PIECE = 256
LEAST_HOT = 1024  # turns that a conversation may always have
BEGIN, END, ASK, ASKED, ROLE, SAYS, SAID, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "[NEXT]"
CONTROL = r"(/?s>|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])"
BLOCK_ENDS = r"(?<=</s>|\[/INST\]|\[/ROLE\])"
PIECE_ENDS = r"(?<=</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]|\[NEXT\])|(?=</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]|\[NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(blocks: Column) -> Column:
    """Neighbouring structs (role, body, sizes) of one role made one: bodies joined by NEXT, sizes in one array.

    Runs start where the role differs from the one before; a run is a slice up to the next start, so the work is
    linear in the number of blocks.
    """

    def starts(of: Column) -> Column:
        role = lambda i: F.get(of, i)["role"]
        return F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def runs_of(of: Column, first: Column) -> Column:
        def run(start: Column, end: Column) -> Column:
            parts = lambda name: F.transform(F.slice(of, start + 1, end - start), lambda b: b[name])
            return F.struct(F.get(of, start)["role"].alias("role"), F.array_join(parts("body"), NEXT).alias("body"), F.flatten(parts("sizes")).alias("sizes"))

        return F.zip_with(first, F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(of))), run)

    return bound(blocks, lambda of: bound(starts(of), lambda first: runs_of(of, first)))


def turn_blocks(turns: Column) -> Column:
    """Sorted structs (turn, role, text) as blocks of one turn each."""

    def block(t: Column) -> Column:
        body = escape(t["text"])
        return F.struct(t["role"].alias("role"), body.alias("body"), F.array(F.length(body)).alias("sizes"))

    return F.transform(F.sort_array(turns), block)


def written(block: Column) -> Column:
    role, body = block["role"], block["body"]
    return (
        F.when(role == "user", F.concat(F.lit(ASK), body, F.lit(ASKED)))
        .when(role == "assistant", F.concat(body, F.lit(END)))
        .otherwise(F.concat(F.lit(ROLE), escape(role), F.lit(SAYS), body, F.lit(SAID)))
    )


def runs(block: Column) -> Column:
    """The loss mask of a block: runs of its control strings and its texts."""
    run = lambda loss, chars: F.struct((loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"), (chars if isinstance(chars, Column) else F.lit(chars)).alias("chars"))
    role, sizes = block["role"], block["sizes"]
    name = F.length(escape(role))
    head = F.when(role == "user", F.array(run(False, len(ASK)))).when(role == "assistant", F.array().cast("array<struct<loss:boolean,chars:int>>")).otherwise(F.array(run(False, len(ROLE)), run(False, name), run(False, len(SAYS))))
    texts = F.flatten(F.transform(sizes, lambda n, i: F.when(i == 0, F.array(run(role == "assistant", n))).otherwise(F.array(run(False, len(NEXT)), run(role == "assistant", n)))))
    tail = F.array(run(False, F.when(role == "user", len(ASKED)).when(role == "assistant", len(END)).otherwise(len(SAID))))
    return F.concat(head, texts, tail)


def format_chats(turns: DataFrame, least_hot: int = LEAST_HOT, piece: int = PIECE) -> DataFrame:
    """conv_id, formatted and mask of each conversation of turns(conv_id, turn, role, text).

    Texts are shuffled once, by conversation, and those of hot conversations once more in merged pieces. The hot ones
    are found from the rows' ids alone.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    most = max((n.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE, least_hot)
    hot = [r[0] for r in n.where(F.col("n") > most).select("conv_id").collect()]
    is_hot = F.col("conv_id").isin([h for h in hot if h is not None])
    is_hot = F.coalesce(is_hot, F.lit(None in hot))

    whole = (rows.where(~is_hot) if hot else rows).groupBy("conv_id").agg(merged(turn_blocks(F.collect_list("t"))).alias("blocks"))
    if hot:
        pieces = rows.where(is_hot).groupBy("conv_id", F.floor(F.col("t.turn") / piece).alias("piece")).agg(merged(turn_blocks(F.collect_list("t"))).alias("blocks"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("piece", "blocks"))), lambda p: p["blocks"])
        whole = whole.unionByName(pieces.groupBy("conv_id").agg(merged(F.flatten(listed)).alias("blocks")))
    mask = F.concat(F.array(F.struct(F.lit(False).alias("loss"), F.lit(len(BEGIN)).alias("chars"))), F.flatten(F.transform("blocks", runs)))
    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("blocks", written), "")).alias("formatted"),
        F.filter(mask, lambda r: r["chars"] > 0).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.filter(F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), BLOCK_ENDS, -1), lambda b: b != "")
    between = lambda b, before, after: F.substring(b, before + 1, F.length(b) - before - after)

    def turns(b: Column) -> Column:
        said = F.split(b, r"\[TEXT\]", 2)
        role = F.when(F.endswith(b, F.lit(ASKED)), F.lit("user")).when(F.endswith(b, F.lit(END)), F.lit("assistant")).otherwise(unescape(F.substring(said[0], len(ROLE) + 1, 2**31 - 1)))
        body = F.when(F.endswith(b, F.lit(ASKED)), between(b, len(ASK), len(ASKED))).when(F.endswith(b, F.lit(END)), between(b, 0, len(END))).otherwise(between(F.get(said, F.lit(1)), 0, len(SAID)))
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped; null if the mask's runs aren't those of the text's control strings and texts."""

    def under(pieces: Column) -> Column:
        fits = F.transform(pieces, lambda p: F.length(p)) == F.transform(mask, lambda r: r["chars"])
        both = F.zip_with(pieces, mask, lambda p, r: F.struct(p.alias("text"), r["loss"].alias("loss")))
        return F.when(fits, F.transform(F.filter(both, lambda x: x["loss"]), lambda x: unescape(x["text"])))

    return bound(F.filter(F.split(formatted, PIECE_ENDS, -1), lambda p: p != ""), under)


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")), said)
    chats = format_chats(turns.union(more))
    back, loss = read_turns(F.col("formatted")), F.array_join(read_loss(F.col("formatted"), F.col("mask")), "")
    text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", back.alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])', '\1\\\2\3', 'g')"
ORACLE = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)
),
e as (
  select *, length({ESCAPED.format("text")}) as chars, length({ESCAPED.format("role")}) as name,
         lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(chars) + sum(case when before = role then 6 else case role when 'user' then 13 when 'assistant' then 4 else 19 + name end end))::bigint as formatted_chars
from e group by conv_id
"""
