"""Golden line arrays for masks, pairs, windows, blocks and sentences."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoscan.functions import text as X
from versoscan.operators import blocks as B
from versoscan.operators import requests as R
from versoscan.operators import structure as S

FM, CODE, TABLE = S.FRONT_MATTER, S.CODE, S.TABLE


@pytest.mark.parametrize(
    ("lines", "kinds"),
    [
        (["---", "title: x", "---", "本文。", "| a | b |", "```", "code", "```", "次の文。"], [FM] * 3 + [None, TABLE] + [CODE] * 3 + [None]),
        (["---", "title: x", "本文"], [None] * 3),
        (["~~~", "a", "b"], [CODE] * 3),
        (["\t```", "a"], [None] * 2),
        (["````", "```", "````", "x"], [CODE] * 3 + [None]),
        (["``` a`b", "x"], [None] * 2),
        (["```", "``` x", "```", "y"], [CODE] * 3 + [None]),
        (["  | a", "　| b"], [TABLE] * 2),
        ([""], [None]),
    ],
)
def test_kinds(lines, kinds):
    assert S.line_kinds(lines) == kinds


@pytest.mark.parametrize(
    ("lines", "pairs"),
    [
        (["a", "", "b", "c", "", "d"], [(0, 2), (2, 3), (3, 5)]),
        (["- a", "- b", "- c", "text", "- d"], [(2, 3), (3, 4)]),
        (["- a", "", "- b", "", "para"], [(0, 2), (2, 4)]),
        (["- a", "* b", "1. c", "2. d", "1) e", "2) f"], [(0, 1), (1, 2), (3, 4)]),
        (["1. 手順", "  - 項目"], [(0, 1)]),
        (["1. 手順", "   - 項目"], []),
        (["- a", " - b", "  - c", "- d"], []),
        (["- a", "", "  text"], []),
        (["---", "a"], [(0, 1)]),
    ],
)
def test_pairs(lines, pairs):
    assert S.boundary_pairs(lines, S.line_kinds(lines))[0] == pairs


@pytest.mark.parametrize(
    ("lines", "kept"),
    [
        (["- a", "  ```", "  x", "  ```", "- b"], [(0, 4)]),
        (["- a", "  ```", "  x", "  ```", "", "- b"], []),
        (["- a", "```", "x", "```", "- b"], []),
    ],
)
def test_continuations(lines, kept):
    assert S.boundary_pairs(lines, S.line_kinds(lines))[1] == kept


def test_windows():
    long = "x" * 20_000
    assert S.pack_windows([long, long], [(0, 1)]) == ([], [(0, 1)])
    lines = ["a"] * 100
    windows, large = S.pack_windows(lines, [(i, i + 1) for i in range(99)])
    assert not large and [len(w["pairs"]) for w in windows] == [30, 30, 30, 9]
    assert (windows[1]["start"], windows[1]["end"]) == (10, 80)
    fence = ["a", "b", "```", "x" * 50_000, "```", "c", "d"]
    windows, large = S.pack_windows(fence, S.boundary_pairs(fence, S.line_kinds(fence))[0])
    assert not large and all(not w["start"] <= 3 <= w["end"] for w in windows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "- b", "  - c", "  d", "1. e", "```", "| t", "---", "* f"]), min_size=1, max_size=25))
def test_pairs_are_consecutive_prose(lines):
    kinds = S.line_kinds(lines)
    pairs, kept = S.boundary_pairs(lines, kinds)
    prose = [i for i, x in enumerate(lines) if x.strip() and kinds[i] is None]
    following = set(zip(prose, prose[1:]))
    assert set(pairs) | set(kept) <= following and not set(pairs) & set(kept)
    assert all(all(kinds[k] is None for k in range(i, j)) for i, j in pairs)
    windows, large = S.pack_windows(lines, pairs, budget=12)
    assert [(p["i"], p["j"]) for w in windows for p in w["pairs"]] == [p for p in pairs if p not in large]


def test_split_lines_and_json_chars(spark):
    import json

    values = ["", "a", "a\n", "a\r\nb\x0bc\x1cd e", "\n\n", 'q"\\\t\x01é😀', None]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(X.split_lines(F.col("t")).alias("l"), X.json_string_chars(F.coalesce("t", F.lit(""))).alias("n"), X.json_strings_chars(X.split_lines(F.col("t"))).alias("m")).collect()
    assert [r.l for r in rows] == [(v or "").splitlines() or [""] for v in values]
    assert [r.n for r in rows] == [len(json.dumps(v or "", ensure_ascii=False)) for v in values]
    assert [r.m for r in rows] == [len(json.dumps((v or "").splitlines() or [""], ensure_ascii=False)) for v in values]


def test_json_chars_of_every_character(spark):
    import json

    values = [chr(k) for k in range(0x11000) if not 0xD800 <= k < 0xE000] + ["a\x00\n\"\\\x7f é😀" * 900]
    n = spark.createDataFrame([(v,) for v in [*values, None]], "t string").select("t", X.json_string_chars(F.col("t")).alias("n"))
    assert {r.t: r.n for r in n.collect()} == {v: len(json.dumps(v, ensure_ascii=False)) for v in values} | {None: None}
    assert "regexp_replace" not in n._jdf.queryExecution().optimizedPlan().toString()  # 15 times slower on states


def test_masked_slices_are_cut_once(spark):
    """The mask of a block's lines takes time in proportion to them: no slice stands within the lambdas over lines."""
    lines, kinds = [f"l{k}" for k in range(9)], [None, "a", "a", "b", None, "a", "a", "a", None]
    df = spark.createDataFrame([(lines, kinds)], "lines array<string>, kinds array<string>")
    masks = df.select(S.masked_slice(F.col("lines"), F.col("kinds"), F.lit(3), F.lit(8)).alias("m"), S.masked_text(F.col("lines"), F.col("kinds")).alias("w"))
    assert masks.first() == ("[除外: a]\n[除外: b]\nl4\n[除外: a]", "l0\n[除外: a]\n[除外: b]\nl4\n[除外: a]\nl8")
    assert masks.select("m")._jdf.queryExecution().optimizedPlan().toString().count("slice(") == 2


def test_forced_cuts_are_found_in_a_narrow_pass(spark):
    """As by windows over all lines and a join, but nothing is sorted or shuffled."""
    parts = ["文。", "", "- 項目\n  ```\n  x\n  ```\n  続き", "```", "x", "  続き", "| a |", "- 二", "1. 一", "  ```", "文"]
    texts = ["\n".join(parts[(d * 7 + p * (d % 5 + 1)) % len(parts)] for p in range(d % 30)) for d in range(300)]
    shape = S.analyze(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    cuts = B.forced_cuts(shape)
    gaps = S.line_pairs(S.lines_of(shape)).where("masked_between").select("doc_id", "i", "j")
    want = gaps.join(S.pairs_of(shape, "continuations"), ["doc_id", "i", "j"], "left_anti").select("doc_id", "j").collect()
    assert len(want) > 100 and shape.where("size(continuations) > 0").count() and sorted(cuts.collect()) == sorted(want)
    plan = cuts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan


def test_item_paths():
    lines = ["- a", "  - b", "  - c", "", "    text", "1. d", "x"]
    paths = S.item_paths(lines, S.line_kinds(lines))
    assert [[(i.began, i.marker, i.content) for i in p] for p in paths] == [[(0, "-", 2)], [(0, "-", 2), (1, "-", 4)], [(0, "-", 2), (1, "-", 4)], [(0, "-", 2), (1, "-", 4)], [(0, "-", 2), (1, "-", 4)], [(0, "ordered.", 3)], []]


def test_json_strings(spark):
    import json

    values = ["", 'q"\\/', "".join(map(chr, range(40))), "é😀\u2028\x7f"]
    row = spark.createDataFrame([(values,)], "v array<string>").select(X.json_strings(F.col("v")).alias("j"), R.state_hash({"lines": X.json_strings(F.col("v")), "a": X.json_string(F.lit("x"))}).alias("h")).first()
    import hashlib

    assert row.j == json.dumps(values, ensure_ascii=False)
    assert row.h == hashlib.sha256(json.dumps({"lines": values, "a": "x"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_masked_text(spark):
    shape = S.analyze(docs(spark, "| a\n```\nx\n```\n| b\n| c\nz", "", None))
    assert [r.masked for r in R.masked_documents(shape).orderBy("doc_id").collect()] == [f"[除外: {TABLE}]\n[除外: {CODE}]\n[除外: {TABLE}]\nz", "", ""]


def test_blocks_of_fifty_lines(spark):
    shape = S.analyze(docs(spark, "\n".join(f"b{i}" for i in range(50))))
    answer = lambda q: F.struct(q["key"].alias("key"), F.when(q["i"] == 30, 0.9).otherwise(0.1).alias("prob"))
    answered = S.boundary_requests(shape).withColumn("answers", F.transform("questions", answer))
    cuts = B.boundary_cuts(answered).unionByName(B.forced_cuts(shape))
    found = B.build_blocks(shape, B.block_ids(shape, cuts)).orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [(1, 31), (32, 50)] and found[1].text.startswith("b31\n")
    states = B.block_states(shape, cuts).orderBy("start").collect()
    assert [(r.start, r.end, r.text, r.body) for r in states] == [(r.start, r.end, r.text, r.text) for r in found]
    assert [r.context for r in states] == ["", "\n".join(f"b{i}" for i in range(31))] and [r.heading for r in states] == ["", ""]
    with pytest.raises(Exception, match="no answer to question b0"):
        B.boundary_cuts(answered.withColumn("answers", F.slice("answers", 2, 5))).collect()


def test_sentences_heading_and_context(spark):
    shape = S.analyze(docs(spark, "# 題 #\n一文目。 二文目。\n\n- 箇条書きA。B\n```\n# x\n```\n終"))
    lines = S.lines_of(shape)
    got = [(r.idx, r.n, r.col, r.text) for r in S.sentence_candidates(lines).orderBy("idx", "n").collect()]
    assert got == [(0, 0, 0, "# 題 #"), (1, 0, 0, "一文目。"), (1, 1, 5, "二文目。"), (3, 0, 0, "- 箇条書きA。B"), (7, 0, 0, "終")]
    block = spark.createDataFrame([(0, 0, 2, 4), (0, 1, 8, 8)], "doc_id long, block int, start int, end int")
    assert [r.heading for r in B.nearest_heading(lines, block).orderBy("block").collect()] == ["題 #", "題 #"]
    assert [r.context for r in B.preceding_context(shape, block, 12).orderBy("block").collect()] == ["# 題 #", "- 箇条書きA。B"]
    assert [r.context for r in B.preceding_context(shape, block, 4).orderBy("block").collect()] == [" 題 #", "きA。B"]
