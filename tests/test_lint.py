"""The whole lint and the registered queries."""

import hashlib
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from versoscan.functions.tables import Tables
from versoscan.operators import evaluate as E
from versoscan.operators import judge as J
from versoscan.operators import rules
from versoscan.operators import violations as V
from versoscan.plans import inputs as I
from versoscan.operators.answers import AnswerStore
from versoscan.plans.lint import Judge, Limits, candidates_of, evaluate_thresholds, lint_corpus, places_of
from versoscan.sources import files

DATA = os.environ.get("VERSOSCAN_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def hash_lint(spark, docs, limits=None):
    return lint_corpus(docs, rules.read_ruleset(spark), I.hash_judge(), limits)


def reading_judge():
    """A judge that sees nothing but what is sent: the state, the candidates and the questions; and its rule."""

    def number(*parts):
        return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16) / 4294967296

    def answer(frame, one):
        state = lambda r: "\n".join(r["state"]) if "state" in frame else "#".join(str(r[c]) for c in ("heading", "context", "body", "document"))
        rows = [[{"key": q["key"], **one(state(r), r, q)} for q in r["questions"]] for _, r in frame.iterrows()]
        return pd.DataFrame({"answers": rows, "model": "m", "input_tokens": [len(state(r)) for _, r in frame.iterrows()], "output_tokens": frame["questions"].map(len)})

    boundary = lambda s, r, q: {"prob": number(s, q["question"])}
    score = lambda s, r, q: {"score": number(s, q["instruction"]) * (len(q["levels"]) - 1), "confidence": 0.5}
    sentence = lambda s, r, q: {"prob": number(s, r["candidates"][int(q["question"].split("[")[-1].rstrip("]`"))]["text"], q["question"])}
    return number, Judge(lambda q: J.judge_noul(q, lambda f: answer(f, boundary), 4), lambda q: J.judge_score(q, lambda f: answer(f, score), 4), lambda q: J.judge_noul(q, lambda f: answer(f, sentence), 4))


def test_lint_with_a_judge_that_reads(spark):
    """Every answer can be recomputed from the text alone; requests hold 50 questions at most; usage counts requests."""
    text = "# 題\n" + "\n".join(f"文{i}。続き{i}。" for i in range(70)) + "\n\n- 項目\n```\ncode\n```\n終わり。"
    docs = spark.createDataFrame([(0, text), (1, "短い文。"), (2, "```\nx\n```")], "doc_id long, text string")
    text_number, judge = reading_judge()
    found = lint_corpus(docs, rules.read_ruleset(spark), judge)
    asked = found.requests.collect()
    assert asked and all(1 <= len(r.questions) <= 50 for r in asked) and any(r.chunk > 0 for r in asked)
    question = {(r.doc_id, r.scope, r.block, r.category, q.cand): q.question for r in asked for q in r.questions}
    located = found.located.collect()
    assert len(located) == len(question)
    states = {(r.doc_id, r.scope, r.block): "#".join(str(r[c]) for c in ("heading", "context", "body", "document")) for r in asked}
    lines = text.splitlines()
    for r in located:
        assert r.prob == text_number(states[r.doc_id, r.scope, r.block], r.text, question[r.doc_id, r.scope, r.block, r.category, r.cand])
        assert r.doc_id or lines[r.line - 1][r.col :].startswith(r.text)
    calls = found.calls.groupBy("stage").count().collect()
    assert {c.stage: c["count"] for c in calls}["locate"] == len(asked) and found.calls.where("input_tokens is null").count() == 0
    windows = found.analyzed.select(F.sum(F.size("windows"))).first()[0]
    assert {c.stage: c["count"] for c in calls}["segment"] == windows


def test_no_text_is_kept_but_the_lines(spark):
    """Of the lint's tables only that of lines holds text; sentences are places in it, and come back as they were."""
    docs = spark.createDataFrame([(k, "# 題\n" + "\n".join(f"文{i}。続き{k}。" for i in range(40))) for k in range(6)], "doc_id long, text string")
    found = hash_lint(spark, docs)
    assert found.merged.count() and found.located.count()
    texts = lambda name: sorted(c for c, kind in spark.read.parquet(f"{found.tables.folder}/{name}").dtypes if "string" in kind)
    assert texts("blocks") == ["heading"] and texts("units") == ["asked", "heading", "scope"] and texts("sentences") == ["category", "model"] and texts("cuts") == ["model"]
    assert texts("scores") == ["answers", "model"]
    stored, text = found.tables.bytes(), docs.select(F.sum(F.octet_length("text"))).first()[0]
    long = spark.createDataFrame([(k, "\n".join(hashlib.md5(f"{k}.{i}".encode()).hexdigest() * 4 + "。" for i in range(400))) for k in range(20)], "doc_id long, text string")
    big = hash_lint(spark, long)
    big.merged.count()
    grown, grown_text = big.tables.bytes() - stored, long.select(F.sum(F.octet_length("text"))).first()[0] - text
    assert grown < 2 * grown_text
    found.tables.discard()
    assert found.tables.bytes() == 0


def test_answers_are_asked_once(spark, tmp_path):
    """Equal contents are one question; a second lint of the same corpus asks nothing and finds the same."""
    text = "# 題\n" + "\n".join(f"文{i}。続き{i}。" for i in range(70))
    docs = spark.createDataFrame([(0, text), (1, text), (2, "短い文。\n次の文。")], "doc_id long, text string")
    asked = spark.sparkContext.accumulator(0)
    _, inner = reading_judge()

    def counting(how):
        def fn(requests):
            @F.udf("boolean")
            def seen(_):
                asked.add(1)
                return True

            return how(requests.where(seen.asNondeterministic()(F.size("questions"))))

        return fn

    judge = Judge(counting(inner.boundaries), counting(inner.scores), counting(inner.sentences))
    store = AnswerStore(spark, str(tmp_path / "answers"))
    cats = rules.read_ruleset(spark)
    plain = lint_corpus(docs, cats, inner).merged.collect()
    first = lint_corpus(docs, cats, judge, store=store)
    rows = {r.stage: (r.requests, r.asked) for r in first.reused.collect()}
    assert sorted(map(str, first.merged.collect())) == sorted(map(str, plain))
    assert asked.value == sum(a for _, a in rows.values()) == first.calls.count()
    assert all(a < n for n, a in rows.values())  # documents 0 and 1 are equal
    before = asked.value
    second = lint_corpus(docs, cats, judge, store=store)
    assert sorted(map(str, second.merged.collect())) == sorted(map(str, plain))
    assert asked.value == before and second.calls.count() == 0
    assert {r.stage: (r.requests, r.asked) for r in second.reused.collect()} == {k: (n, 0) for k, (n, _) in rows.items()}
    changed = lint_corpus(docs.unionByName(spark.createDataFrame([(3, "新しい文。")], docs.schema)), cats, judge, store=store)
    assert changed.merged.where("doc_id < 3").count() == len(plain) and asked.value > before


def test_runs_are_compared_in_place(spark):
    tables = Tables(spark, "runs")
    schema = "doc_id long, scope string, start int, end int, col int, text string, category string, prob double"
    rows = [(d, "block", k, k, 0, f"t{k}", "c", d / 50) for d in range(50) for k in range(20)]
    a, b = (E.record_candidates(tables, n, spark.createDataFrame(rows, schema).withColumn("prob", F.col("prob") + shift)) for n, shift in (("a", 0.0), ("b", 0.1)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = E.matched_candidates(a, b)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 1000 and both.where("abs(new_prob - base_prob - 0.1) > 1e-9").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    tables.discard()


def test_findings_are_merged_in_place(spark):
    """Sentences meet by their place, where their document lies: a sweep shuffles sums, a merge nothing; both as by texts."""
    docs = spark.createDataFrame([(k, "# 題\n" + "\n".join(f"文{i}。続き{k}。" for i in range(9)) + "\n```\nx\n```\n同じ。同じ。") for k in range(20)], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = hash_lint(spark, docs)
        sweep = E.threshold_sweep(places_of(found), ("category",))
        moved = [x for x in str(sweep._jdf.queryExecution().executedPlan().toString()).splitlines() if "Exchange hash" in x]
        assert len(moved) == 1 and "hashpartitioning(category" in moved[0]
        assert sorted(sweep.collect()) == sorted(E.threshold_sweep(candidates_of(found), ("category",)).collect())
        by_text = V.merge_violations(found.violations).collect()
        assert by_text and sorted(map(str, by_text)) == sorted(map(str, found.merged.select(*V.COLUMNS).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found.tables.discard()


def test_threshold_evaluation_leaves_a_dump(spark, tmp_path):
    docs = spark.createDataFrame([(k, "\n".join(f"文{i}。続き{k}。" for i in range(30))) for k in range(4)], "doc_id long, text string")
    path = str(tmp_path / "dump")
    sweep = evaluate_thresholds(docs, rules.read_ruleset(spark), I.hash_judge(), path).collect()
    back = files.read_dump(spark, path)
    assert sorted(back) == ["calls", "candidates", "inputs", "thresholds"] and back["inputs"].count() == 4
    assert sorted(sweep) == sorted(E.threshold_sweep(back["candidates"]).collect())


def test_edge_documents(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "```\nx\n```"), (3, "一文。"), (4, "a\n" * 3)], "doc_id long, text string")
    found = hash_lint(spark, docs)
    assert {r.doc_id for r in found.skipped.where("reason = 'no_evaluable_prose'").collect()} == {0, 1, 2}
    assert {r.doc_id for r in found.blocks.select("doc_id").distinct().collect()} == {3, 4}
    assert hash_lint(spark, docs.limit(0)).merged.count() == 0


def test_oversize_units_are_skipped_whole(spark):
    docs = spark.createDataFrame([(0, "あ" * 50 + "。\nい。")], "doc_id long, text string")
    found = hash_lint(spark, docs, Limits(document=10, score=10))
    assert found.scores.count() == 0 and found.merged.count() == 0
    assert {r.reason for r in found.skipped.collect()} == {"state_too_large", "score_state_too_large"}


@needs_data
@pytest.mark.parametrize("name", ["score_flag_violations", "score_gate"])
def test_flags_of_units_look_for_no_sentences(spark, monkeypatch, name):
    """Findings about whole units come from the scores alone; the rows are those of the SQL."""

    def never(requests):
        raise AssertionError("asked about sentences")

    monkeypatch.setattr(I, "locate_answers", never)
    test_queries_equal_their_sql(spark, name)


@needs_data
def test_invariants(spark):
    found = hash_lint(spark, I.markdown(spark, DATA))
    blocks = found.blocks.orderBy("doc_id", "block").collect()
    assert blocks and all(b.start <= b.end for b in blocks)
    assert all(a.end < b.start for a, b in zip(blocks, blocks[1:]) if a.doc_id == b.doc_id)
    assert found.scores.where("score < 0 or score > 2").count() == 0
    assert found.merged.count() == found.violations.select("doc_id", "start", "end", "col", "category", "text").distinct().count()


def test_judge_keeps_rows(spark):
    questions = F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda k: F.struct(F.concat(F.lit("s"), k).alias("key")))
    asked = J.chunked(spark.range(60).select("id", questions.alias("questions")))
    assert asked.count() == 70 and asked.agg(F.max(F.size("questions"))).first()[0] == 50
    fn = lambda f: pd.DataFrame({"answers": [[{"key": q["key"], "prob": int(q["key"][1:]) / 60} for q in x] for x in f["questions"]], "model": "m", "input_tokens": 3, "output_tokens": 1})
    rows = J.judge_noul(asked, fn, 3).select("id", F.explode("answers").alias("a")).collect()
    assert sorted((r.id, r.a.prob) for r in rows) == [(i, k / 60) for i in range(60) for k in range(i + 1)]
    calls = J.record_calls(J.judge_noul(asked, fn).withColumn("req", F.col("id") % 2), ["req"]).collect()
    assert [(c.input_tokens, c.model) for c in calls] == [(3, "m")] * 2
    mixed = spark.createDataFrame([(0, "a", 1, 1), (0, "b", 1, 1)], "req int, model string, input_tokens long, output_tokens long")
    with pytest.raises(Exception, match="several models"):
        J.record_calls(mixed, ["req"]).collect()


@needs_data
@pytest.mark.parametrize("name", ["build_blocks", "boundary_candidates", "masked_text", "payload_chars", "boundary_report", "threshold_sweep", "choice_questions", "locate_requests", "read_ruleset", "state_hash", "judge_choice", "fail_under", "list_continuations", "forced_cuts", "merged_categories", "eval_dump", "reused_answers", "excluded_files", "run_exit_code", "matched_candidates"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    key = lambda d: sorted(json.dumps([None if pd.isna(v) else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_every_query_but_the_iterative_ones_has_sql():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {n for n in names - sql if not n.startswith("op") and n != "pipeline"} == set()


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["doc_id", "block", "start", "end", "text"]
