"""Evaluation arithmetic with exact values."""

import random

import pytest
from pyspark.sql import functions as F

from versoscan.operators import choices as C
from versoscan.operators import evaluate as E

OBS = "experiment string, grp string, doc string, i int, j int, rep int, p double"
LAB = "doc string, i int, j int, label string, note string"


def obs(spark, rows):
    return spark.createDataFrame([("x", "g", "d", i, i + 1, k, p) for i, ps in enumerate(rows) for k, p in enumerate(ps)], OBS)


def labels(spark, values):
    return spark.createDataFrame([("d", i, i + 1, v, n) for i, (v, n) in enumerate(values)], LAB)


def test_sweep(spark):
    rows = [(0, 1, 1, 0, "a", "block", "c", 0.59996), (0, 1, 1, 0, "a", "document", "c", 0.59996), (0, 2, 2, 0, "b", "block", "c", 0.7)]
    cands = spark.createDataFrame(rows, "doc_id long, start int, end int, col int, text string, scope string, category string, prob double")
    got = {r.threshold: (r.raw, r.merged) for r in E.threshold_sweep(cands).collect()}
    assert got == {0.5: (3, 2), 0.6: (1, 1), 0.7: (1, 1), 0.8: (0, 0)}


@pytest.mark.parametrize(("shift", "bad"), [(0.02, False), (0.04, True), (-0.06, True)])
def test_regression(spark, shift, bad):
    m = spark.range(10).select(F.lit(0.5).alias("base_prob"), (0.5 + F.when(F.col("id") < 6, shift).otherwise(0.0)).alias("new_prob"))
    assert E.regression_check(m).first().regression is bad


def test_matched_by_scope(spark):
    schema = "doc_id long, start int, end int, col int, text string, scope string, category string, prob double"
    a = spark.createDataFrame([(0, 1, 1, 0, "a", s, "c", p) for s, p in (("block", 0.1), ("document", 0.2))], schema)
    got = E.matched_candidates(a, a.withColumn("prob", F.col("prob") + 0.5)).collect()
    assert sorted((r.scope, round(r.new_prob - r.base_prob, 9)) for r in got) == [("block", 0.5), ("document", 0.5)]


def test_middle_values(spark):
    """Ties, one value, even and odd numbers, negative values and nulls against sorted lists."""
    r = random.Random(4)
    groups = {"a": [r.choice([0.1, 0.2, -3.0]) for _ in range(40)], "b": [r.random() for _ in range(301)], "c": [7.0], "d": [1.0, 2.0], "e": [5.0] * 9, "f": [None, 1.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {x.g: (x.n, x.lower, x.upper) for x in E.middle_values(rows, ("g",), "v").collect()}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[g] == (len(vs), vs[(len(vs) - 1) // 2], vs[len(vs) // 2])
    assert E.middle_values(rows.limit(0), (), "v").count() == 0


def test_medians_shuffle_few_values(spark):
    """Of very many distinct values only those around the middle are ranked: the window's input is a small part."""
    rows = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.rand(5).alias("v")).localCheckpoint()
    out = E.middle_values(rows, ("g",), "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "range_" in plan
    exact = {g: sorted(r.v for r in rows.where(F.col("g") == g).collect()) for g in (0, 1)}
    assert {r.g: (r.lower, r.upper) for r in out.collect()} == {g: (v[49_999], v[50_000]) for g, v in exact.items()}


def test_runs_matched_by_request(spark):
    """Answers to the same requests meet by cand, in any order; no text stands in the join."""
    schema = "doc_id long, chunk int, probs array<struct<cand:int,prob:double>>"
    a = spark.createDataFrame([(1, 0, [(0, 0.1), (1, 0.2)]), (2, 0, [(0, 0.3)])], schema)
    b = spark.createDataFrame([(1, 0, [(1, 0.9), (0, 0.8)]), (2, 0, [(5, 0.7)])], schema)
    got = {r.doc_id: [tuple(p) for p in r.probs] for r in E.matched_requests(a, b, ["doc_id", "chunk"]).collect()}
    assert got == {1: [(0, 0.1, 0.8), (1, 0.2, 0.9)], 2: []}


@pytest.mark.parametrize("values", ["outlier", "normal", "ties"])
def test_ranges_hold_equally_many_values(spark, values):
    """One value far away, or most values close together, leave no range with many of them."""
    v = {"outlier": F.when(F.col("id") == 7, 1e12).otherwise(F.rand(3)), "normal": F.randn(3), "ties": F.floor(F.rand(3) * 3).cast("double")}[values]
    rows = spark.range(100_000).select(F.lit("g").alias("g"), v.alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    sizes = [r[0] for r in E._in_ranges(counts, ("g",), "v").groupBy("range_").agg(F.count("*")).select("count(1)").collect()]
    assert max(sizes) <= 3 * max(1, sum(sizes) / E.RANGES)
    kept = sorted(r.v for r in rows.collect())
    got = E.middle_values(rows, ("g",), "v").first()
    assert (got.n, got.lower, got.upper) == (len(kept), kept[(len(kept) - 1) // 2], kept[len(kept) // 2])


def test_report_equals_its_measures(spark):
    """The one pass over pairs against each measure on its own."""
    r = random.Random(6)
    rows = [(e, g, d, i, i + 1, k, r.choice([0.1, 0.45, 0.5, 0.62, r.random()])) for e, g in (("E-E", "current"), ("E-C", "role")) for d in ("window", "design") for i in range(40) for k in range(3)]
    o = spark.createDataFrame(rows, OBS)
    lab = spark.createDataFrame([(d, i, i + 1, r.choice(["boundary", "continue", "either"]), r.choice(["見出し", ""])) for d in ("window", "design") for i in range(0, 40, 2)], LAB)
    got = {(x.experiment, x.part): x for x in E.boundary_report(o, lab).collect()}
    assert set(got) == {("E-E", "all"), ("E-E", "window"), ("E-E", "design"), ("E-E", "measured"), ("E-C", "all")}
    stats = E.pair_stats(o)
    labelled = E.with_labels(stats, lab)
    for (experiment, part), x in got.items():
        mine = (stats if part == "measured" else labelled).where(F.col("experiment") == experiment)
        mine = mine if part in ("all", "measured") else mine.where(F.col("doc") == part)
        mass, sd = E.band_mass(mine).first(), E.repeat_sd_summary(mine).first()
        assert (x.band_mass, x.band_mass_legacy, x.band_mass_pair_mean) == pytest.approx(tuple(mass)[2:])
        assert (x.n_pairs, x.sd_mean, x.sd_median, x.sd_max) == pytest.approx(tuple(sd)[2:])
        if part == "measured":
            assert (x.n_either, x.auc, x.brier, x.ece) == (None,) * 4
            continue
        counts = E.group_counts(mine).first()
        assert (x.n_pairs, x.n_obs, x.n_either, x.n_confirmed, x.n_contested) == tuple(counts)[2:]
        assert (x.auc, x.n_pos, x.n_neg) == pytest.approx(tuple(E.auc(mine).first())[2:])
        assert (x.auc_no_contested, x.brier, x.ece) == pytest.approx((E.auc(mine, contested=False).first().auc, E.brier(mine).first().brier, E.calibration_error(mine).first().ece))


def test_polarity_and_band(spark):
    got = spark.createDataFrame([(0.1, -1), (0.3, 1), (0.3, None)], "p double, s int").select(E.polarity(F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in got] == [0.9, 0.3, 0.3]
    mass = lambda *ps: E.band_mass(E.pair_stats(obs(spark, [[p] for p in ps]))).first()
    assert mass(0.9, 0.5, 0.5, 0.55).band_mass == 0.75 and mass(0.9, 0.4, 0.6, 0.55).band_mass == 0.25
    assert mass(0.4, 0.6, 0.59, 0.1).band_mass_legacy == 0.5


def test_auc_and_contested(spark):
    o = obs(spark, [[0.9], [0.8], [0.2], [0.99]])
    lab = labels(spark, [("boundary", ""), ("continue", "見出し"), ("continue", ""), ("either", "")])
    both = E.with_labels(E.pair_stats(o), lab)
    assert tuple(E.auc(both).first())[2:] == (1.0, 1, 2) and tuple(E.auc(both, contested=False).first())[2:] == (1.0, 1, 1)
    assert E.auc(both.where("label = 'boundary'")).first().auc is None


def test_auc_against_all_pairs(spark):
    r = random.Random(1)
    ps, ts = [round(r.random(), 1) for _ in range(60)], [r.random() < 0.5 for _ in range(60)]
    both = E.with_labels(E.pair_stats(obs(spark, [[p] for p in ps])), labels(spark, [("boundary" if t else "continue", "") for t in ts]))
    pos, neg = [p for p, t in zip(ps, ts) if t], [p for p, t in zip(ps, ts) if not t]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.auc(both).first().auc == pytest.approx(wins)
    ece = 0
    for b in range(10):
        k = [i for i, p in enumerate(ps) if b / 10 <= p < (b + 1) / 10 or (b == 9 and p == 1.0)]
        ece += abs(sum(ps[i] for i in k) - sum(ts[i] for i in k)) / 60
    assert E.calibration_error(both).first().ece == pytest.approx(ece)
    assert E.brier(both).first().brier == pytest.approx(sum((p - t) ** 2 for p, t in zip(ps, ts)) / 60)


def test_flips(spark):
    o = obs(spark, [[0.45, 0.55, 0.9], [0.1, 0.1, 0.1]])
    got = {r.threshold: r.flip for r in E.flip_curve(o, labels(spark, [("boundary", ""), ("continue", "")])).collect()}
    assert len(got) == 21 and (got[0.5], got[0.44], got[0.7]) == (0.5, 0.0, 0.5)


def test_runs(spark):
    schema = "run_id string, experiment string, doc string, rep int, variant string, polarity int, q int, model string, pairs array<struct<i:int,j:int>>, probs map<string,double>"
    rows = [("a", "E-E", "src", 0, "current", 1, None, "m1", [(5, 6)], {"b5": 0.4}), ("b", "E-E", "src", 1, "current", 1, None, "m1", [(5, 6)], {"b5": 0.4}), ("b", "E-E", "src", 1, "current", 1, None, "m2", [(6, 7)], {"b6": 0.4}), ("c", "E-C", "w", 0, "negative", -1, None, "m1", [(0, 1)], {"b0": 0.4}), ("d", "E-A", "w", 0, "current", 1, 20, "m1", [(0, 1)], {"b0": 0.4})]
    requests = spark.createDataFrame(rows, schema)
    assert [(r.run_id, r.models) for r in E.discarded_runs(requests).collect()] == [("b", ["m1", "m2"])]
    assert tuple(E.run_totals(requests).first()) == (4, 3, 1)
    got = {(r.experiment, r.grp, r.doc, r.i, r.p) for r in E.observation_series(requests, 2, "src").collect()}
    assert got == {("E-E", "current", "window", 3, 0.4), ("E-C", "negative", "window", 0, 0.6), ("E-A", "20", "window", 0, 0.4)}


def test_repeat_sd(spark):
    s = E.repeat_sd_summary(E.pair_stats(obs(spark, [[0.1], [0.2, 0.4], [0.1, 0.9], [0.5, 0.5]]))).first()
    assert (s.n, s.median) == (4, pytest.approx(0.1414, abs=1e-3)) and s.max == pytest.approx(0.5657, abs=1e-3)


def test_mean_deviation_does_not_hang_on_the_order(spark):
    stats = lambda values: spark.createDataFrame([("x", "g", float(v)) for v in values], "experiment string, grp string, sd double").coalesce(1)
    mean = lambda values: E.repeat_sd_summary(stats(values)).first()["mean"]
    assert mean([0.1] * 10) == 0.1  # added up as doubles, 0.09999999999999999
    assert mean([0.0, float("nan")]) != mean([0.0, float("nan")])


def test_cache_and_offset(spark):
    a = spark.createDataFrame([(0, 0.5), (1, 0.6)], "k int, prob double")
    b = spark.createDataFrame([(0, 0.5), (2, 0.6)], "k int, prob double")
    assert tuple(E.cache_check(a, b, ["k"]).first()) == (False, 2) and tuple(E.cache_check(a, a, ["k"]).first()) == (True, 0)
    rows = spark.createDataFrame([(["a", "b", "c", "b"], ["b"], 3), (["a", "b", "c"], ["b", "c"], 0), (["a"], ["z"], 0), (["a"], [], 0)], "d array<string>, w array<string>, f int")
    assert [r[0] for r in rows.select(E.window_offset(F.col("d"), F.col("w"), F.col("f"))).collect()] == [3, 1, None, None]


def test_shrink_state(spark):
    lines = spark.createDataFrame([("d", i, "x" * 20) for i in range(100)], "doc string, idx int, line string")
    ends = spark.createDataFrame([("d", i) for i in (10, 20, 30, 40)], "doc string, idx int")
    window = spark.createDataFrame([("d", 0, 99)], "doc string, start int, end int")
    kept = lambda b: sorted(r.idx for r in C.shrink_state(lines, ends, window, b).collect())
    assert len(kept(10**6)) == 100 and kept(1) == [10, 20, 30, 40]
    assert kept(500) == sorted(x + d for x in (10, 20, 30, 40) for d in (-2, -1, 0, 1, 2))


def test_choices(spark):
    pools = spark.createDataFrame([("d", "boundary", i * 10, i * 10 + 1) for i in range(4)] + [("d", "continue", i, i + 1) for i in range(7)], "doc string, label string, i int, j int")
    specs = C.choice_questions(pools, 3)
    rows = specs.orderBy("question", "slot").collect()
    by = {q: [r for r in rows if r.question == q] for q in range(3)}
    assert [len(by[q]) for q in range(3)] == [6, 6, 6] and [next(r.i for r in by[q] if r.label == "boundary") for q in range(3)] == [0, 10, 20]
    assert [sum(r.reused for r in by[q]) for q in range(3)] == [0, 3, 5] and not any(r.truncated for r in rows)
    answers = specs.where("label = 'boundary'").select("doc", "question", "slot", F.col("question").cast("double").alias("confidence"))
    assert tuple(C.choice_accuracy(specs, answers).first()) == (3, 3, False)
    assert [r.question for r in C.top_confidence(answers, 2).orderBy("place").collect()] == [2, 1]
    assert C.control_unchanged(answers, answers.limit(2)).first().unchanged is True
    asked = C.choice_requests(specs).orderBy("question").collect()
    assert [len(r.options) for r in asked] == [6, 6, 6] and [o.slot for o in asked[0].options] == list(range(6))
