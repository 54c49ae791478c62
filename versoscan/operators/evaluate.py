"""Measures over recorded judge answers: threshold sweeps, regressions between runs, and boundary calibration.

Observations are one long table obs(experiment, grp, doc, i, j, rep, p), p already turned so that high means a
boundary. Measures group by ``by`` columns. Labels grow with the documents, so joins with them are left to adaptive
execution, which broadcasts only what it has measured to be small. No pair of positives and negatives is ever formed,
and no group is sorted or gathered in one task: the AUC comes from counts of distinct values in RANGES ranges of about
equally many values of their group, prefix sums over the ranges, and ranks within a range; medians from counts of
the values below, around and above them and ranks within the part that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versoscan.functions.lineage import cut
from versoscan.functions.tables import Tables

# fixed values of the evaluation
THRESHOLDS = (0.5, 0.6, 0.7, 0.8)
FLIP_FROM, FLIP_TO, FLIP_STEP = 30, 70, 2  # hundredths
BAND, BINS = 0.1, 10
CONTESTED = "見出し"
MEDIAN_SHIFT, MOVED, MOVED_SHARE = 0.03, 0.05, 0.2
SIDE = 32
RANGES = SIDE * SIDE  # of a group's values
BROADCAST_ROWS = 100_000  # of a table with a few numbers a row
PLACE = ["start", "end", "col", "text", "category"]
CANDIDATE = ["doc_id", "scope", *PLACE]


def _with_few(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with ``few``, a table read back with a handful of rows a group: sent to all tasks but for very many groups."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on)


def _in_ranges(counts: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """counts, a row a distinct value, with ``range_``, the part of its group's values in which each lies.

    The ranges hold about equally many rows however the values lie: their ends are quantiles of the group's values, from
    sketches that each task makes of its own rows. Ends are looked up in two steps of SIDE.
    """
    shares = F.array(*(F.lit(k / RANGES) for k in range(RANGES)))
    ends = counts.groupBy(*by).agg(F.percentile_approx(value, shares, F.lit(10 * RANGES)).alias("ends_"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.slice("ends_", k * SIDE + 1, F.lit(SIDE)))
    ends = ends.select(*by, rows.alias("rows_"), F.transform(rows, lambda r: F.get(r, F.lit(0))).alias("firsts_"))
    upto = lambda column: F.size(F.filter(column, lambda e: e <= F.col(value)))
    row = F.greatest(upto("firsts_") - 1, F.lit(0))
    return counts.join(ends, list(by)).withColumn("row_", row).withColumn("range_", F.col("row_") * SIDE + upto(F.get("rows_", F.col("row_")))).drop("rows_", "firsts_", "row_")


def _before(counts: DataFrame, by: tuple[str, ...], value: str, *numbers: str) -> DataFrame:
    """counts, in ranges, with ``before_<number>``: the sum of each number over the lower values of the group."""
    per_range = counts.groupBy(*by, "range_").agg(*(F.sum(n).alias(n) for n in numbers))
    upto = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    lower = per_range.select(*by, "range_", *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"lower_{n}") for n in numbers))
    within = Window.partitionBy(*by, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(lower, [*by, "range_"])
    return placed.withColumns({f"before_{n}": F.col(f"lower_{n}") + F.coalesce(F.sum(n).over(within), F.lit(0)) for n in numbers}).drop(*(f"lower_{n}" for n in numbers))


def middle_values(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(by.., n, lower, upper): the values at the places floor((n - 1) / 2) and floor(n / 2) of each group in order.

    The values are read back three times and shuffled only where they can be the middle ones: sketches give bounds around
    the middle, counts of the three parts tell which of them hold the two places, and only these are counted and ranked.
    """
    if not by:
        return middle_values(rows.withColumn("all_", F.lit(0)), ("all_",), value).drop("all_")
    values = cut(rows.select(*by, value).where(F.col(value).isNotNull()))
    around = F.array(*(F.lit(share) for share in (0.49, 0.51)))
    bounds = cut(values.groupBy(*by).agg(F.percentile_approx(value, around, F.lit(1000)).alias("bounds_")))
    part = F.when(F.col(value) < F.get("bounds_", F.lit(0)), 0).when(F.col(value) <= F.get("bounds_", F.lit(1)), 1).otherwise(2)
    ranged = _with_few(values, bounds, list(by)).withColumn("range_", part).drop("bounds_")
    per_range = ranged.groupBy(*by, "range_").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)  # three rows
    placed = per_range.select(*by, "range_", "c", F.sum("c").over(group).alias("n"), F.coalesce(F.sum("c").over(group.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower_c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda before, k: (before <= k) & (k < before + F.col("c"))
    middle = cut(placed.where(holds(F.col("lower_c"), low) | holds(F.col("lower_c"), high)).drop("c"))  # at most two rows a group
    counts = _with_few(ranged, middle, [*by, "range_"]).groupBy(*by, "range_", "n", "lower_c", value).agg(F.count("*").alias("c"))
    before = F.col("lower_c") + F.coalesce(F.sum("c").over(Window.partitionBy(*by, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lambda k: F.max(F.when(holds(F.col("before_c"), k), F.col(value)))
    return counts.withColumn("before_c", before).groupBy(*by).agg(F.max("n").alias("n"), at(low).alias("lower"), at(high).alias("upper"))


def threshold_sweep(cands: DataFrame, by: tuple[str, ...] = (), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(by.., threshold, raw, merged): questions at or over each threshold, and findings after merging scopes.

    cands(doc_id, start, end, col, text, category, prob), or chars in place of text, which say the same within a document.
    One pass: counts for all thresholds at once, then unfolded.
    """
    merged = cands.groupBy("doc_id", *(c if c in cands.columns else "chars" for c in PLACE)).agg(F.max("prob").alias("top"), *(F.count_if(F.col("prob") >= t).alias(f"r{k}") for k, t in enumerate(thresholds)))
    sums = merged.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(f"r{k}").alias(f"r{k}") for k in range(len(thresholds))), *(F.count_if(F.col("top") >= t).alias(f"m{k}") for k, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"r{k}").alias("raw"), F.col(f"m{k}").alias("merged")) for k, t in enumerate(thresholds)))).alias("x")
    return sums.select(*by, "n", rows).select(*by, "n", "x.threshold", "x.raw", "x.merged")


def record_candidates(tables: Tables, name: str, cands: DataFrame) -> DataFrame:
    """The candidates of a run as a table of its own, in buckets by their place, so that runs are compared without a shuffle."""
    return tables.put(name, cands.select(*CANDIDATE, "prob"), *CANDIDATE)


def matched_candidates(base: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates of two runs at the same place and scope: (doc_id, .., base_prob, new_prob)."""
    return base.select(*CANDIDATE, F.col("prob").alias("base_prob")).join(new.select(*CANDIDATE, F.col("prob").alias("new_prob")), CANDIDATE)


def matched_requests(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs' answers (keys.., probs) to the same requests: (keys.., probs) with the base_prob and new_prob of each cand
    that both have, and the places that base's probs hold. Only numbers are shuffled; texts are looked up behind this."""
    at = [f.name for f in base.schema["probs"].dataType.elementType.fields if f.name in ("line", "col", "chars")]

    def one(p: Column, k: Column) -> Column:
        here = F.get("others", k)
        found = F.when(here["cand"] == p["cand"], here).otherwise(F.get(F.filter("others", lambda o: o["cand"] == p["cand"]), F.lit(0)))
        return F.struct(p["cand"].alias("cand"), *(p[c].alias(c) for c in at), p["prob"].alias("base_prob"), found["prob"].alias("new_prob"), found.isNotNull().alias("both"))

    rows = base.select(*keys, "probs").join(new.select(*keys, F.col("probs").alias("others")), keys)
    kept = F.filter(F.transform("probs", one), lambda x: x["both"])
    return rows.select(*keys, F.transform(kept, lambda x: x.dropFields("both")).alias("probs"))


def regression_check(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether the new run moved: a median shift over 0.03, or a fifth of the candidates moved 0.05 one way."""
    d = F.col("moved")
    moved = cut(matched.select(*by, (F.col("new_prob") - F.col("base_prob")).alias("moved")))
    middle = middle_values(moved, by, "moved").select(*by, ((F.col("lower") + F.col("upper")) / 2).alias("median_shift"))
    out = moved.groupBy(*by).agg(F.count("*").alias("n"), F.avg((d >= MOVED).cast("double")).alias("up"), F.avg((d <= -MOVED).cast("double")).alias("down"))
    out = (out.join(middle, list(by)) if by else out.crossJoin(middle)).select(*by, "n", "median_shift", "up", "down")  # without by both are one row
    return out.withColumn("regression", (F.abs("median_shift") > MEDIAN_SHIFT) | (F.col("up") >= MOVED_SHARE) | (F.col("down") >= MOVED_SHARE))


def polarity(prob: Column, sign: Column) -> Column:
    """The probability of a boundary; answers to a question of the other direction are turned round."""
    return F.when(F.coalesce(sign, F.lit(1)) == 1, prob).otherwise(1 - prob)


def discarded_runs(requests: DataFrame) -> DataFrame:
    """(run_id, models): runs whose requests were not all answered by one model."""
    found = requests.groupBy("run_id").agg(F.array_sort(F.collect_set("model")).alias("models"))
    return found.where(F.size("models") != 1)


def run_totals(requests: DataFrame) -> DataFrame:
    """One row: runs, requests of runs that count, discarded runs."""
    per_run = requests.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("model").alias("m"))
    return per_run.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("n"))), F.lit(0)).alias("requests"), F.count_if(F.col("m") != 1).alias("discarded"))


def group_name() -> Column:
    """The variant in E-C, the questions a request in E-A, else one group."""
    return F.when(F.col("experiment") == "E-C", F.col("variant")).when(F.col("experiment") == "E-A", F.col("q").cast("string")).otherwise("current")


def observation_series(requests: DataFrame, offset: int = 0, source: str | None = None) -> DataFrame:
    """The observations of recorded requests(run_id, experiment, doc, rep, variant, polarity, q, model, pairs, probs).

    Runs with mixed models are left out. In E-E, pairs of the document ``source`` are given as lines of the labelled
    window, ``offset`` lines further up, and other documents are called design; elsewhere all pairs are the window's.
    """
    bad = discarded_runs(requests).select("run_id")
    rows = requests.join(bad, "run_id", "left_anti").select("*", F.explode("pairs").alias("pair"))
    p = polarity(F.element_at("probs", F.concat(F.lit("b"), F.col("pair.i"))), F.col("polarity"))
    if source is None:
        doc, shift = F.col("doc"), F.lit(0)
    else:
        inside = (F.col("experiment") != "E-E") | (F.col("doc") == source)
        doc = F.when(inside, "window").otherwise("design")
        shift = F.when((F.col("experiment") == "E-E") & (F.col("doc") == source), offset).otherwise(0)
    return rows.select("experiment", group_name().alias("grp"), doc.alias("doc"), (F.col("pair.i") - shift).alias("i"), (F.col("pair.j") - shift).alias("j"), "rep", p.alias("p"))


def window_offset(doc_lines: Column, window: Column, first: Column) -> Column:
    """0-based line of the document at which the window stands: ``first`` if it is there, else its first place, else null; an
    empty window stands nowhere."""
    at = lambda k: F.slice(doc_lines, k + 1, F.size(window)) == window
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(doc_lines) - F.size(window), F.lit(0))), at)
    return F.when(F.size(window) > 0, F.when(at(first), first).otherwise(F.get(places, F.lit(0))))


def labeled_observations(obs: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    return obs.join(labels, ["doc", "i", "j"], how)


def labels_in_window(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    return labels.join(pairs, ["doc", "i", "j"], "left_semi")


def pair_stats(obs: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., doc, i, j, mean, n, sd, in_band, in_legacy): sample deviation, 0 of a single observation."""
    b = band(F.col("p"))
    return obs.groupBy(*by, "doc", "i", "j").agg(F.avg("p").alias("mean"), F.count("*").alias("n"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("sd"), F.sum(b.cast("int")).alias("in_band"), F.sum(legacy(F.col("p")).cast("int")).alias("in_legacy"))


def band(p: Column) -> Column:
    """Within 0.1 of one half, the bounds (also those that are so but for rounding) outside."""
    d = F.abs(p - 0.5)
    return (d < BAND) & ~(F.abs(d - BAND) <= 1e-9 * F.greatest(d, F.lit(BAND)))


def legacy(p: Column) -> Column:
    return (p >= 0.4) & (p < 0.6)


def exact_mean(value: str) -> Column:
    """The mean of doubles added up as decimals of 15 places, so that it doesn't hang on the order of the rows; NaN if one is NaN."""
    return F.when(F.isnan(F.max(value)), F.max(value)).otherwise(F.avg(F.when(~F.isnan(value), F.col(value)).cast("decimal(30,15)")).cast("double"))


def repeat_sd_summary(stats: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., n, mean, median, max) of the deviations; the median is the upper one."""
    sums = stats.groupBy(*by).agg(F.count("*").alias("n"), exact_mean("sd").alias("mean"), F.max("sd").alias("max"))
    return sums.join(middle_values(stats, by, "sd").select(*by, F.col("upper").alias("median")), list(by)).select(*by, "n", "mean", "median", "max")


def band_mass(stats: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., band_mass, band_mass_legacy, band_mass_pair_mean)."""
    total = F.sum("n")
    return stats.groupBy(*by).agg((F.sum("in_band") / total).alias("band_mass"), (F.sum("in_legacy") / total).alias("band_mass_legacy"), F.avg(band(F.col("mean")).cast("double")).alias("band_mass_pair_mean"))


def with_labels(stats: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """stats with label, note, truth (1 boundary, 0 continue, null else) and contested."""
    rows = stats.join(labels.select("doc", "i", "j", "label", "note"), ["doc", "i", "j"], how)
    truth = F.when(F.col("label") == "boundary", 1).when(F.col("label") == "continue", 0)
    return rows.withColumns({"truth": truth, "contested": F.coalesce((F.col("label") == "continue") & F.contains("note", F.lit(CONTESTED)), F.lit(False))})


def _auc(wins: str, pos: str, neg: str) -> Column:
    return F.when((F.col(pos) > 0) & (F.col(neg) > 0), F.col(wins) / (F.col(pos) * F.col(neg)))


def _auc_sums(labelled: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by.., wins, n_pos, n_neg, wins_sure, n_neg_sure): for all negatives and for those that aren't contested.

    Equal scores are counted first; a positive wins over the negatives of lower scores and half of those of its own.
    """
    negative = 1 - F.col("truth")
    scores = labelled.where("truth is not null").groupBy(*by, "mean").agg(F.sum("truth").alias("pos"), F.sum(negative).alias("neg"), F.sum(F.when(~F.col("contested"), negative).otherwise(0)).alias("sure"))
    placed = _before(_in_ranges(scores, by, "mean"), by, "mean", "neg", "sure")
    wins = lambda n: F.sum(F.col("pos") * (F.col(f"before_{n}") + F.col(n) / 2))
    return placed.groupBy(*by).agg(wins("neg").alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins("sure").alias("wins_sure"), F.sum("sure").alias("n_neg_sure"))


def auc(labelled: DataFrame, by: tuple[str, ...] = ("experiment", "grp"), contested: bool = True) -> DataFrame:
    """(by.., auc, n_pos, n_neg) of mean against truth: ties count half, null if a side is empty."""
    sums = _auc_sums(labelled, by)
    if contested:
        return sums.select(*by, _auc("wins", "n_pos", "n_neg").alias("auc"), "n_pos", "n_neg")
    return sums.where("n_pos + n_neg_sure > 0").select(*by, _auc("wins_sure", "n_pos", "n_neg_sure").alias("auc"), "n_pos", F.col("n_neg_sure").alias("n_neg"))


def brier(labelled: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    return labelled.where("truth is not null").groupBy(*by).agg(F.avg(F.pow(F.col("mean") - F.col("truth"), 2)).alias("brier"))


def bin_of(p: Column) -> Column:
    """The bin b with b / 10 <= p < (b + 1) / 10, compared with these bounds; 1.0 is in the last."""
    bounds = F.array(*(F.lit(b / BINS) for b in range(1, BINS)))
    return F.size(F.filter(bounds, lambda b: b <= p))


def calibration_error(labelled: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., ece): over ten equal bins, the weighted distance of mean confidence and accuracy."""
    bins = labelled.where("truth is not null").groupBy(*by, bin_of(F.col("mean")).alias("bin")).agg(F.sum("mean").alias("c"), F.sum("truth").alias("a"), F.count("*").alias("n"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def flip_curve(obs: DataFrame, labels: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., threshold, flip): share of confirmed pairs whose repeats fall on both sides of the threshold.

    All 21 thresholds are counted in one pass: only the least and the greatest p of a pair decide.
    """
    sure = labels.where("label in ('boundary', 'continue')").select("doc", "i", "j")
    pairs = obs.join(sure, ["doc", "i", "j"]).groupBy(*by, "doc", "i", "j").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    at = range(FLIP_FROM, FLIP_TO + 1, FLIP_STEP)
    sums = pairs.groupBy(*by).agg(*(F.avg(((F.col("low") < t / 100) & (F.col("high") >= t / 100)).cast("double")).alias(f"t{t}") for t in at))
    rows = F.explode(F.array(*(F.struct(F.lit(t / 100).alias("threshold"), F.col(f"t{t}").alias("flip")) for t in at))).alias("x")
    return sums.select(*by, rows).select(*by, "x.threshold", "x.flip")


def label_split_stats(labelled: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    """(by.., split, n_pairs, band_mass, sd_mean, sd_median, sd_max) for either and confirmed labels apart."""
    rows = labelled.withColumn("split", F.when(F.col("truth").isNotNull(), "confirmed").otherwise("either"))
    key = (*by, "split")
    mass = rows.groupBy(*key).agg((F.sum("in_band") / F.sum("n")).alias("band_mass"))
    sd = repeat_sd_summary(rows, key).select(*key, F.col("n").alias("n_pairs"), F.col("mean").alias("sd_mean"), F.col("median").alias("sd_median"), F.col("max").alias("sd_max"))
    return mass.join(sd, list(key))


def group_counts(labelled: DataFrame, by: tuple[str, ...] = ("experiment", "grp")) -> DataFrame:
    truth = F.col("truth")
    return labelled.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_obs"), F.count_if(F.col("label") == "either").alias("n_either"), F.count_if(truth.isNotNull()).alias("n_confirmed"), F.count_if("contested").alias("n_contested"))


def scoped(pairs: DataFrame) -> DataFrame:
    """Labelled pairs once for their group as a whole and, in E-E, once for their document; pairs of E-E, labelled or not,
    once more as measured. ``part`` is all, measured or the document."""
    none, own = F.array().cast("array<string>"), F.col("experiment") == "E-E"
    parts = F.concat(F.when(F.col("label").isNotNull(), F.array(F.lit("all"))).otherwise(none), F.when(F.col("label").isNotNull() & own, F.array("doc")).otherwise(none), F.when(own, F.array(F.lit("measured"))).otherwise(none))
    return pairs.select("*", F.explode(parts).alias("part"))


def _report_sums(pairs: DataFrame) -> DataFrame:
    """What can be summed of the report, by experiment, group and part, in one pass over the pairs: partial sums a bin of
    probability by grouping sets over (group), (group, document), each for labelled and for unlabelled pairs."""
    truth, mean = F.col("truth"), F.col("mean")
    rows = pairs.select(
        "experiment", "grp", F.when(F.col("experiment") == "E-E", F.col("doc")).alias("of"), F.col("label").isNotNull().alias("labelled"), F.when(truth.isNotNull(), bin_of(mean)).alias("bin"),
        "label", "truth", "contested", "mean", "n", "sd", "in_band", "in_legacy", band(mean).cast("int").alias("mean_in_band"), F.pow(mean - truth, 2).alias("off"),
    )
    key = ["experiment", "grp", "of", "labelled", "bin"]
    total = lambda c: F.sum(c).alias(c)
    parts = rows.groupingSets([["experiment", "grp", "labelled", "bin"], key], *key).agg(
        F.grouping("of").alias("whole"), F.count("*").alias("pairs"), total("n"), F.count_if(F.col("label") == "either").alias("either"), F.count("truth").alias("confirmed"), F.count_if("contested").alias("contested"),
        total("in_band"), total("in_legacy"), total("mean_in_band"), total("off"), F.sum(F.when(truth.isNotNull(), mean)).alias("sure_mean"), F.sum("truth").alias("sure_truth"), total("sd"), F.max("sd").alias("sd_max"),
    )
    # a handful of rows a group: each counts for the group's part, its document's, and for all that was measured
    whole, own = F.col("whole") == 1, F.col("experiment") == "E-E"
    part = F.array(F.when(whole & F.col("labelled"), F.lit("all")), F.when(~whole & F.col("labelled"), F.col("of")), F.when(whole & own, F.lit("measured")))
    parts = parts.select("*", F.explode(F.filter(part, lambda p: p.isNotNull())).alias("part"))
    known = lambda c: F.when(F.first("part") != "measured", c)
    n, pairs_ = F.sum("n"), F.sum("pairs")
    return parts.groupBy("experiment", "grp", "part").agg(
        pairs_.alias("n_pairs"), n.alias("n_obs"), known(F.sum("either")).alias("n_either"), known(F.sum("confirmed")).alias("n_confirmed"), known(F.sum("contested")).alias("n_contested"),
        (F.sum("in_band") / n).alias("band_mass"), (F.sum("in_legacy") / n).alias("band_mass_legacy"), (F.sum("mean_in_band") / pairs_).alias("band_mass_pair_mean"),
        (F.sum("sd") / pairs_).alias("sd_mean"), F.max("sd_max").alias("sd_max"), known(F.try_divide(F.sum("off"), F.sum("confirmed"))).alias("brier"),
        known(F.try_divide(F.sum(F.abs(F.col("sure_mean") - F.col("sure_truth"))), F.sum("confirmed").cast("double"))).alias("ece"),
    )


def boundary_report(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row an experiment, group and part with all measures; E-E also over all measured pairs (part measured).

    Observations are shuffled once, to pairs, and these are checkpointed. One pass over the pairs gives everything that
    can be summed; medians and the AUC take one more each, for the ranks.
    """
    by = ["experiment", "grp", "part"]
    pairs = cut(with_labels(pair_stats(obs), labels, "left"))
    rows = scoped(pairs)
    median = middle_values(rows, tuple(by), "sd").select(*by, F.col("upper").alias("sd_median"))
    ranks = _auc_sums(rows.where("part <> 'measured'"), tuple(by)).select(*by, _auc("wins", "n_pos", "n_neg").alias("auc"), "n_pos", "n_neg", _auc("wins_sure", "n_pos", "n_neg_sure").alias("auc_no_contested"))
    out = _report_sums(pairs).join(median, by, "left").join(ranks, by, "left")
    return out.select(*by, "n_pairs", "n_obs", "n_either", "n_confirmed", "n_contested", "band_mass", "band_mass_legacy", "band_mass_pair_mean", "sd_mean", "sd_median", "sd_max", "auc", "n_pos", "n_neg", "auc_no_contested", "brier", "ece")


def label_counts(labels: DataFrame) -> DataFrame:
    label = F.col("label")
    count = lambda v: F.count_if(label == v).alias(v)
    return labels.agg(F.count("*").alias("total"), count("boundary"), count("continue"), count("either"), F.count_if((F.col("doc") == "window") & label.isin("boundary", "continue")).alias("window_confirmed"))


def cache_check(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether two answers(keys.., prob) to the same requests are identical, and how many keys differ."""
    a, b = first.select(*keys, F.col("prob").alias("a")), second.select(*keys, F.col("prob").alias("b"))
    return a.join(b, keys, "full_outer").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("identical"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


def heading_rule_baseline(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: accuracy and precision of 'a block begins where the next line is a heading' on confirmed labels."""
    heads = lines.select(F.col("doc_id").cast("string").alias("doc"), F.col("idx").alias("j"), F.ltrim("line").startswith("#").alias("heading"))
    rows = labels.where("label in ('boundary', 'continue')").join(heads, ["doc", "j"]).select("heading", (F.col("label") == "boundary").alias("truth"))
    hit = F.col("heading") & F.col("truth")
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("heading") == F.col("truth")).cast("double")).alias("accuracy"), F.try_divide(F.count_if(hit).cast("double"), F.count_if("heading").cast("double")).alias("precision"))


def window_dispersion(answers: DataFrame, request: list[str]) -> DataFrame:
    return answers.groupBy(*request).agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("prob"), F.lit(0.0)).alias("sd"), F.min("prob").alias("least"), F.max("prob").alias("greatest"))


def request_plan(windows: DataFrame, labels: DataFrame, reps: dict[str, int], q: int = 10, variants: int = 5, qs: tuple[int, ...] = (1, 5, 20), group: int = 10) -> DataFrame:
    """(stage, requests): what each experiment would ask; -1 where there is nothing to ask; the total of the rest."""
    n = F.col("pairs")
    up = lambda a, b: F.ceil(a / b).cast("long")
    w = windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("asked"))
    both = w.crossJoin(labels.agg(F.count("*").alias("pairs")))
    some = lambda c, x: F.when(c > 0, x).otherwise(F.lit(-1))
    stages = {"E-E": F.col("windows") * reps["E-E"], "E-C": some(n, up(n, q) * variants * reps["E-C"]), "E-A": some(n, sum((up(n, x) for x in qs), F.lit(0)) * reps["E-A"]), "E-CHOICE": some(F.col("asked"), up(F.col("asked"), group) * reps["E-CHOICE"])}
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), v.cast("long").alias("requests")) for k, v in stages.items()))).alias("x")).select("x.*")
    return rows.unionByName(rows.agg(F.lit("total").alias("stage"), F.sum(F.greatest("requests", F.lit(0))).alias("requests")))
