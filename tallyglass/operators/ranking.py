"""Tie-aware ranking statistics of detectors: ROC, AUC with DeLong intervals, operating points.

Every statistic starts from a histogram of distinct scores per group (partial aggregation on the map side), so raw rows are
never ordered globally; cumulative counts run over distinct scores in ranges (``running_totals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import cut, running_totals

#: Fixed value: the two-sided 95 % normal quantile.
Z_95 = 1.959963984540054
#: Tolerance when a rate is held against a budget.
EPSILON = 1e-12


def histogram(scored: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``group, score, pos, neg``: how often each score was given to either class; rows without score or label are left out.

    A table that already has ``pos`` and ``neg`` is taken as such a histogram.
    """
    if {"pos", "neg"} <= set(scored.columns):
        return scored.select(*group, F.col(score).alias("score"), "pos", "neg")
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*group, F.col(score).alias("score")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))


def cumulated(hist: DataFrame, group: list[str]) -> DataFrame:
    """The histogram with ``pos_upto, neg_upto`` (at or below the score) and the group totals ``n_pos, n_neg``, ``has_nan``."""
    hist = cut(hist, "histogram")  # read three times
    upto = running_totals(hist, group, "score", {"pos_upto": "pos", "neg_upto": "neg"})
    keys = group or [F.lit(0).alias("_all")]
    total = hist.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.max(F.isnan("score")).alias("has_nan"))
    if not group:
        return upto.crossJoin(F.broadcast(total.drop("_all")))  # one row
    return upto.join(total, group)


def midranks(scored: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``group, score, n, midrank``: the mean 1-based rank of each distinct score, ties sharing theirs."""
    both = cumulated(histogram(scored, group, score, label), group)
    n, upto = F.col("pos") + F.col("neg"), F.col("pos_upto") + F.col("neg_upto")
    return both.select(*group, "score", n.alias("n"), (upto - (n - 1) / 2).alias("midrank"))


def auc(scored: DataFrame, group: list[str], z: float = Z_95, score: str = "score", label: str = "label") -> DataFrame:
    """``group, n_pos, n_neg, auc, se, low, high``: area under the curve, ties counting half, with its DeLong interval.

    ``auc`` is null where a class is empty or a score is NaN; the interval is null where a class has fewer than two rows or
    its placements don't vary in either class, and is clamped to [0, 1].
    """
    c = cumulated(histogram(scored, group, score, label), group)
    below = F.col("neg_upto") - F.col("neg")
    above = F.col("n_pos") - F.col("pos_upto")
    v10 = (below + F.col("neg") / 2) / F.col("n_neg")
    v01 = (above + F.col("pos") / 2) / F.col("n_pos")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    placed = c.withColumn("v10", F.when(ok & (F.col("pos") > 0), v10)).withColumn("v01", F.when(ok & (F.col("neg") > 0), v01))
    keys = group or [F.lit(0).alias("_all")]
    sums = placed.groupBy(*keys).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"), F.first("has_nan").alias("has_nan"),
        F.sum(F.col("pos") * F.col("v10")).alias("s10"), F.sum(F.col("pos") * F.col("v10") * F.col("v10")).alias("q10"),
        F.sum(F.col("neg") * F.col("v01")).alias("s01"), F.sum(F.col("neg") * F.col("v01") * F.col("v01")).alias("q01"),
        F.min("v10").alias("min10"), F.max("v10").alias("max10"), F.min("v01").alias("min01"), F.max("v01").alias("max01"),
    )

    def variance(q: str, s: str, n: str):
        return F.greatest(F.lit(0.0), (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))

    usable = (F.col("n_pos") > 1) & (F.col("n_neg") > 1) & ~((F.col("min10") == F.col("max10")) & (F.col("min01") == F.col("max01")))
    se = F.when(usable & ~F.col("has_nan"), F.sqrt(variance("q10", "s10", "n_pos") / F.col("n_pos") + variance("q01", "s01", "n_neg") / F.col("n_neg")))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & ~F.col("has_nan"), F.col("s10") / F.col("n_pos"))
    out = sums.select(*group, "n_pos", "n_neg", area.alias("auc"), se.alias("se"))
    return out.select(
        "*", F.when(F.col("se").isNotNull(), F.greatest(F.lit(0.0), F.col("auc") - z * F.col("se"))).alias("low"),
        F.when(F.col("se").isNotNull(), F.least(F.lit(1.0), F.col("auc") + z * F.col("se"))).alias("high"),
    )


def roc_points(scored: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``group, threshold, tp, fp, tpr, fpr``: one point per distinct score (flag when score >= threshold) and the origin,
    whose threshold is null. Groups with one class only have none."""
    c = cumulated(histogram(scored, group, score, label), group).filter("n_pos > 0 and n_neg > 0 and not has_nan")
    tp, fp = F.col("n_pos") - F.col("pos_upto") + F.col("pos"), F.col("n_neg") - F.col("neg_upto") + F.col("neg")
    points = c.select(*group, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (tp / F.col("n_pos")).alias("tpr"), (fp / F.col("n_neg")).alias("fpr"))
    keys = c.select(*group).distinct() if group else c.limit(1).select()
    zero = F.lit(0).cast("long")
    origin = keys.select(*group, F.lit(None).cast("double").alias("threshold"), zero.alias("tp"), zero.alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(origin)


def operating_points(scored: DataFrame, group: list[str], budgets: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Per group and budget the point with the highest tpr whose fpr is within it: ``budget, tpr, achieved_fpr, threshold``.

    Ties go to the lower fpr, then to the higher threshold (the curve's order). Where nothing fits, the origin does: tpr 0.
    A budget outside [0, 1] has null values. All budgets come from one pass, by conditional maxima.
    """
    points = roc_points(scored, group, score, label)
    high = F.coalesce("threshold", F.lit(float("inf")))
    best = []
    for i, b in enumerate(budgets):
        fits = F.col("fpr") <= b + EPSILON
        best.append(F.max(F.when(fits, F.struct("tpr", (-F.col("fpr")).alias("neg_fpr"), high.alias("high"), "threshold"))).alias(f"_b{i}"))
    keys = group or [F.lit(0).alias("_all")]
    wide = points.groupBy(*keys).agg(*best)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"_b{i}").alias("p")) for i, b in enumerate(budgets)]))
    valid = (F.col("o.budget") >= 0) & (F.col("o.budget") <= 1)
    return wide.select(*group, rows.alias("o")).select(
        *group, "o.budget", F.when(valid, F.col("o.p.tpr")).alias("tpr"), F.when(valid, -F.col("o.p.neg_fpr")).alias("achieved_fpr"), F.when(valid, F.col("o.p.threshold")).alias("threshold"),
    )


def fpr_resolution(counts: DataFrame, budgets: list[float], n_neg: str = "n_neg") -> DataFrame:
    """Adds per budget ``resolution`` (1 / negatives, infinite without any) and whether the budget can be expressed."""
    resolution = F.coalesce(F.try_divide(F.lit(1.0), n_neg), F.lit(float("inf")))
    budget = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")
    return counts.select("*", budget).withColumn("resolution", resolution).withColumn("expressible", F.col("resolution") <= F.col("budget") + EPSILON)


def findings(scored: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Per rankable group: whether all scores are identical, and the inverted AUC where it ranks the wrong way round."""
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    spread = known.groupBy(*group).agg(F.count("*").alias("n"), (F.min(score) == F.max(score)).alias("one_value"))
    areas = auc(scored, group, score=score, label=label).filter("auc is not null").select(*group, "auc")
    return spread.join(areas, group).select(
        *group, "n", "auc", (F.col("one_value") & (F.col("n") > 1)).alias("all_identical"), F.when(F.col("auc") < 0.5, 1 - F.col("auc")).alias("inverted")
    )


def shared_negatives(scored: DataFrame, by: list[str], arm: str = "arm", label: str = "label") -> DataFrame:
    """Rows for a per-arm analysis: each arm's positives against all negatives, per ``by``.

    Negatives are repeated per arm after they were counted: the result is a histogram ``by, arm, score, pos, neg``, so what is
    replicated are distinct scores, not rows. The other functions here take it in place of rows. Positives without an arm
    are left out.
    """
    hist = cut(histogram(scored, [*by, arm], label=label), "histogram")
    clean = hist.groupBy(*by, "score").agg(F.sum("neg").alias("neg")).filter("neg > 0")
    arms = hist.filter((F.col("pos") > 0) & F.col(arm).isNotNull()).groupBy(*by).agg(F.collect_set(arm).alias("_arms"))  # names of arms
    every = clean.join(arms, by) if by else clean.crossJoin(F.broadcast(arms))  # one row
    negatives = every.select(*by, F.explode("_arms").alias(arm), "score", F.lit(0).cast("long").alias("pos"), "neg")
    positives = hist.filter(F.col(arm).isNotNull() & (F.col("pos") > 0)).select(*by, arm, "score", "pos", F.lit(0).cast("long").alias("neg"))
    return positives.unionByName(negatives).groupBy(*by, arm, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def metrics_maps(points: DataFrame, group: list[str]) -> DataFrame:
    """Per group the maps budget text -> tpr, achieved fpr and threshold of ``operating_points``."""
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("%s", "budget"), c))))
    return points.groupBy(*group).agg(entry("tpr").alias("tpr_at_fpr"), entry("achieved_fpr").alias("fpr_achieved"), entry("threshold").alias("threshold_at_fpr"))


def refusal(requests: DataFrame, scores: str = "scores", labels: str = "labels", budgets: str = "budgets") -> DataFrame:
    """Adds ``status`` to metrics requests held as arrays: why they can't be ranked, or ``ok``. First reason wins."""
    s, y, b = F.col(scores), F.col(labels), F.col(budgets)
    status = (
        F.when(s.isNull() | y.isNull() | (F.size(s) != F.size(y)), "length-mismatch")
        .when(F.size(s) == 0, "empty")
        .when(F.exists(s, lambda x: x.isNull() | F.isnan(x)), "not-a-number")
        .when(F.forall(y, lambda x: x) | ~F.exists(y, lambda x: x), "one-sided")
        .when(F.exists(b, lambda x: F.isnan(x) | (x < 0) | (x > 1)), "budget-not-a-rate")
        .when(F.size(F.array_distinct(b)) != F.size(b), "duplicate-budget")
        .otherwise("ok")
    )
    return requests.withColumn("status", status)


def refusal_of_rows(rows: DataFrame, request: str, order: str, budgets: DataFrame, drop_errors: Column | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """``request, status`` as ``refusal`` gives, of requests held as rows, whatever their number.

    Scores and labels are the rows of a request in ``order`` (unique within it). Where ``drop_errors`` holds, rows without score
    are left out of the scores and the labels are cut to as many. ``budgets``: ``request, budgets`` (array), one row each.
    Nothing is collected: places are running counts over ranges, the rest are conditional counts.
    """
    drop = F.lit(False) if drop_errors is None else drop_errors
    slim = rows.select(request, order, score, label, F.lit(1).cast("long").alias("_one"))
    placed = running_totals(slim, [request], order, {"_place": "_one"}).withColumn("_drop", drop)
    size = cut(placed, "placed")
    counts = size.groupBy(request).agg(F.count(score).alias("_known"), F.count("*").alias("_all"), F.max("_drop").alias("_cut"))
    n = F.when(F.col("_cut"), F.col("_known")).otherwise(F.col("_all"))
    bad = F.col(score).isNull() & ~F.col("_cut") | F.coalesce(F.isnan(score), F.lit(False))
    used = F.col("_place") <= n
    per = size.join(counts, request).groupBy(request).agg(
        F.max(n).alias("_n"), F.count_if(bad).alias("_bad"), F.count_if(used & F.col(label)).alias("_pos"), F.count_if(used & ~F.col(label)).alias("_neg")
    )
    b = F.col("budgets")
    status = (
        F.when(F.col("_n") == 0, "empty").when(F.col("_bad") > 0, "not-a-number").when((F.col("_pos") == 0) | (F.col("_neg") == 0), "one-sided")
        .when(F.exists(b, lambda x: F.isnan(x) | (x < 0) | (x > 1)), "budget-not-a-rate").when(F.size(F.array_distinct(b)) != F.size(b), "duplicate-budget").otherwise("ok")
    )
    return per.join(budgets, request).select(request, status.alias("status"))
