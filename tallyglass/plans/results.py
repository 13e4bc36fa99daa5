"""Queries of results, reports and calibration, with their DuckDB counterparts."""

from __future__ import annotations

from functools import partial
from itertools import groupby

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyglass.functions import text as T
from tallyglass.operators import calibrate, integrity, pairing, ranking, report
from tallyglass.plans.base import LISTED_SQL, LONG_SQL, listed, long_scores
from tallyglass.plans.corpus import ORACLES as CORPUS
from tallyglass.plans.detection import ORACLES as DETECTION
from tallyglass.plans.detection import per_arm_auc_own_covers
from tallyglass.shared import cut
from tallyglass.sources.tables import table

#: The reference's null: draws, and the fold seeds that each draw and the observed cost are averaged over.
PERMUTATIONS, FOLD_SEEDS = 200, 20
#: Draws whose rows go to one task.
BLOCK = 26
#: The reference's power curve: shifts in deviations of the cell's scores, replicates at each, draws of a replicate's null.
SHIFTS, REPLICATES, POWER_DRAWS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45), 100, 100
#: Replicates whose rows go to one task.
REPLICATE_BLOCK = 70
#: Fold seeds whose rows go to one task.
SEED_BLOCK = 5


def results(spark, folder):
    """One result per arm and detector: facts of the arm, area with interval, answered and unanswered rows."""
    areas = per_arm_auc_own_covers(spark, folder)
    errors = long_scores(spark, folder).filter("label and arm is not null").groupBy("arm", "detector").agg(F.count_if(F.col("score").isNull()).alias("n_error"))
    facts = pairing.arm_facts(listed(spark, folder)).select("arm", "embedder", "rate", "unit", "domain")
    return areas.join(errors, ["arm", "detector"]).join(facts, "arm")


def report_rows(spark, folder):
    rows = report.mark_repeats(report.report_rows(results(spark, folder)), ["detector", "embedder", "arm_text"])
    return rows.select("detector", "arm", "embedder", "arm_text", "rate_key", "auc", "low", "high", "n_pos", "n_neg", "n_error", "flags", "repeats")


def report_lines(spark, folder):
    rows = report_rows(spark, folder).select("embedder", "arm_text", "detector", F.format_string("%.4f", "auc").alias("auc"), "flags")
    return report.csv_lines(rows, rows.columns)


def result_documents(spark, folder):
    """Sealed documents: JSON per result, with its digest."""
    docs = report.documents(results(spark, folder)).select("arm", "detector", "document")
    return docs.select("arm", "detector", integrity.seals(F.col("document")).alias("content_digest"))


def budgets_by_arm(spark, folder):
    rows = long_scores(spark, folder).filter("arm is not null or not label").select(F.coalesce("arm", F.lit("clean")).alias("arm"), "detector", "label", "score")
    pooled = ranking.operating_points(rows.filter("score is not null"), ["detector"], [0.05, 0.1])
    return pooled.select("detector", "budget", F.concat(report.budget_cell(F.col("tpr"), F.col("achieved_fpr"), 0.05), F.lit("")).alias("cell"))


def result_validation(spark, folder):
    points = ranking.operating_points(long_scores(spark, folder), ["detector"], [0.01, 0.1])
    maps = ranking.metrics_maps(points, ["detector"])
    areas = ranking.auc(long_scores(spark, folder), ["detector"])
    docs = areas.join(maps, "detector").withColumn("rate", F.lit(1.5)).withColumn("unit", F.lit("fraction")).withColumn("n_clean", F.col("n_neg")).withColumn("n_stego", F.col("n_pos"))
    return integrity.checked(docs, integrity.result_rules())


def nearest_names(spark, folder):
    return report.nearest_names(listed(spark, folder).filter("arm is not null"), "arm", "lsb-040")


def one_answer_columns(spark, folder):
    """Covers whose images all state one and the same side."""
    cells = listed(spark, folder).filter("stego").select(F.col("cover").alias("column"), F.col("side").alias("cell"))
    return report.one_answer(cells, "column", "cell")


def sign_test(spark, folder):
    tested = calibrate.sign_test(per_arm_auc_own_covers(spark, folder), ["detector"])
    return tested.withColumn("p", F.round("p", 9))


def wilson_interval(spark, folder):
    hits = long_scores(spark, folder).filter("score is not null").groupBy("detector", "label").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.5).alias("k"))
    low, high = calibrate.wilson("k", "n")
    return hits.select("detector", "label", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def cllr(spark, folder):
    """Cost of the raw scores read as odds."""
    lrs = long_scores(spark, folder).filter("score is not null").select("detector", "label", (F.col("score") / (F.lit(1.001) - F.least("score", F.lit(1.0)))).alias("lr"))
    return calibrate.cllr(lrs.filter("lr >= 0"), ["detector"]).withColumn("cllr", F.round("cllr", 9))


def bound_cost(spark, folder):
    return spark.createDataFrame([(b, round(calibrate.bound_cost(b), 12)) for b in (10.0, 100.0, 1000.0)], "bound double, cost double")


def verbal_band(spark, folder):
    lr = F.exp((F.col("score") - 0.5) * 12)
    rows = long_scores(spark, folder).filter("score is not null").select("label", calibrate.verbal(lr, lr >= 400).alias("band"))
    return rows.groupBy("label", "band").agg(F.count("*").alias("n"))


def power_crossing(spark, folder):
    """The lowest spa threshold-shift at which half of the stego images score above the clean mean, from a hit-rate curve."""
    base = long_scores(spark, folder).filter("score is not null and label")
    shifts = F.explode(F.array(*[F.lit(x / 10) for x in range(-5, 6)])).alias("x")
    curve = base.select("detector", shifts, "score").groupBy("detector", "x").agg(F.avg(F.when(F.col("score") + F.col("x") > 0.4, 1.0).otherwise(0.0)).alias("power"))
    return calibrate.crossing(curve, ["detector"], "x", "power", 0.5).withColumn("crossing", F.round("crossing", 9))


def _pairs(spark, folder):
    """``arm, detector, cover, stego, clean``: an arm's image and its cover's clean image, both scored."""
    rows = long_scores(spark, folder).filter("score is not null")
    clean = rows.filter("not label").groupBy("cover", "detector").agg(F.min("score").alias("clean"))
    pairs = rows.filter("label and arm is not null").groupBy("arm", "cover", "detector").agg(F.min("score").alias("stego")).join(clean, ["cover", "detector"])
    return cut(pairs.select("arm", "detector", "cover", "stego", "clean"), "pairs")


def _cells(spark, folder):
    """The pairs as rows of a calibration cell."""
    two = F.explode(F.array(F.struct(F.lit(True).alias("label"), F.col("stego").alias("score")), F.struct(F.lit(False).alias("label"), F.col("clean").alias("score"))))
    return _pairs(spark, folder).select("arm", "detector", "cover", two.alias("r")).select("arm", "detector", "cover", "r.label", "r.score")


def _decomposed(pdf, seeds):
    """The decomposition of a cell for each fold seed."""
    pdf = pdf.sort_values("cover", kind="stable")
    n = len(pdf)
    if n < calibrate.FOLDS:
        return [{"n": 2 * n, "cllr": None, "cllr_min": None, "cllr_cal": None} for _ in seeds]
    x, y, g = np.concatenate([pdf["stego"], pdf["clean"]]), np.repeat([True, False], n), np.tile(np.arange(n), 2)
    parts = [calibrate.decompose(calibrate.cross_validated(x, y, seed=s, groups=g), y) for s in seeds]
    return [{"n": 2 * n, "cllr": total, "cllr_min": floor, "cllr_cal": loss} for total, floor, loss in parts]


def cllr_decomposition(spark, folder):
    parts = calibrate.fan_out_blocks(_pairs(spark, folder), ["arm", "detector"], FOLD_SEEDS, SEED_BLOCK, _decomposed, "n int, cllr double, cllr_min double, cllr_cal double")
    return parts.groupBy("arm", "detector").agg(F.max("n").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("cllr", "cllr_min", "cllr_cal")], F.round(F.stddev_pop("cllr"), 9).alias("sd"))


def _costs(pdf, draws):
    """Cost of each draw's labels, averaged over the fold seeds; draw 0 has the true labels."""
    pdf = pdf.sort_values("cover", kind="stable")
    if len(pdf) < calibrate.FOLDS:
        return [{"cost": None} for _ in draws]
    flips = np.concatenate([np.zeros((1, len(pdf)), bool), calibrate.pair_flips(len(pdf), draws[-1])])[list(draws)]
    costs = calibrate.paired_costs(pdf["stego"].to_numpy(), pdf["clean"].to_numpy(), flips, FOLD_SEEDS)
    return [{"cost": round(float(c), 12)} for c in costs.mean(1)]  # without rounding, equal costs would differ in their last bits


def _null_draws(spark, folder):
    """``arm, detector, draw, null, observed`` of every cell: the averaged cost of each permutation beside that of the true labels."""
    costs = calibrate.fan_out_blocks(_pairs(spark, folder), ["arm", "detector"], PERMUTATIONS + 1, BLOCK, _costs, "cost double")
    observed = F.max(F.when(F.col("draw") == 0, F.col("cost"))).over(W.partitionBy("arm", "detector"))
    return costs.withColumn("observed", observed).filter("draw > 0").withColumnRenamed("cost", "null")


def permutation_pvalue(spark, folder):
    each = _null_draws(spark, folder).groupBy("arm", "detector").agg(calibrate.p_value("null", F.col("observed")).alias("p"), F.max("observed").alias("cllr"))
    few = F.col("cllr").isNull()
    verdict = F.when(few, "too few scored to calibrate").otherwise(calibrate.verdict("p", "cllr"))
    return each.select("arm", "detector", F.when(~few, F.round("p", 9)).alias("p"), F.round("cllr", 9).alias("cllr"), verdict.alias("verdict"))


def mde_summary(spark, folder):
    draws = _null_draws(spark, folder).filter("observed is not null")
    total = calibrate.null_summary(draws, ["arm", "detector"], "null", PERMUTATIONS, extra=[F.max("observed").alias("observed")])
    return total.select("*", *calibrate.effect_columns("observed"))


def _replicates(grid, draws, seeds, pdf, jobs):
    """One bootstrap replicate for each job, a place in the grid of numbers and shifts; null where there are too few pairs."""
    pdf = pdf.sort_values("cover", kind="stable")
    if len(pdf) < calibrate.FOLDS:
        return [{"x": None, "rejects": None} for _ in jobs]
    stego, clean = pdf["stego"].to_numpy(), pdf["clean"].to_numpy()
    done = []
    for rep, some in groupby((grid[j] for j in jobs), key=lambda job: job[0]):  # the shifts of a number share its flips
        shifts = [x for _, x in some]
        rejects = calibrate.rejections(stego, clean, shifts, [(0, rep, round(x * 1e6)) for x in shifts], draws, seeds=seeds, flip_seed=rep)
        done += [{"x": x, "rejects": r} for x, r in zip(shifts, rejects, strict=True)]
    return done


def _power_curve(spark, folder):
    """``arm, detector, x, hits, n, power``: share of the replicates that reject at each shift."""
    grid = [(rep, x) for rep in range(REPLICATES) for x in SHIFTS]
    done = calibrate.fan_out_blocks(_pairs(spark, folder), ["arm", "detector"], len(grid), REPLICATE_BLOCK, partial(_replicates, grid, POWER_DRAWS, FOLD_SEEDS), "x double, rejects boolean")
    curve = done.filter("x is not null").groupBy("arm", "detector", "x").agg(F.count("*").alias("n"), F.count_if("rejects").alias("hits"))
    return cut(curve.withColumn("power", F.col("hits") / F.col("n")), "power")


def power_curve(spark, folder):
    """Power of the permutation test by shift, with its Wilson interval, and the shifts at which it reaches 50, 80 and 95 % (null if never)."""
    curve = _power_curve(spark, folder)
    low, high = calibrate.wilson("hits", "n")
    shown = curve.select("arm", "detector", "x", "n", "hits", "power", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
    for level in (50, 80, 95):
        at = calibrate.crossing(curve, ["arm", "detector"], "x", "power", level / 100)
        shown = shown.join(at.select("arm", "detector", F.round("crossing", 9).alias(f"crossing_{level}")), ["arm", "detector"])
    return shown


def pav_calibration(spark, folder):
    """Isotonic fit of each arm and detector: its least and greatest probability and its number of steps. Only equal scores are ties."""

    def kernel(pdf, _):
        p = calibrate.pav(pdf["score"].to_numpy(), pdf["label"].to_numpy(float))
        return {"low": float(p.min()), "high": float(p.max()), "steps": len(np.unique(p.round(12)))}

    return calibrate.fan_out(_cells(spark, folder), ["arm", "detector"], 1, kernel, "low double, high double, steps int").drop("draw")


def ensemble_votes(spark, folder):
    """Fisher ensemble on the panel's scores, split by cover: held-out area per arm."""

    def kernel(pdf, seed):
        x, y = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy(bool)
        test = pdf["fold"].to_numpy() == 0
        if min(y[test].sum(), (~y[test]).sum(), y[~test].sum(), (~y[~test]).sum()) < 2:
            return {"n_test": int(test.sum()), "auc": None}
        votes = calibrate.FisherEnsemble(learners=11, sizes=(1, 2, 3), seed=seed).fit(x[~test], y[~test]).decision(x[test])
        return {"n_test": int(test.sum()), "auc": round(calibrate.rank_area(votes, y[test]), 9)}

    from tallyglass.operators.assign import hash_fold
    from tallyglass.plans.base import DETECTORS, scored

    rows = scored(spark, folder).filter(" and ".join(f"{d} is not null" for d in DETECTORS)).select("arm", "cover", "stego", F.array(*DETECTORS).alias("x"))
    stego, clean = rows.filter("stego and arm is not null"), rows.filter("not stego").drop("arm")
    owned = stego.select("arm", "cover").distinct().join(clean, "cover")
    both = stego.select("arm", "cover", F.lit(True).alias("label"), "x").unionByName(owned.select("arm", "cover", F.lit(False).alias("label"), "x"))
    return calibrate.fan_out(both.withColumn("fold", hash_fold("cover", 4)), ["arm"], 1, kernel, "n_test int, auc double").drop("draw")


QUERIES = {f.__name__: f for f in (
    results, report_rows, report_lines, result_documents, budgets_by_arm, result_validation, nearest_names, one_answer_columns, sign_test, wilson_interval, cllr, bound_cost, verbal_band, power_crossing,
    cllr_decomposition, permutation_pvalue, mde_summary, power_curve, pav_calibration, ensemble_votes,
)}

_OWN = DETECTION["per_arm_auc_own_covers"]
_FACTS = CORPUS["arm_inference"].replace(f"WITH {LISTED_SQL}, u AS", "u AS")
_RESULTS = _OWN[: _OWN.rindex("SELECT detector, arm, n_pos")] + f""", own_areas AS ({_OWN[_OWN.rindex("SELECT detector, arm, n_pos"):]}),
errs AS (SELECT arm, detector, count(*) FILTER (WHERE score IS NULL) AS n_error FROM long WHERE label AND arm IS NOT NULL GROUP BY 1, 2),
facts AS (WITH {_FACTS}), res AS (SELECT a.*, n_error, embedder, rate, unit, domain FROM own_areas a JOIN errs USING (arm, detector) JOIN facts USING (arm))
"""
_REPORT = _RESULTS + """, texts AS (SELECT *, CASE WHEN rate IS NULL OR unit IS NULL THEN embedder WHEN unit = 'bpp' THEN printf('%s at %.3f bpp', embedder, rate) ELSE printf('%s at %.3f%% of capacity', embedder, rate * 100) END AS arm_text,
CASE WHEN rate IS NULL OR unit IS NULL THEN '0-none' ELSE unit || '-' || lpad(printf('%.6f', rate), 16, '0') END AS rate_key,
array_to_string(list_filter([CASE WHEN auc < 0.5 THEN 'inverted' END, CASE WHEN low IS NULL THEN 'no interval' END, CASE WHEN low <= 0.5 AND high >= 0.5 THEN 'chance within interval' END,
CASE WHEN n_pos < 100 OR n_neg < 100 THEN 'few' END, CASE WHEN n_error > 0 THEN 'errors' END], lambda x: x IS NOT NULL), ', ') AS flags FROM res)
"""

ORACLES = {
    "sign_test": _OWN[: _OWN.rindex("SELECT detector, arm, n_pos")] + """, s AS (SELECT detector, count(*) FILTER (WHERE round(auc, 9) > 0.5) AS above, count(*) FILTER (WHERE round(auc, 9) < 0.5) AS below FROM areas GROUP BY 1)
SELECT detector, above, below, round(CASE WHEN above + below > 0 THEN least(1.0, 2 * list_sum(list_transform(range(least(above, below) + 1),
lambda i: exp(lgamma(above + below + 1) - lgamma(i + 1) - lgamma(above + below - i + 1) - (above + below) * ln(2))))) ELSE 1.0 END, 9) AS p FROM s""",
    "results": _RESULTS + "SELECT * FROM res",
    "report_rows": _REPORT + "SELECT detector, arm, embedder, arm_text, rate_key, auc, low, high, n_pos, n_neg, n_error, flags, count(*) OVER (PARTITION BY detector, embedder, arm_text) AS repeats FROM texts",
    "report_lines": _REPORT + """SELECT concat_ws(',', embedder, arm_text, detector, printf('%.4f', auc), CASE WHEN contains(flags, ',') THEN '"' || flags || '"' ELSE flags END) AS line FROM texts""",
    "nearest_names": f"WITH {LISTED_SQL}, d AS (SELECT DISTINCT arm, levenshtein(arm, 'lsb-040')::INT AS distance FROM listed WHERE arm IS NOT NULL) SELECT * FROM d WHERE distance <= 3 OR contains(arm, 'lsb-040') OR contains('lsb-040', arm) ORDER BY distance, arm LIMIT 3",
    "one_answer_columns": f'WITH {LISTED_SQL} SELECT cover AS "column", count(*) AS n, min(side) AS answer FROM listed WHERE stego GROUP BY 1 HAVING count(*) >= 2 AND count(side) = count(*) AND min(side) = max(side)',
    "wilson_interval": f"""WITH {LONG_SQL}, h AS (SELECT detector, label, count(*) AS n, count(*) FILTER (WHERE score > 0.5) AS k FROM long WHERE score IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, k / n AS p FROM h)
SELECT detector, label, n, k, round(greatest(0.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 9) AS low,
round(least(1.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 9) AS high FROM p""",
    "cllr": f"""WITH {LONG_SQL}, l AS (SELECT detector, label, score / (1.001::DOUBLE - least(score, 1.0)) AS lr FROM long WHERE score IS NOT NULL)
SELECT detector, round((avg(CASE WHEN label THEN CASE WHEN lr = 0 THEN 'inf'::DOUBLE ELSE ln(1 + 1 / lr) / ln(2) END END) + avg(CASE WHEN NOT label THEN ln(1 + lr) / ln(2) END)) / 2, 9) AS cllr FROM l WHERE lr >= 0 GROUP BY 1""",
    "bound_cost": "SELECT b::DOUBLE AS bound, round(log2(1 + 1 / b::DOUBLE), 12) AS cost FROM (SELECT unnest([10, 100, 1000]) AS b)",
    "verbal_band": f"""WITH {LONG_SQL}, l AS (SELECT label, exp((score - 0.5) * 12) AS lr FROM long WHERE score IS NOT NULL), s AS (SELECT label, lr, CASE WHEN lr >= 1 THEN lr ELSE 1 / lr END AS z FROM l),
t AS (SELECT label, CASE WHEN z >= 1000 THEN 0 WHEN z >= 100 THEN 1 WHEN z >= 10 THEN 2 WHEN z >= 2 THEN 3 ELSE 4 END AS i, lr >= 400 AS c FROM s)
SELECT label, ['very strong', 'strong', 'moderate', 'weak', 'no support'][1 + CASE WHEN c THEN least(i + 1, 4) ELSE i END] AS band, count(*) AS n FROM t GROUP BY 1, 2""",
    "power_crossing": f"""WITH {LONG_SQL}, c AS (SELECT detector, x / 10.0::DOUBLE AS x, avg((score + x / 10.0::DOUBLE > 0.4)::INT) AS power FROM long, (SELECT unnest(range(-5, 6)) AS x) WHERE score IS NOT NULL AND label GROUP BY 1, 2),
s AS (SELECT *, lag(x) OVER w AS px, lag(power) OVER w AS pp FROM c WINDOW w AS (PARTITION BY detector ORDER BY x))
SELECT detector, round(min(CASE WHEN pp < 0.5 AND power >= 0.5 THEN px + (0.5 - pp) / (power - pp) * (x - px) WHEN pp IS NULL AND power >= 0.5 THEN x END), 9) AS crossing FROM s GROUP BY 1""",
}
