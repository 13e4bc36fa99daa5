"""Queries of the detection analytics over the panel and the manifest, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import confusion, ranking
from tallyglass.plans.base import LONG_SQL, SCORED_SQL, long_scores, scored
from tallyglass.shared import cut
from tallyglass.sources.tables import table

BUDGETS = [0.01, 0.05, 0.1]


def _r(df, **digits):
    """Rounded columns: the last digits of a sum depend on its order."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def confusion_rates(spark, folder):
    judged = scored(spark, folder).select("arm", F.col("stego").alias("label"), confusion.says_positive(F.col("stegexpose"), 0.25, verdict=F.col("zsteg")).alias("predicted"))
    return _r(confusion.rates(confusion.tally(judged, ["arm"])), tpr=9, fpr=9, precision=9, accuracy=9, f1=9)


def midrank_table(spark, folder):
    return ranking.midranks(long_scores(spark, folder), ["detector"])


def auc_ties(spark, folder):
    return _r(ranking.auc(long_scores(spark, folder), ["detector"]).select("detector", "n_pos", "n_neg", "auc"), auc=9)


def auc_delong_ci(spark, folder):
    return _r(ranking.auc(long_scores(spark, folder), ["detector"]), auc=9, se=9, low=9, high=9)


def roc_points(spark, folder):
    return _r(ranking.roc_points(long_scores(spark, folder), ["detector"]), tpr=9, fpr=9)


def operating_points(spark, folder):
    return _r(ranking.operating_points(long_scores(spark, folder), ["detector"], BUDGETS), tpr=9, achieved_fpr=9)


def tpr_at_fpr_budgets(spark, folder):
    points = ranking.operating_points(long_scores(spark, folder), ["detector"], BUDGETS)
    return _r(points.select("detector", "budget", "tpr"), tpr=9)


def fpr_resolution(spark, folder):
    counts = long_scores(spark, folder).filter("score is not null").groupBy("detector").agg(F.count_if(~F.col("label")).alias("n_neg"))
    return _r(ranking.fpr_resolution(counts, [0.0001, 0.001, 0.01]), resolution=12)


def score_findings(spark, folder):
    return _r(ranking.findings(cut(long_scores(spark, folder), "long"), ["detector"]), auc=9, inverted=9)


def per_arm_auc_shared_clean(spark, folder):
    hist = ranking.shared_negatives(long_scores(spark, folder), ["detector"])
    return _r(ranking.auc(hist, ["detector", "arm"]), auc=9, se=9, low=9, high=9)


def per_arm_auc_own_covers(spark, folder):
    """Each arm against the clean rows of its own covers only, every cover once per arm."""
    rows = cut(long_scores(spark, folder).filter("score is not null"), "long")
    stego = rows.filter("label and arm is not null")
    clean = rows.filter("not label").select("cover", "detector", "score")
    wanted = stego.select("arm", "cover", "detector").distinct()
    negatives = wanted.join(clean, ["cover", "detector"]).select("arm", "detector", "score", F.lit(False).alias("label"))
    both = stego.select("arm", "detector", "score", "label").unionByName(negatives)
    return _r(ranking.auc(both, ["detector", "arm"]), auc=9, se=9, low=9, high=9)


def paired_covers(spark, folder):
    """Covers that both an arm's image and the clean image of this detector were scored for."""
    rows = cut(long_scores(spark, folder).filter("score is not null"), "long")
    clean = rows.filter("not label").select("cover", "detector", F.col("score").alias("clean_score"))
    pairs = rows.filter("label and arm is not null").join(clean, ["cover", "detector"])
    return pairs.groupBy("detector", "arm").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("cover").alias("n_covers"), F.count_if(F.col("score") == F.col("clean_score")).alias("identical"),
        F.round(F.avg(F.when(F.col("score") > F.col("clean_score"), 1.0).otherwise(0.0)), 9).alias("higher_share"),
    )


def hit_rates(spark, folder):
    known = scored(spark, folder).filter("zsteg is not null")
    return known.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("zsteg"), 1.0).otherwise(0.0)), 9).alias("hit_rate"))


def position_join_coalesce(spark, folder):
    """Scores joined to labels by identity: a verdict stands in only where no score exists, neither is an error."""
    value = F.coalesce("stegexpose", F.when(F.col("zsteg"), 1.0).when(~F.col("zsteg"), 0.0))
    rows = scored(spark, folder).withColumn("value", value)
    return rows.groupBy("stego").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_error"), F.count_if(F.col("stegexpose").isNull() & F.col("value").isNotNull()).alias("from_verdict"), F.round(F.avg("value"), 9).alias("mean_value"),
    )


def metrics_refusal_status(spark, folder):
    """Requests made of the panel per image batch, and why any can't be ranked."""
    request = F.pmod("panel_id", F.lit(50))
    rows = scored(spark, folder).select(request.alias("request"), "panel_id", F.col("aletheia_rs").alias("score"), F.col("stego").alias("label"))
    budget = F.when(F.col("id") % 7 == 0, F.array(F.lit(0.1), F.lit(0.1))).when(F.col("id") % 5 == 0, F.array(F.lit(1.5))).otherwise(F.array(F.lit(0.1)))
    asked = spark.range(50).select(F.col("id").alias("request"), budget.alias("budgets"))
    return ranking.refusal_of_rows(rows, "request", "panel_id", asked, F.col("request") % 3 == 0)


def error_rows(spark, folder):
    return scored(spark, folder).groupBy("aletheia_error").agg(F.count("*").alias("n"), F.count("aletheia_spa").alias("n_scored"))


def order_priority_auc(spark, folder):
    """At the size of the largest arm: returned lines against all others by quantity, per priority of their order, negatives shared."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("label"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    rows = lines.join(orders, "key").withColumn("arm", F.when(F.col("label"), F.col("priority")))
    return _r(ranking.auc(ranking.shared_negatives(rows, []), ["arm"]), auc=9, se=9, low=9, high=9)


QUERIES = {f.__name__: f for f in (
    confusion_rates, midrank_table, auc_ties, auc_delong_ci, roc_points, operating_points, tpr_at_fpr_budgets, fpr_resolution, score_findings, per_arm_auc_shared_clean,
    per_arm_auc_own_covers, paired_covers, hit_rates, position_join_coalesce, metrics_refusal_status, error_rows, order_priority_auc,
)}

_RATES = """round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS tpr, round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 9) AS fpr,
round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn) END, 9) AS accuracy,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"""


def _auc_sql(source: str, keys: str, head: str) -> str:
    """AUC and DeLong interval straight from ranks of the rows."""
    return f"""{head},
src AS (SELECT {keys}, score, label FROM {source} WHERE score IS NOT NULL AND label IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r,
                  rank() OVER (PARTITION BY {keys}, label ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, label, score) - 1) / 2.0 AS own,
                  count(*) FILTER (WHERE label) OVER (PARTITION BY {keys}) AS n_pos, count(*) FILTER (WHERE NOT label) OVER (PARTITION BY {keys}) AS n_neg FROM src),
placed AS (SELECT *, CASE WHEN label AND n_neg > 0 THEN (r - own) / n_neg END AS v10, CASE WHEN NOT label AND n_pos > 0 THEN 1 - (r - own) / n_pos END AS v01 FROM ranked),
sums AS (SELECT {keys}, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, avg(v10) AS auc, var_samp(v10) AS s10, var_samp(v01) AS s01,
                min(v10) = max(v10) AND min(v01) = max(v01) AS flat FROM placed GROUP BY {keys}),
areas AS (SELECT {keys}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN auc END AS auc,
                 CASE WHEN n_pos > 1 AND n_neg > 1 AND NOT flat THEN sqrt(s10 / n_pos + s01 / n_neg) END AS se FROM sums)
"""


_INTERVAL = "round(auc, 9) AS auc, round(se, 9) AS se, round(greatest(0.0, auc - 1.959963984540054 * se), 9) AS low, round(least(1.0, auc + 1.959963984540054 * se), 9) AS high"

_POINTS = f"""WITH {LONG_SQL},
src AS (SELECT detector, score, label FROM long WHERE score IS NOT NULL),
total AS (SELECT detector, count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg FROM src GROUP BY 1),
hist AS (SELECT detector, score, count(*) FILTER (WHERE label) AS pos, count(*) FILTER (WHERE NOT label) AS neg FROM src GROUP BY 1, 2),
points AS (SELECT detector, score AS threshold, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, sum(pos) OVER w / n_pos AS tpr, sum(neg) OVER w / n_neg AS fpr
           FROM hist JOIN total USING (detector) WINDOW w AS (PARTITION BY detector ORDER BY score DESC)
           UNION ALL SELECT detector, NULL, 0, 0, 0.0, 0.0 FROM total),
picked AS (SELECT detector, budget, tpr, fpr AS achieved_fpr, threshold, row_number() OVER (PARTITION BY detector, budget ORDER BY tpr DESC, fpr, threshold DESC NULLS FIRST) AS nth
         FROM points, (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS budget) WHERE fpr <= budget + 1e-12)
"""

ORACLES = {
    "confusion_rates": f"""WITH {SCORED_SQL}, judged AS (SELECT arm, stego AS label, coalesce(zsteg, stegexpose > 0.25) AS predicted FROM scored),
t AS (SELECT arm, count(*) FILTER (WHERE label AND predicted) AS tp, count(*) FILTER (WHERE NOT label AND predicted) AS fp,
             count(*) FILTER (WHERE NOT label AND NOT predicted) AS tn, count(*) FILTER (WHERE label AND NOT predicted) AS fn FROM judged GROUP BY 1) SELECT *, {_RATES} FROM t""",
    "midrank_table": f"""WITH {LONG_SQL}, r AS (SELECT detector, score, rank() OVER (PARTITION BY detector ORDER BY score) AS low FROM long WHERE score IS NOT NULL)
SELECT detector, score, count(*) AS n, any_value(low) + (count(*) - 1) / 2.0 AS midrank FROM r GROUP BY 1, 2""",
    "auc_ties": _auc_sql("long", "detector", f"WITH {LONG_SQL}") + "SELECT detector, n_pos, n_neg, round(auc, 9) AS auc FROM areas",
    "auc_delong_ci": _auc_sql("long", "detector", f"WITH {LONG_SQL}") + f"SELECT detector, n_pos, n_neg, {_INTERVAL} FROM areas",
    "roc_points": _POINTS + "SELECT detector, threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM points",
    "operating_points": _POINTS + "SELECT detector, budget, round(tpr, 9) AS tpr, round(achieved_fpr, 9) AS achieved_fpr, threshold FROM picked WHERE nth = 1",
    "tpr_at_fpr_budgets": _POINTS + "SELECT detector, budget, round(tpr, 9) AS tpr FROM picked WHERE nth = 1",
    "fpr_resolution": f"""WITH {LONG_SQL}, c AS (SELECT detector, count(*) FILTER (WHERE NOT label) AS n_neg FROM long WHERE score IS NOT NULL GROUP BY 1)
SELECT detector, n_neg, budget, round(1.0 / n_neg, 12) AS resolution, 1.0 / n_neg <= budget + 1e-12 AS expressible FROM c, (SELECT unnest([0.0001, 0.001, 0.01])::DOUBLE AS budget)""",
    "score_findings": _auc_sql("long", "detector", f"WITH {LONG_SQL}")
    + """, spread AS (SELECT detector, count(*) AS n, min(score) = max(score) AND count(*) > 1 AS all_identical FROM src GROUP BY 1)
SELECT detector, n, round(auc, 9) AS auc, all_identical, round(CASE WHEN auc < 0.5 THEN 1 - auc END, 9) AS inverted FROM spread JOIN areas USING (detector) WHERE auc IS NOT NULL""",
    "per_arm_auc_shared_clean": _auc_sql("shared", "detector, arm", f"""WITH {LONG_SQL},
shared AS (SELECT detector, arm, score, label FROM long WHERE label AND arm IS NOT NULL
           UNION ALL SELECT a.detector, a.arm, l.score, l.label FROM (SELECT DISTINCT detector, arm FROM long WHERE label AND arm IS NOT NULL AND score IS NOT NULL) a JOIN long l ON l.detector = a.detector AND NOT l.label)""")
    + f"SELECT detector, arm, n_pos, n_neg, {_INTERVAL} FROM areas",
    "per_arm_auc_own_covers": _auc_sql("owned", "detector, arm", f"""WITH {LONG_SQL},
owned AS (SELECT detector, arm, score, label FROM long WHERE label AND arm IS NOT NULL AND score IS NOT NULL
        UNION ALL SELECT a.detector, a.arm, l.score, l.label FROM (SELECT DISTINCT detector, arm, cover FROM long WHERE label AND arm IS NOT NULL AND score IS NOT NULL) a
        JOIN long l ON l.detector = a.detector AND l.cover = a.cover AND NOT l.label)""")
    + f"SELECT detector, arm, n_pos, n_neg, {_INTERVAL} FROM areas",
    "paired_covers": f"""WITH {LONG_SQL}, pairs AS (SELECT s.detector, s.arm, s.cover, s.score, c.score AS clean_score FROM long s JOIN long c ON c.cover = s.cover AND c.detector = s.detector
WHERE s.label AND s.arm IS NOT NULL AND s.score IS NOT NULL AND NOT c.label AND c.score IS NOT NULL)
SELECT detector, arm, count(*) AS n_pairs, count(DISTINCT cover) AS n_covers, count(*) FILTER (WHERE score = clean_score) AS identical, round(avg((score > clean_score)::INT), 9) AS higher_share FROM pairs GROUP BY 1, 2""",
    "hit_rates": f"WITH {SCORED_SQL} SELECT arm, count(*) AS n, round(avg(zsteg::INT), 9) AS hit_rate FROM scored WHERE zsteg IS NOT NULL GROUP BY 1",
    "position_join_coalesce": f"""WITH {SCORED_SQL}, v AS (SELECT stego, stegexpose, coalesce(stegexpose, zsteg::INT::DOUBLE) AS value FROM scored)
SELECT stego, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_error, count(*) FILTER (WHERE stegexpose IS NULL AND value IS NOT NULL) AS from_verdict, round(avg(value), 9) AS mean_value FROM v GROUP BY 1""",
    "metrics_refusal_status": f"""WITH {SCORED_SQL}, q AS (SELECT panel_id % 50 AS request, list(aletheia_rs ORDER BY panel_id) AS scores, list(stego ORDER BY panel_id) AS labels FROM scored GROUP BY 1),
p AS (SELECT request, CASE WHEN request % 3 = 0 THEN list_filter(scores, lambda x: x IS NOT NULL) ELSE scores END AS scores, labels FROM q),
c AS (SELECT request, scores, CASE WHEN request % 3 = 0 THEN labels[1:len(scores)] ELSE labels END AS labels,
             CASE WHEN request % 7 = 0 THEN 'duplicate-budget' WHEN request % 5 = 0 THEN 'budget-not-a-rate' ELSE 'ok' END AS last FROM p)
SELECT request, CASE WHEN len(scores) <> len(labels) THEN 'length-mismatch' WHEN len(scores) = 0 THEN 'empty' WHEN len(list_filter(scores, lambda x: x IS NULL)) > 0 THEN 'not-a-number'
  WHEN len(list_distinct(labels)) = 1 THEN 'one-sided' ELSE last END AS status FROM c""",
    "order_priority_auc": _auc_sql("lines", "arm", """WITH l AS (SELECT l_quantity AS score, l_returnflag = 'R' AS label, o_orderpriority AS priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
lines AS (SELECT priority AS arm, score, label FROM l WHERE label UNION ALL SELECT a.priority, l.score, l.label FROM (SELECT DISTINCT priority FROM l WHERE label) a, l WHERE NOT l.label)""")
    + f"SELECT arm, n_pos, n_neg, {_INTERVAL} FROM areas",
    "error_rows": f"WITH {SCORED_SQL} SELECT aletheia_error, count(*) AS n, count(aletheia_spa) AS n_scored FROM scored GROUP BY 1",
}
