"""Queries of covers, replaced rows, selections and controls, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.names import plain_digest, plain_name
from tallyglass.functions.text import arm_of_path, cover_of_path
from tallyglass.operators import confusion, covers, ranking, verify
from tallyglass.operators.assign import hash_unit
from tallyglass.plans.base import DIGEST, LISTED_SQL, LONG_SQL, PLAIN, SCORED_SQL, listed, long_scores, scored
from tallyglass.plans.detection import _INTERVAL, _auc_sql
from tallyglass.shared import cut
from tallyglass.sources.tables import table


def _stego(spark, folder):
    m = table(spark, folder, "manifest").filter("arm is not null or source_png is not null")
    return m.select("row_id", "arm", "domain", plain_name("file").alias("image"), plain_name("source_png").alias("cover"), plain_digest("clean_sha256").alias("half"))


def cover_map_conflicts(spark, folder):
    """Clean halves that rows record against more than one cover."""
    return covers.conflicts(covers.cover_map(_stego(spark, folder), "half", "cover"))


def cover_resolution(spark, folder):
    """How the cover of each arm's rows is known."""
    rows = _stego(spark, folder)
    done = covers.resolved(rows, cut(covers.cover_map(rows, "half", "cover"), "map"), "half", "cover")
    return done.groupBy("arm", "how").agg(F.count("*").alias("n"), F.count_distinct("known_cover").alias("n_covers"))


def arms_with_clean(spark, folder):
    """Arms and the clean arms made of their distinct halves."""
    both = covers.with_clean_arms(_stego(spark, folder), "arm", "half", "domain")
    return both.groupBy("arm", "clean").agg(F.count("*").alias("n"), F.count_distinct("image").alias("n_images"))


def doomed_rows(spark, folder):
    """Rows of each arm whose own image or cover was withdrawn."""
    rows = listed(spark, folder).select("arm", "name", "cover")
    gone = table(spark, folder, "removals").select(plain_name("file").alias("gone"))
    done = covers.doomed(rows, [F.col("name"), F.col("cover")], gone, "gone")
    return done.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("doomed").alias("n_doomed"))


def removal_log_checks(spark, folder):
    log = table(spark, folder, "removals").select(plain_name("file").alias("name"))
    return covers.log_checks(log, listed(spark, folder).filter("not stego").select("name"), "name").groupBy("status").agg(F.count("*").alias("n"), F.sum("n").alias("n_entries"))


def spliced_positions(spark, folder):
    """The withdrawn covers' places in the tiers, each with the unplaced cover that takes it."""
    clean = cut(listed(spark, folder).filter("not stego").select("name", "tier_order", "row_id"), "clean")
    gone = table(spark, folder, "removals").filter("file is not null").select(plain_name("file").alias("name")).distinct()
    places = clean.filter("tier_order is not null").join(gone, "name").select(F.col("tier_order").alias("place")).distinct()
    free = clean.filter("tier_order is null").join(gone, "name", "left_anti").select("row_id", F.col("name").alias("candidate"))
    return covers.spliced(places, "place", free, "row_id")


def checked_tallies(spark, folder):
    """Confusion counts of the images that both label and verdict are known of, per arm; arms with an answer missing are refused."""
    rows = cut(scored(spark, folder).select("arm", "name", F.col("stego").alias("label"), confusion.says_positive(F.col("stegexpose"), 0.25, verdict=F.col("zsteg")).alias("predicted")).withColumn("arm", F.coalesce("arm", F.lit("-"))), "judged")
    return covers.checked_tally(rows.select("arm", "name", "label"), rows.select("arm", "name", "predicted"), ["arm"], "name")


def arm_selection(spark, folder):
    """Arms asked for by name, against those listed."""
    registry = listed(spark, folder).filter("arm is not null").groupBy(F.col("arm").alias("name")).agg(F.min("domain").alias("kind"))
    return covers.selection(spark.createDataFrame([("lsb-0400",), ("lsb-040",), ("outguess-0200",), ("nonsense",)], "name string"), registry, "spatial")


def path_arms(spark, folder):
    """Arm and cover of the small files by their paths alone."""
    files = table(spark, folder, "lsb_0400")
    return files.groupBy(arm_of_path("path").alias("arm")).agg(F.count("*").alias("n"), F.count_distinct(cover_of_path("path")).alias("n_covers"))


def report_groups(spark, folder):
    """Sections of a report over the corpora that arms and sides make up."""
    rows = listed(spark, folder).filter("digest is not null").select(F.when(F.col("tier_order").isNotNull(), "named").otherwise("custom").alias("configuration"), F.coalesce("domain", F.lit("none")).alias("corpus"), F.coalesce("side", F.lit("-")).alias("digest"))
    return covers.report_groups(rows)


def null_control(spark, folder):
    """Labels that know nothing (a hash of the name) must score chance: area and interval of every detector."""
    blind = long_scores(spark, folder).select("detector", "score", (F.pmod(hash_unit("null", "name"), F.lit(2)) == 0).alias("label"))
    areas = ranking.auc(blind, ["detector"])
    return areas.select("detector", "n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in ("auc", "se", "low", "high")], ((F.col("low") <= 0.5) & (F.col("high") >= 0.5)).alias("chance"))


def corpus_stream_digest(spark, folder):
    """The digest of the clean images as one stream in the order of their names."""
    return verify.stream_digest(listed(spark, folder).filter("not stego and digest is not null").select("name", "digest"), "name", "digest")


QUERIES = {f.__name__: f for f in (
    cover_map_conflicts, cover_resolution, arms_with_clean, doomed_rows, removal_log_checks, spliced_positions, checked_tallies, arm_selection, path_arms, report_groups, null_control, corpus_stream_digest,
)}

_STEGO = f"""stego AS (SELECT row_id, arm, domain, {PLAIN.format("file")} AS image, {PLAIN.format("source_png")} AS cover, {DIGEST.format("clean_sha256")} AS half FROM manifest WHERE arm IS NOT NULL OR source_png IS NOT NULL),
map AS (SELECT half, min(cover) AS cover, count(DISTINCT cover) AS n_covers FROM stego WHERE half IS NOT NULL AND cover IS NOT NULL GROUP BY 1)"""
_GONE = f"gone AS (SELECT DISTINCT {PLAIN.format('file')} AS name FROM removals WHERE file IS NOT NULL)"
_BLIND = f"""WITH {LONG_SQL}, blind AS (SELECT detector, score, ('0x' || substr(sha256('null:' || name), 1, 15))::UBIGINT % 2 = 0 AS label FROM long)"""

ORACLES = {
    "cover_map_conflicts": f"WITH {_STEGO} SELECT * FROM map WHERE n_covers > 1",
    "cover_resolution": f"""WITH {_STEGO} SELECT arm, CASE WHEN s.cover IS NOT NULL THEN 'direct' WHEN n_covers = 1 THEN 'via half' WHEN n_covers > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how, count(*) AS n,
count(DISTINCT coalesce(s.cover, CASE WHEN n_covers = 1 THEN m.cover END)) AS n_covers FROM stego s LEFT JOIN map m USING (half) GROUP BY 1, 2""",
    "arms_with_clean": f"""WITH {_STEGO}, u AS (SELECT arm, image, false AS clean FROM stego UNION ALL SELECT DISTINCT 'clean-' || coalesce(domain, 'none'), half, true FROM stego WHERE half IS NOT NULL)
SELECT arm, clean, count(*) AS n, count(DISTINCT image) AS n_images FROM u GROUP BY 1, 2""",
    "doomed_rows": f"WITH {LISTED_SQL}, {_GONE} SELECT arm, count(*) AS n, count(*) FILTER (WHERE coalesce(name IN (FROM gone), false) OR coalesce(cover IN (FROM gone), false)) AS n_doomed FROM listed GROUP BY 1",
    "removal_log_checks": f"""WITH {LISTED_SQL}, e AS (SELECT {PLAIN.format("file")} AS name, count(*) AS n FROM removals GROUP BY 1)
SELECT CASE WHEN name IS NULL THEN 'unnamed' WHEN name NOT IN (SELECT name FROM listed WHERE NOT stego) THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status, count(*) AS n, sum(n)::BIGINT AS n_entries FROM e GROUP BY 1""",
    "spliced_positions": f"""WITH {LISTED_SQL}, {_GONE}, p AS (SELECT place, row_number() OVER (ORDER BY place) AS k FROM (SELECT DISTINCT tier_order AS place FROM listed WHERE NOT stego AND tier_order IS NOT NULL AND name IN (FROM gone))),
f AS (SELECT row_id, name AS candidate, row_number() OVER (ORDER BY row_id) AS k FROM listed WHERE NOT stego AND tier_order IS NULL AND name NOT IN (FROM gone)) SELECT place, row_id, candidate FROM p LEFT JOIN f USING (k)""",
    "checked_tallies": f"""WITH {SCORED_SQL}, j AS (SELECT coalesce(arm, '-') AS arm, stego AS y, coalesce(zsteg, stegexpose > 0.25) AS p FROM scored),
t AS (SELECT arm, count(*) FILTER (WHERE p IS NULL) AS odd, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE y AND NOT p) AS fn FROM j GROUP BY 1)
SELECT arm, CASE WHEN odd > 0 THEN 'length-mismatch' ELSE 'ok' END AS status, CASE WHEN odd = 0 THEN tp END AS tp, CASE WHEN odd = 0 THEN fp END AS fp, CASE WHEN odd = 0 THEN tn END AS tn, CASE WHEN odd = 0 THEN fn END AS fn FROM t""",
    "arm_selection": f"""WITH {LISTED_SQL}, r AS (SELECT arm AS name, min(domain) AS kind FROM listed WHERE arm IS NOT NULL GROUP BY 1)
SELECT name, CASE WHEN kind IS NULL THEN 'unknown' WHEN kind <> 'spatial' THEN 'other kind' ELSE 'ok' END AS status FROM (SELECT unnest(['lsb-0400', 'lsb-040', 'outguess-0200', 'nonsense']) AS name) LEFT JOIN r USING (name)""",
    "path_arms": r"SELECT coalesce(nullif(regexp_replace(path, '/?[^/]*$', ''), ''), 'clean') AS arm, count(*) AS n, count(DISTINCT regexp_extract(path, '[^/]*$')) AS n_covers FROM lsb_0400 GROUP BY 1",
    "report_groups": f"""WITH {LISTED_SQL}, g AS (SELECT CASE WHEN tier_order IS NOT NULL THEN 'named' ELSE 'custom' END AS configuration, coalesce(domain, 'none') AS corpus, coalesce(side, '-') AS digest, count(*) AS n FROM listed WHERE digest IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY configuration DESC, corpus, digest) - 1 AS place FROM g""",
    "null_control": _auc_sql("blind", "detector", _BLIND) + f"SELECT detector, n_pos, n_neg, {_INTERVAL}, greatest(0.0, auc - 1.959963984540054 * se) <= 0.5 AND least(1.0, auc + 1.959963984540054 * se) >= 0.5 AS chance FROM areas",
    "corpus_stream_digest": f"WITH {LISTED_SQL} SELECT count(*) AS n, sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY name)) AS digest FROM listed WHERE NOT stego AND digest IS NOT NULL",
}
