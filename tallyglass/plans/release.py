"""Queries of the release checks, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.names import plain_digest, plain_name
from tallyglass.operators import release, report, smallfiles
from tallyglass.plans.base import LISTED_SQL, SCORED_SQL, listed, scored
from tallyglass.shared import cut
from tallyglass.sources.tables import table

THRESHOLDS = {"aletheia_spa": 0.5, "aletheia_rs": 0.4, "stegexpose": 0.25}


def stamp_sources(spark, folder):
    """Stego rows whose clean digest is written from their cover's."""
    rows = cut(listed(spark, folder), "listed")
    known = rows.filter("not stego").select(F.col("name").alias("cover"), F.col("digest").alias("clean_digest"))
    done = release.stamped(rows.filter("stego").select("name", "cover", "arm", "clean_digest"), known, "cover", "clean_digest")
    return done.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("written").alias("n_written"), F.count("clean_digest").alias("n_stamped"))


def credit_check(spark, folder):
    rows = table(spark, folder, "manifest").filter("arm is null and source_png is null").select(F.col("file").alias("name"))
    credits = table(spark, folder, "manifest_mirror").filter("arm is null and source_png is null and file is not null").select(F.col("file").alias("name"))
    return release.credit_check(credits, rows, "name").groupBy("status").agg(F.count("*").alias("n"))


def packed_digests(files):
    """``name, digest``: each distinct digest that the complete records of all bodies give for a name of their own, a null one
    for names (noted beside a body or in a record) without any."""
    fields = smallfiles.records_of(files, "file", "body").select("noted", F.from_json("record", "file string, sha256 string").alias("r"))
    records = fields.select(plain_name(F.coalesce("r.file", "noted")).alias("name"), plain_digest("r.sha256").alias("digest"))
    noted = files.select(plain_name("file").alias("name"), F.lit(None).cast("string").alias("digest"))
    each = records.unionByName(noted).filter("name is not null").groupBy("name").agg(F.collect_set("digest").alias("digests"))
    return each.select("name", F.explode_outer("digests").alias("digest"))


def packed_members(spark, folder):
    truth = listed(spark, folder).filter("arm = 'lsb-0400'").groupBy("name").agg(F.min("digest").alias("digest"))
    packed = packed_digests(table(spark, folder, "lsb_0400"))
    return release.packed_check(packed, truth, "name", "digest").groupBy("status").agg(F.count("*").alias("n"))


def firing_detectors(spark, folder):
    rows = scored(spark, folder).withColumn("fired", F.array_join(release.firing(THRESHOLDS), "+"))
    return rows.groupBy("stego", "fired").agg(F.count("*").alias("n"))


def derived_figures(spark, folder):
    rows = listed(spark, folder)
    return rows.agg(
        F.count_if("stego").alias("stego"), F.count_if(~F.col("stego")).alias("covers"), F.count_distinct("arm").alias("arms"), F.count_if(~F.col("stego") & (F.col("side") == "train")).alias("train"),
        F.count_if(~F.col("stego") & (F.col("side") == "test")).alias("test"), F.count_if(F.col("tool") == "outguess").alias("outguess"),
    )


def contamination(spark, folder):
    """Uploaders that name one of the sources of the store, as declared corpora would a corpus."""
    rows = table(spark, folder, "images").groupBy("source").agg(F.count("*").alias("n"))
    aliases = F.array(F.lit(" Harbour "), F.lit(""), F.lit("KILN"))
    return rows.select("source", "n", release.contaminated(F.col("source"), aliases).alias("contaminated"))


def plan_cost(spark, folder):
    detectors = spark.createDataFrame([("zsteg", 0.72, 60, True), ("stegexpose", 1.4, 60, True), ("rs", None, 120, True), ("rich", 5.4, 300, False)], "name string, seconds_per_image double, timeout int, runnable boolean")
    items = table(spark, folder, "images").count()
    return report.plan_cost(detectors, items)


def footprint(spark, folder):
    entries = table(spark, folder, "images").select(F.col("source").alias("reference"), (F.col("width") * F.col("height")).cast("long").alias("bytes"), (F.col("texture") > 8).alias("bundled"), F.col("sha256").alias("position"))
    return report.footprint(entries)


def job_plan(spark, folder):
    arms = listed(spark, folder).filter("tool is not null").groupBy("tool").agg(F.count("*").alias("n")).select("tool", F.lit(1.5).alias("seconds_each"))
    rates = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "rate double")
    return release.job_plan(arms, rates, 1000)


QUERIES = {f.__name__: f for f in (stamp_sources, credit_check, packed_members, firing_detectors, derived_figures, contamination, plan_cost, footprint, job_plan)}

ORACLES = {
    "stamp_sources": f"""WITH {LISTED_SQL} SELECT s.arm, count(*) AS n, count(*) FILTER (WHERE c.digest IS NOT NULL AND s.clean_digest IS DISTINCT FROM c.digest) AS n_written,
count(coalesce(c.digest, s.clean_digest)) AS n_stamped FROM listed s LEFT JOIN listed c ON c.name = s.cover AND NOT c.stego WHERE s.stego GROUP BY 1""",
    "credit_check": """WITH a AS (SELECT file, count(*) AS c FROM manifest_mirror WHERE arm IS NULL AND source_png IS NULL AND file IS NOT NULL GROUP BY 1), b AS (SELECT file, count(*) AS r FROM manifest WHERE arm IS NULL AND source_png IS NULL GROUP BY 1)
SELECT CASE WHEN c IS NULL THEN 'absent' WHEN r IS NULL THEN 'extra' WHEN c > 1 OR r > 1 THEN 'repeated' ELSE 'ok' END AS status, count(*) AS n FROM a FULL JOIN b USING (file) GROUP BY 1""",
    "firing_detectors": f"""WITH {SCORED_SQL} SELECT stego, array_to_string(list_filter([CASE WHEN aletheia_rs > 0.4 THEN 'aletheia_rs' END, CASE WHEN aletheia_spa > 0.5 THEN 'aletheia_spa' END, CASE WHEN stegexpose > 0.25 THEN 'stegexpose' END], lambda x: x IS NOT NULL), '+') AS fired,
count(*) AS n FROM scored GROUP BY 1, 2""",
    "derived_figures": f"""WITH {LISTED_SQL} SELECT count(*) FILTER (WHERE stego) AS stego, count(*) FILTER (WHERE NOT stego) AS covers, count(DISTINCT arm) AS arms, count(*) FILTER (WHERE NOT stego AND side = 'train') AS train,
count(*) FILTER (WHERE NOT stego AND side = 'test') AS test, count(*) FILTER (WHERE tool = 'outguess') AS outguess FROM listed""",
    "contamination": "SELECT source, count(*) AS n, lower(trim(source)) IN ('harbour', 'kiln') AS contaminated FROM images GROUP BY 1",
    "plan_cost": "SELECT 3::BIGINT AS n, 2.12::DOUBLE AS per_image, 1::BIGINT AS unestimated, 2.12::DOUBLE * count(*) AS seconds, 240 * count(*) AS worst_seconds, 3.0::DOUBLE * count(*) * 60 / 1048576 AS records_mb FROM images",
    "footprint": "SELECT bundled, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT source, arg_max((width * height)::BIGINT, sha256) AS bytes, arg_max(coalesce((texture > 8)::INT, -1), sha256) AS b, CASE b WHEN 1 THEN true WHEN 0 THEN false END AS bundled FROM images GROUP BY 1) GROUP BY 1",
    "job_plan": f"WITH {LISTED_SQL} SELECT DISTINCT tool, 1.5::DOUBLE AS seconds_each, rate_ AS rate, 1500.0::DOUBLE AS seconds FROM listed, (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS rate_) WHERE tool IS NOT NULL",
}
