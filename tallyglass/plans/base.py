"""The detection view of the tables: images listed once, the panel compacted, scores joined to labels. With the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.names import plain_digest, plain_name, plain_side
from tallyglass.operators.compaction import most_complete
from tallyglass.sources.tables import table

DETECTORS = ["aletheia_spa", "aletheia_rs", "stegexpose"]
PANEL_FIELDS = [*DETECTORS, "zsteg"]


def listed(spark, folder) -> DataFrame:
    """Each plain image name once, by its first row: ``name, row_id, stego, arm, tool, rate, ..., cover, digest, side``."""
    m = table(spark, folder, "manifest")
    stego = F.col("arm").isNotNull() | F.col("source_png").isNotNull()
    rows = m.select(
        plain_name("file").alias("name"), "row_id", stego.alias("stego"), "arm", "tool", "rate", "rate_unit", "domain", "width", "height", "changed", "batch_no",
        F.coalesce(plain_name("source_png"), plain_name("file")).alias("cover"), plain_digest("sha256").alias("digest"), plain_digest("clean_sha256").alias("clean_digest"),
        plain_side("split").alias("side"), "tier_order", "licence", "uploader",
    )
    # one aggregate a column: those that a query doesn't use are neither read nor shuffled
    return rows.groupBy("name").agg(*[F.min("row_id").alias("row_id") if c == "row_id" else F.min_by(c, "row_id").alias(c) for c in rows.columns if c != "name"])


def panel(spark, folder) -> DataFrame:
    """The panel's most complete record per plain name."""
    log = table(spark, folder, "panel")
    return most_complete(log, plain_name("file"), PANEL_FIELDS, "panel_id").withColumnRenamed("key", "name")


def scored(spark, folder) -> DataFrame:
    """Scores in wide form with what the manifest says of each image."""
    # names are unique on both sides: no key is hot
    return panel(spark, folder).select("name", "panel_id", *PANEL_FIELDS, "aletheia_error").join(listed(spark, folder), "name")


def long_scores(spark, folder) -> DataFrame:
    """``name, arm, cover, label, detector, score``: one row per image and detector; null scores stay."""
    return scored(spark, folder).select(
        "name", "arm", "cover", "side", F.col("stego").alias("label"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("score")) for d in DETECTORS])).alias("d"),
    ).select("name", "arm", "cover", "side", "label", "d.detector", "d.score")


PLAIN = r"lower(regexp_extract(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[^/\\]*$'))"
DIGEST = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^sha256:', '')"
SIDE = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"

LISTED_SQL = f"""
listed AS (SELECT * FROM (
    SELECT {PLAIN.format("file")} AS name, row_id, (arm IS NOT NULL OR source_png IS NOT NULL) AS stego, arm, tool, rate, rate_unit, domain, width, height, changed, batch_no,
           coalesce({PLAIN.format("source_png")}, {PLAIN.format("file")}) AS cover, {DIGEST.format("sha256")} AS digest,
           {DIGEST.format("clean_sha256")} AS clean_digest, {SIDE.format("split")} AS side, tier_order, licence, uploader,
           row_number() OVER (PARTITION BY {PLAIN.format("file")} ORDER BY row_id) AS nth FROM manifest) WHERE nth = 1)"""

PANEL_SQL = f"""
best AS (SELECT * FROM (
    SELECT {PLAIN.format("file")} AS name, panel_id, aletheia_spa, aletheia_rs, stegexpose, zsteg, aletheia_error,
           row_number() OVER (PARTITION BY {PLAIN.format("file")} ORDER BY
             (aletheia_spa IS NOT NULL)::INT + (aletheia_rs IS NOT NULL)::INT + (stegexpose IS NOT NULL)::INT + (zsteg IS NOT NULL)::INT DESC, panel_id) AS nth
    FROM panel WHERE file IS NOT NULL) WHERE nth = 1)"""

SCORED_SQL = f"{LISTED_SQL}, {PANEL_SQL}, scored AS (SELECT best.* EXCLUDE (nth), listed.* EXCLUDE (name, nth) FROM best JOIN listed USING (name))"

LONG_SQL = f"""{SCORED_SQL},
long AS (SELECT name, arm, cover, side, stego AS label, detector, score FROM (
    SELECT *, unnest(['aletheia_spa', 'aletheia_rs', 'stegexpose']) AS detector, unnest([aletheia_spa, aletheia_rs, stegexpose]) AS score FROM scored))"""
