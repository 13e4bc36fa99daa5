"""Queries of the data-pipeline operators in the core, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.names import plain_name
from tallyglass.operators import differences, orphans, smallfiles
from tallyglass.sources.tables import table

COMPARED = ["file", "sha256", "role", "arm", "source_png", "split", "tier_order", "width", "height", "rate", "added_at"]


def p1_found(spark, folder):
    return smallfiles.found(spark, table(spark, folder, "lsb_0400"))


def p2_found(spark, folder):
    return differences.differences(
        table(spark, folder, "manifest"), table(spark, folder, "manifest_mirror"), "row_id", COMPARED, "only_manifest", "only_mirror"
    )


def _orphans(spark, folder):
    manifest = table(spark, folder, "manifest")
    panel = table(spark, folder, "panel")
    clean = F.col("arm").isNull() & F.col("source_png").isNull()
    references = (
        manifest.filter(~clean)
        .select(F.lit("manifest").alias("ref_table"), F.col("row_id").alias("row_key"), plain_name("source_png").alias("name"), F.col("added_at").alias("at"))
        .unionByName(panel.select(F.lit("panel").alias("ref_table"), F.col("panel_id").alias("row_key"), plain_name("file").alias("name"), F.col("scored_at").alias("at")))
    )
    kinds = F.when(clean, F.array(F.lit("clean"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    parents = manifest.select(plain_name("file").alias("name"), F.col("added_at").alias("since"), F.explode(kinds).alias("kind"))
    removed = table(spark, folder, "removals").select(plain_name("file").alias("name"), F.col("removed_at").alias("gone"))
    return orphans.orphans(references, parents, removed, {"manifest": "clean", "panel": "any"})


def p3_found(spark, folder):
    return _orphans(spark, folder).select("ref_table", "row_key").distinct()


def p3_orphans_by_month(spark, folder):
    return orphans.per_table_and_period(_orphans(spark, folder))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_orphans_by_month": p3_orphans_by_month}

_PLAIN = r"lower(regexp_extract(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[^/\\]*$'))"

_P2 = " UNION ALL ".join(
    f"SELECT m.row_id, '{c}' AS difference FROM manifest m JOIN manifest_mirror r USING (row_id) "
    f"GROUP BY m.row_id HAVING bool_or(m.{c} IS DISTINCT FROM r.{c})"
    for c in COMPARED
)

_P3 = f"""
WITH parents AS (SELECT {_PLAIN.format("file")} AS name, min(added_at) AS any_since,
                        min(added_at) FILTER (WHERE arm IS NULL AND source_png IS NULL) AS clean_since
                 FROM manifest GROUP BY 1),
     gone AS (SELECT {_PLAIN.format("file")} AS name, min(removed_at) AS gone FROM removals GROUP BY 1),
     refs AS (SELECT 'manifest' AS ref_table, row_id AS row_key, {_PLAIN.format("source_png")} AS name, added_at AS at_time
              FROM manifest WHERE NOT (arm IS NULL AND source_png IS NULL) AND source_png IS NOT NULL
              UNION ALL SELECT 'panel', panel_id, {_PLAIN.format("file")}, scored_at FROM panel WHERE file IS NOT NULL),
     facts AS (SELECT r.*, CASE ref_table WHEN 'manifest' THEN clean_since ELSE any_since END AS since, gone
               FROM refs r LEFT JOIN parents p USING (name) LEFT JOIN gone g USING (name)),
     judged AS (SELECT *, CASE WHEN since IS NOT NULL AND gone <= at_time THEN 'deleted' WHEN since IS NULL THEN 'missing'
                               WHEN since > at_time THEN 'late' END AS reason FROM facts)
"""

ORACLES = {
    "p1_found": r"""
WITH records AS (SELECT unnest(regexp_extract_all(body, '\{[^{}]*\}')) AS r FROM lsb_0400)
SELECT DISTINCT r->>'$.arm' AS arm, r->>'$.file' AS file, r->>'$.sha256' AS sha256 FROM records WHERE json_valid(r)""",
    "p2_found": f"""
SELECT row_id, 'only_manifest' AS difference FROM manifest WHERE row_id NOT IN (SELECT row_id FROM manifest_mirror)
UNION ALL SELECT DISTINCT row_id, 'only_mirror' FROM manifest_mirror WHERE row_id NOT IN (SELECT row_id FROM manifest)
UNION ALL {_P2}""",
    "p3_found": _P3 + "SELECT DISTINCT ref_table, row_key FROM judged WHERE since IS NULL OR since > at_time OR gone <= at_time",
    "p3_orphans_by_month": _P3
    + "SELECT ref_table, date_trunc('month', at_time)::TIMESTAMP AS period, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}
