"""Queries of the corpus layer: assignment, pairing and compaction, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.names import plain_name
from tallyglass.operators import assign, compaction, pairing
from tallyglass.plans.base import LISTED_SQL, PANEL_FIELDS, PLAIN, listed
from tallyglass.shared import cut
from tallyglass.sources.tables import table

SALT = "strand-v1"


def stable_split(spark, folder):
    return listed(spark, folder).filter("not stego").select("name", assign.stable_split(SALT, "digest", 0.2).alias("side"))


def split_shares(spark, folder):
    rows = listed(spark, folder).select(assign.stable_split(SALT, "cover", 0.2).alias("new_side"), "stego")
    return rows.groupBy("new_side", "stego").agg(F.count("*").alias("n"))


def hash_kfold(spark, folder):
    return listed(spark, folder).groupBy(assign.hash_fold("cover", 5).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("cover").alias("n_covers"))


def tier_prefix(spark, folder):
    clean = listed(spark, folder).filter("not stego")
    return assign.tier_prefix(clean, "tier_order", 200).select("name", "tier_order")


def tier_density_check(spark, folder):
    return assign.density(table(spark, folder, "manifest").filter("arm is null and source_png is null"), "tier_order")


def tier_names(spark, folder):
    sizes = [200, 1000, 10000, 100000, 77]
    held = listed(spark, folder).filter("not stego").agg(*[F.count_if(F.col("tier_order") < n).alias(f"n{n}") for n in sizes])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"n{n}").alias("n_covers")) for n in sizes]))
    return held.select(each.alias("e")).select("e.size", assign.tier_name("e.size").alias("tier"), "e.n_covers")


def tier_order_assigned(spark, folder):
    clean = table(spark, folder, "manifest").filter("arm is null and source_png is null").select("row_id", "tier_order")
    return assign.extend_order(clean, "tier_order", "row_id", "tiers")


def corpus_order(spark, folder):
    """Dense positions of the images in corpus order (plain name)."""
    return assign.dense_position(listed(spark, folder).select("name"), "name")


def shard_assign(spark, folder):
    placed = corpus_order(spark, folder).withColumn("shard", assign.shard("position", 500))
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


def limit_in_order(spark, folder):
    rows = corpus_order(spark, folder)
    total = rows.agg(F.count("*").alias("of_items"))
    return rows.filter("position < 100").crossJoin(F.broadcast(total))  # one row


def seeded_sample(spark, folder):
    return assign.seeded_sample(table(spark, folder, "manifest").select("row_id"), "row_id", 500, "20260921")


def round_robin_sources(spark, folder):
    images = table(spark, folder, "images").select("sha256", "source")
    return assign.spread(images, "source", "sha256", 60)


def uploader_cap(spark, folder):
    clean = listed(spark, folder).filter("not stego").select("row_id", "uploader")
    return assign.capped(clean, "uploader", "row_id", 3)


def two_way_caps(spark, folder):
    clean = table(spark, folder, "manifest").filter("arm is null and source_png is null").select("row_id", "uploader", "capture_class")
    return assign.sequential(clean, "row_id", assign.two_way_caps({"uploader": 5, "capture_class": 120}), ["uploader", "capture_class"])


def share_quota(spark, folder):
    rows = table(spark, folder, "images").select("sha256", "source")
    return assign.sequential(rows, "sha256", assign.share_quota(0.2, 200), ["source"])


def split_side_inherited(spark, folder):
    return pairing.inherited_side(pairing.with_cover(cut(listed(spark, folder), "listed"))).groupBy("selected_side").agg(F.count("*").alias("n"), F.count_if(F.col("cover_side").isNull()).alias("own"))


def split_leaks(spark, folder):
    return pairing.leaks(pairing.with_cover(cut(listed(spark, folder), "listed"))).select("name", "cover", "side", "cover_side")


def violations(spark, folder):
    pairs = pairing.with_cover(cut(listed(spark, folder), "listed"))
    kind = F.when(F.col("cover_row").isNull(), "no-cover").when(F.col("side") != F.col("cover_side"), "split-leak").when(F.col("width") != F.col("cover_width"), "size")
    found = cut(pairs.select(kind.alias("violation"), "name").filter("violation is not null"), "violations")
    shown = pairing.examples(found, "violation", "name").select("violation", F.array_join("examples", ",").alias("examples"))
    return found.groupBy("violation").agg(F.count("*").alias("n")).join(shown, "violation")


def pairing_verdict(spark, folder):
    rows = cut(listed(spark, folder), "listed")
    halves = rows.filter("not stego").groupBy("digest").agg(F.min_by("width", "row_id").alias("half_width"), F.min_by("height", "row_id").alias("half_height"))
    return pairing.pairing_verdict(pairing.pair_check(pairing.with_cover(rows), halves), ["arm"])


def split_discipline(spark, folder):
    return pairing.discipline(listed(spark, folder), ["arm"])


def uniform_facts(spark, folder):
    return listed(spark, folder).groupBy("arm").agg(*[pairing.uniform(c).alias(c) for c in ("tool", "rate_unit", "domain", "side", "licence")])


def arm_inference(spark, folder):
    return pairing.arm_facts(listed(spark, folder))


def best_record_per_file(spark, folder):
    log = table(spark, folder, "panel")
    return compaction.most_complete(log, plain_name("file"), PANEL_FIELDS, "panel_id").select("key", "panel_id", *PANEL_FIELDS)


def last_record_per_file(spark, folder):
    log = table(spark, folder, "panel").filter("aletheia_spa is not null")
    return compaction.last_record(log, plain_name("file"), ["scored_at", "panel_id"]).select("key", "panel_id", "aletheia_spa")


def resume_todo(spark, folder):
    done = table(spark, folder, "panel").select(plain_name("file").alias("name"))
    return compaction.left_to_do(listed(spark, folder).select("name", "stego"), done, "name")


def resume_divergence(spark, folder):
    now = assign.dense_position(listed(spark, folder).select("name"), "name")
    before = assign.dense_position(listed(spark, folder).filter("batch_no < 9").select("name"), "name")
    return compaction.divergence(before, now, "position", "name")


def merge_shards(spark, folder):
    m = table(spark, folder, "manifest").select("row_id", "file", "arm", "width")
    r = table(spark, folder, "manifest_mirror").select("row_id", "file", "arm", "width")
    return compaction.merge_shards([m, r], "row_id").select("row_id", "conflict", "n_shards")


def late_overlay(spark, folder):
    log = table(spark, folder, "panel").select("panel_id", "file", *PANEL_FIELDS)
    early, late = log.filter("panel_id % 10 <> 0"), log.filter("panel_id % 10 = 0")
    return compaction.most_complete(compaction.overlay(early, late, "panel_id"), plain_name("file"), PANEL_FIELDS, "panel_id").select("key", *PANEL_FIELDS)


def wanted_files(spark, folder):
    rows = listed(spark, folder).filter("stego").select(F.explode(F.array("name", "cover")).alias("file"), "row_id")
    return compaction.first_seen(rows, F.col("file"), "row_id")


def detector_matrix(spark, folder):
    """One column per detector and the images every detector answers alike for."""
    log = best_record_per_file(spark, folder)
    return log.groupBy(F.substring_index("key", "-", 1).alias("family")).pivot("zsteg", [True, False]).agg(F.count(F.lit(1))).select(
        "family", F.coalesce("true", F.lit(0)).alias("hits"), F.coalesce("false", F.lit(0)).alias("misses")
    )


QUERIES = {f.__name__: f for f in (
    stable_split, split_shares, hash_kfold, tier_prefix, tier_density_check, tier_names, tier_order_assigned, corpus_order, shard_assign, limit_in_order, seeded_sample, round_robin_sources,
    uploader_cap, two_way_caps, share_quota, split_side_inherited, split_leaks, violations, pairing_verdict, split_discipline, uniform_facts, arm_inference, best_record_per_file,
    last_record_per_file, resume_todo, resume_divergence, merge_shards, late_overlay, wanted_files, detector_matrix,
)}

_UNIT = "('0x' || substr(sha256('{0}:' || {1}), 1, 15))::UBIGINT"
_COVERED = f"""WITH {LISTED_SQL},
pairs AS (SELECT s.*, c.row_id AS cover_row, c.side AS cover_side, c.digest AS cover_digest, c.width AS cover_width, c.height AS cover_height
          FROM listed s LEFT JOIN listed c ON c.name = s.cover AND NOT c.stego WHERE s.stego)
"""
_UNIFORM = "CASE WHEN count({0}) = 0 THEN 'unstated' WHEN min({0}) = max({0}) THEN min({0})::VARCHAR ELSE 'mixed' END"
_CLEAN = "FROM manifest WHERE arm IS NULL AND source_png IS NULL"
_BEST = "row_number() OVER (PARTITION BY {0} ORDER BY (aletheia_spa IS NOT NULL)::INT + (aletheia_rs IS NOT NULL)::INT + (stegexpose IS NOT NULL)::INT + (zsteg IS NOT NULL)::INT DESC, panel_id)"

ORACLES = {
    "stable_split": f"WITH {LISTED_SQL} SELECT name, CASE WHEN {_UNIT.format(SALT, 'digest')} < {int(0.2 * 2**60)} THEN 'test' ELSE 'train' END AS side FROM listed WHERE NOT stego",
    "split_shares": f"WITH {LISTED_SQL} SELECT CASE WHEN {_UNIT.format(SALT, 'cover')} < {int(0.2 * 2**60)} THEN 'test' ELSE 'train' END AS new_side, stego, count(*) AS n FROM listed GROUP BY 1, 2",
    "hash_kfold": f"WITH {LISTED_SQL} SELECT (('0x' || substr(sha256(cover), 1, 8))::UBIGINT % 5)::INT AS fold, count(*) AS n, count(DISTINCT cover) AS n_covers FROM listed GROUP BY 1",
    "tier_prefix": f"WITH {LISTED_SQL} SELECT name, tier_order FROM listed WHERE NOT stego AND tier_order BETWEEN 0 AND 199",
    "tier_density_check": f"""SELECT count(*) AS n, count(*) - count(tier_order) AS n_null, count(DISTINCT tier_order) AS n_distinct, min(tier_order) AS low, max(tier_order) AS high,
count(tier_order) - count(DISTINCT tier_order) AS n_repeated, max(tier_order) + 1 - count(DISTINCT tier_order) FILTER (WHERE tier_order >= 0) AS n_missing {_CLEAN}""",
    "tier_names": f"""WITH {LISTED_SQL}, sizes AS (SELECT unnest([200, 1000, 10000, 100000, 77]) AS size)
SELECT size, CASE size WHEN 200 THEN 'nano' WHEN 1000 THEN 'lite' WHEN 10000 THEN 'core' WHEN 100000 THEN 'full' ELSE 'custom' END AS tier,
       (SELECT count(*) FROM listed WHERE NOT stego AND tier_order < size) AS n_covers FROM sizes""",
    "tier_order_assigned": f"""WITH c AS (SELECT row_id, tier_order {_CLEAN})
SELECT row_id, coalesce(tier_order, (SELECT max(tier_order) FROM c) + row_number() OVER (PARTITION BY tier_order IS NULL ORDER BY substr(sha256('tiers:' || row_id), 1, 15), row_id)) AS tier_order FROM c""",
    "corpus_order": f"WITH {LISTED_SQL} SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM listed",
    "shard_assign": f"WITH {LISTED_SQL}, p AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM listed) SELECT position // 500 AS shard, count(*) AS n, min(name) AS first, max(name) AS last FROM p GROUP BY 1",
    "limit_in_order": f"WITH {LISTED_SQL}, p AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS position, count(*) OVER () AS of_items FROM listed) SELECT * FROM p WHERE position < 100",
    "seeded_sample": "SELECT row_id FROM manifest ORDER BY substr(sha256('20260921:' || row_id), 1, 15), row_id LIMIT 500",
    "round_robin_sources": """WITH r AS (SELECT sha256, source, row_number() OVER (PARTITION BY source ORDER BY sha256) AS round, min(sha256) OVER (PARTITION BY source) AS f FROM images)
SELECT sha256, source, round::INT AS round FROM r ORDER BY round, f LIMIT 60""",
    "uploader_cap": f"WITH {LISTED_SQL}, r AS (SELECT row_id, uploader, row_number() OVER (PARTITION BY uploader ORDER BY row_id) AS n FROM listed WHERE NOT stego) SELECT row_id, uploader FROM r WHERE uploader IS NULL OR n <= 3",
    "split_side_inherited": _COVERED + "SELECT coalesce(cover_side, side) AS selected_side, count(*) AS n, count(*) FILTER (WHERE cover_side IS NULL) AS own FROM pairs GROUP BY 1",
    "split_leaks": _COVERED + "SELECT name, cover, side, cover_side FROM pairs WHERE side <> cover_side",
    "violations": _COVERED + """, v AS (SELECT name, CASE WHEN cover_row IS NULL THEN 'no-cover' WHEN side <> cover_side THEN 'split-leak' WHEN width <> cover_width THEN 'size' END AS violation FROM pairs)
SELECT violation, count(*) AS n, array_to_string(list_sort(list(DISTINCT name))[1:3], ',') AS examples FROM v WHERE violation IS NOT NULL GROUP BY 1""",
    "pairing_verdict": _COVERED + """, halves AS (SELECT digest, arg_min(width, row_id) AS half_width, arg_min(height, row_id) AS half_height FROM listed WHERE NOT stego GROUP BY 1),
j AS (SELECT p.*, CASE WHEN p.clean_digest IS NOT NULL THEN half_width ELSE cover_width END AS w, CASE WHEN p.clean_digest IS NOT NULL THEN half_height ELSE cover_height END AS h
      FROM pairs p LEFT JOIN halves ON halves.digest = p.clean_digest),
k AS (SELECT arm, CASE WHEN w IS NULL OR h IS NULL OR width IS NULL THEN 'uncomparable' WHEN width = w AND height = h THEN 'same' ELSE 'differs' END AS c FROM j)
SELECT arm, CASE WHEN count(*) FILTER (WHERE c = 'differs') > 0 THEN 'confounded' WHEN count(*) FILTER (WHERE c = 'same') > 0 THEN 'single-variable' ELSE 'unverified' END AS pairing,
count(*) FILTER (WHERE c <> 'uncomparable') AS compared, count(*) FILTER (WHERE c = 'uncomparable') AS missing, count(*) FILTER (WHERE c = 'differs') AS differed FROM k GROUP BY 1""",
    "split_discipline": f"WITH {LISTED_SQL} SELECT arm, CASE WHEN count(side) > 0 THEN 'by-cover' ELSE 'n/a' END AS split_discipline FROM listed GROUP BY 1",
    "uniform_facts": f"WITH {LISTED_SQL} SELECT arm, " + ", ".join(f"{_UNIFORM.format(c)} AS {c}" for c in ("tool", "rate_unit", "domain", "side", "licence")) + " FROM listed GROUP BY 1",
    "arm_inference": f"""WITH {LISTED_SQL}, u AS (SELECT *, CASE WHEN lower(rate_unit) IN ('bits per pixel', 'bpp') THEN 'bpp' WHEN contains(lower(rate_unit), 'capacity') THEN 'fraction' END AS unit_
FROM listed WHERE stego AND arm IS NOT NULL),
a AS (SELECT arm, count(*) AS n, {_UNIFORM.format("tool")} AS tool, {_UNIFORM.format("domain")} AS domain, {_UNIFORM.format("unit_")} AS unit, min(rate) AS lo, max(rate) AS hi,
             count(*) FILTER (WHERE rate_unit IS NOT NULL AND unit_ IS NULL) AS odd FROM u GROUP BY 1)
SELECT arm, n, CASE WHEN tool = 'unstated' THEN arm ELSE tool END AS embedder, CASE WHEN lo = hi AND unit IN ('bpp', 'fraction') AND odd = 0 THEN lo END AS rate,
       CASE WHEN lo = hi AND unit IN ('bpp', 'fraction') AND odd = 0 THEN unit END AS unit, domain FROM a""",
    "best_record_per_file": f"SELECT key, panel_id, aletheia_spa, aletheia_rs, stegexpose, zsteg FROM (SELECT *, {PLAIN.format('file')} AS key, {_BEST.format(PLAIN.format('file'))} AS nth FROM panel WHERE file IS NOT NULL) WHERE nth = 1",
    "last_record_per_file": f"""SELECT key, panel_id, aletheia_spa FROM (SELECT *, {PLAIN.format('file')} AS key, row_number() OVER (PARTITION BY {PLAIN.format('file')} ORDER BY scored_at DESC, panel_id DESC) AS nth
FROM panel WHERE file IS NOT NULL AND aletheia_spa IS NOT NULL) WHERE nth = 1""",
    "resume_todo": f"WITH {LISTED_SQL} SELECT name, stego FROM listed WHERE name NOT IN (SELECT {PLAIN.format('file')} FROM panel WHERE file IS NOT NULL)",
    "resume_divergence": f"""WITH {LISTED_SQL}, n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM listed),
b AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM listed WHERE batch_no < 9)
SELECT b.position, b.name AS was, n.name AS "is" FROM b LEFT JOIN n USING (position) WHERE b.name IS DISTINCT FROM n.name""",
    "merge_shards": """WITH u AS (SELECT row_id, file, arm, width FROM manifest UNION ALL SELECT row_id, file, arm, width FROM manifest_mirror)
SELECT row_id, count(DISTINCT (coalesce(file, chr(0)), coalesce(arm, chr(0)), coalesce(width, -1))) > 1 AS conflict, count(*) AS n_shards FROM u GROUP BY 1""",
    "late_overlay": f"""WITH m AS (SELECT max(panel_id) AS m FROM panel WHERE panel_id % 10 <> 0),
o AS (SELECT CASE WHEN panel_id % 10 = 0 THEN panel_id + m ELSE panel_id END AS panel_id, {PLAIN.format('file')} AS key, aletheia_spa, aletheia_rs, stegexpose, zsteg FROM panel, m WHERE file IS NOT NULL)
SELECT key, aletheia_spa, aletheia_rs, stegexpose, zsteg FROM (SELECT *, {_BEST.format('key')} AS nth FROM o) WHERE nth = 1""",
    "wanted_files": f"WITH {LISTED_SQL} SELECT file AS key, min(row_id) AS position FROM (SELECT unnest([name, cover]) AS file, row_id FROM listed WHERE stego) WHERE file IS NOT NULL GROUP BY 1",
    "detector_matrix": f"""WITH b AS (SELECT key, zsteg FROM (SELECT *, {PLAIN.format('file')} AS key, {_BEST.format(PLAIN.format('file'))} AS nth FROM panel WHERE file IS NOT NULL) WHERE nth = 1)
SELECT split_part(key, '-', 1) AS family, count(*) FILTER (WHERE zsteg) AS hits, count(*) FILTER (WHERE NOT zsteg) AS misses FROM b GROUP BY 1""",
}
