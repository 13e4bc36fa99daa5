"""Queries of the image store, integrity checks and licences, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import text as T
from tallyglass.functions.names import plain_digest, plain_name
from tallyglass.operators import integrity, pairing, prints
from tallyglass.plans.base import DIGEST, LISTED_SQL, PLAIN, listed
from tallyglass.shared import cut, join_facts
from tallyglass.sources.tables import table

RADIUS = 6


def _images(spark, folder):
    return table(spark, folder, "images").withColumn("pos", F.substring_index("ref", ":", -1).cast("long"))


def exact_dedup(spark, folder):
    return prints.exact_first(listed(spark, folder), "digest", "row_id")


def band_members(spark, folder):
    return prints.bands(table(spark, folder, "images"), "sha256", {"dhash": "dhash", "phash": "phash"}).groupBy("kind", "idx", "band").agg(F.count("*").alias("n"))


def near_dup_pairs(spark, folder):
    return prints.near_pairs(table(spark, folder, "images"), "sha256", "dhash", RADIUS)


def hamming_profile(spark, folder):
    pairs = near_dup_pairs(spark, folder)
    other = table(spark, folder, "images").select("sha256", "phash")
    both = pairs.join(other.toDF("left", "p"), "left").join(other.toDF("right", "q"), "right")
    return both.groupBy("distance", T.hamming("p", "q").alias("other")).agg(F.count("*").alias("n"))


def dedup_keep_first(spark, folder):
    rows = table(spark, folder, "images").select("sha256")
    order = rows.withColumn("o", F.conv(F.substring("sha256", 1, 15), 16, 10).cast("long"))
    links = near_dup_pairs(spark, folder).select(F.conv(F.substring("left", 1, 15), 16, 10).cast("long").alias("left"), F.conv(F.substring("right", 1, 15), 16, 10).cast("long").alias("right"), "distance")
    return prints.keep_first(order.select("o"), links, "o")


def dedup_stats(spark, folder):
    return prints.store_stats(dedup_keep_first(spark, folder))


def texture_gate(spark, folder):
    """Images by the gate on texture: refused below 1, noted below 4."""
    texture = F.col("texture")
    gate = F.when(texture.isNull(), "unknown").when(texture < 1.0, "refused").when(texture < 4.0, "low").otherwise("ok")
    return table(spark, folder, "images").groupBy("source", gate.alias("gate")).agg(F.count("*").alias("n"), F.round(F.avg("texture"), 6).alias("mean_texture"))


def digest_drift(spark, folder):
    """Rows whose digest in the second system is not the one recorded here, spellings aside."""
    recorded = table(spark, folder, "manifest").select("row_id", plain_digest("sha256").alias("digest"))
    actual = table(spark, folder, "manifest_mirror").select("row_id", plain_digest("sha256").alias("digest")).distinct()
    return integrity.drift(recorded, actual, "row_id", "digest")


def provenance(spark, folder):
    rows = cut(listed(spark, folder), "listed")
    actual = rows.filter("not stego").select(F.col("name").alias("cover"), F.col("digest").alias("actual"))
    joined = join_facts(rows.filter("stego"), actual, "cover", "left")
    return joined.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if(F.col("clean_digest").isNull()).alias("unstamped"), F.count_if(F.col("actual").isNull()).alias("unresolved"), F.count_if(F.col("clean_digest") != F.col("actual")).alias("differ")
    )


def two_way_integrity(spark, folder):
    rows = listed(spark, folder).filter("not stego").groupBy(F.col("digest").alias("sha256")).agg(F.max(F.lit("x")).alias("mark"), F.min("width").alias("width"))
    store = table(spark, folder, "images").select("sha256", "width")
    return integrity.two_way(rows.select("sha256", "width"), store, "sha256", "width").groupBy("status").agg(F.count("*").alias("n"))


def unknown_sources(spark, folder):
    rows = cut(listed(spark, folder), "listed")
    return rows.filter("stego").join(rows.filter("not stego").select(F.col("name").alias("cover")), "cover", "left_anti").groupBy("cover").agg(F.count("*").alias("n"))


def uniqueness_checks(spark, folder):
    return integrity.uniqueness(table(spark, folder, "manifest").filter("arm is null and source_png is null"), ["file", "sha256", "tier_order", "row_id"])


def corpus_digests(spark, folder):
    rows = listed(spark, folder).filter("not stego")
    return integrity.corpus_digest(rows, "name", "digest")


def manifest_validation(spark, folder):
    return integrity.checked(table(spark, folder, "manifest"), integrity.manifest_rules())


def validation_problems(spark, folder):
    rows = table(spark, folder, "manifest").select("row_id", integrity.problems(integrity.manifest_rules()).alias("p"))
    return rows.select("row_id", F.explode("p").alias("problem"))


def licence_summary(spark, folder):
    clean = listed(spark, folder).filter("not stego")
    named = clean.withColumn("licence", T.canonical_licence("licence"))
    return named.groupBy("licence").agg(F.count("*").alias("n"), T.obligation(F.first("licence")).alias("obligation"), F.countDistinct("uploader").alias("n_uploaders"))


def attribution_share(spark, folder):
    clean = listed(spark, folder).filter("not stego").withColumn("o", T.obligation("licence"))
    rank = F.when(F.col("o") == "uncovered", 2).when(F.col("o") == "attribution", 1).otherwise(0)
    each = cut(clean.groupBy(T.canonical_licence("licence").alias("licence"), "o", rank.alias("rank")).agg(F.count("*").alias("n")), "licences")
    covered = F.sum(F.when(F.col("o") == "attribution", F.col("n")).otherwise(0))
    total = each.agg(F.sum("n").alias("n"), covered.alias("n_attribution"), F.round(100 * covered / F.sum("n"), 1).alias("percent"), F.max("rank").alias("strictest"), F.lit(0).alias("one"))
    shown = pairing.examples(each.filter("o = 'uncovered'").withColumn("one", F.lit(0)), "one", "licence", 50).select("one", F.array_join("examples", ",").alias("uncovered"))
    return total.join(shown, "one", "left").select("n", "n_attribution", "percent", "strictest", F.coalesce("uncovered", F.lit("")).alias("uncovered"))


def licence_cross_check(spark, folder):
    """Recorded licences of stego rows beside their cover's, by pair of canonical names, and whether they agree."""
    pairs = cut(listed(spark, folder), "listed")
    covers = pairs.filter("not stego").select(F.col("name").alias("cover"), T.canonical_licence("licence").alias("cover_licence"))
    joined = join_facts(pairs.filter("stego"), covers, "cover", "inner").withColumn("licence", T.canonical_licence("licence"))
    return joined.groupBy("licence", "cover_licence", F.col("licence").eqNullSafe(F.col("cover_licence")).alias("agree")).agg(F.count("*").alias("n"))


def name_functions(spark, folder):
    f = F.substring_index(F.translate("file", "\\", "/"), "/", -1)
    return table(spark, folder, "manifest").groupBy(T.extension(f).alias("extension"), T.image_format(f).alias("format"), T.is_plain_file_name("file").alias("plain")).agg(F.count("*").alias("n"), F.min(T.stem(f)).alias("first_stem"))


def arm_keys(spark, folder):
    rows = listed(spark, folder).filter("stego and tool is not null and rate is not null")
    return rows.groupBy(T.arm_key("tool", "rate").alias("key"), "arm").agg(F.count("*").alias("n"))


def licence_hosts(spark, folder):
    return table(spark, folder, "manifest").groupBy(T.host("licence_url").alias("host")).agg(F.count("*").alias("n"))


def payload_seeds(spark, folder):
    rows = listed(spark, folder).filter("stego and rate is not null")
    return rows.select("name", T.payload_seed(7, "cover", "tool", "rate").alias("seed"))


def mirror_conflicts(spark, folder):
    """Name spelling of one row in both systems: plain names alike or not."""
    a = table(spark, folder, "manifest").select("row_id", plain_name("file").alias("a"))
    b = table(spark, folder, "manifest_mirror").groupBy("row_id").agg(F.min(plain_name("file")).alias("b"))
    return a.join(b, "row_id").groupBy((F.col("a") == F.col("b")).alias("alike")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    exact_dedup, band_members, near_dup_pairs, hamming_profile, dedup_keep_first, dedup_stats, texture_gate, digest_drift, provenance, two_way_integrity, unknown_sources, uniqueness_checks,
    corpus_digests, manifest_validation, validation_problems, licence_summary, attribution_share, licence_cross_check, name_functions, arm_keys, licence_hosts, payload_seeds, mirror_conflicts,
)}

_PAIRS = """pairs AS (SELECT least(a.sha256, b.sha256) AS "left", greatest(a.sha256, b.sha256) AS "right", bit_count(xor(a.dhash, b.dhash))::INT AS distance, bit_count(xor(a.phash, b.phash))::INT AS other
FROM images a JOIN images b ON a.sha256 < b.sha256 AND bit_count(xor(a.dhash, b.dhash)) <= 6)"""
_LOW = "regexp_replace(replace(lower(trim({0})), '_', ' '), '\\s+', ' ', 'g')"
# written out apart from the functions under test
_CANON = f"""CASE WHEN {_LOW} IN ('cc0', 'cc0-1.0', 'cc0 1.0') THEN 'CC0-1.0' WHEN {_LOW} IN ('cc by 4.0', 'cc-by-4.0') THEN 'CC-BY-4.0'
WHEN {_LOW} IN ('cc by-sa 4.0', 'cc-by-sa-4.0', 'cc by sa 4.0') THEN 'CC-BY-SA-4.0' WHEN {_LOW} IN ('public domain', 'pd') THEN 'Public domain' ELSE trim({{0}}) END"""


def _canon(c: str) -> str:
    return _CANON.replace("{0}", c)


_HYPHENED = "replace(lower(trim({0})), ' ', '-')"
_OBL = f"""CASE WHEN contains({_HYPHENED}, '-sa') OR contains({_HYPHENED}, 'share') OR contains({_HYPHENED}, 'nc') OR contains({_HYPHENED}, 'nd') OR contains({_HYPHENED}, 'noderiv')
OR contains({_HYPHENED}, 'no-deriv') OR contains({_HYPHENED}, 'non-commercial') OR contains({_HYPHENED}, 'gfdl') THEN 'uncovered'
WHEN starts_with({_HYPHENED}, 'cc0') OR starts_with({_HYPHENED}, 'public-domain') OR starts_with({_HYPHENED}, 'no-rights') OR starts_with({_HYPHENED}, 'copyrighted-free-use') THEN 'none'
WHEN starts_with({_HYPHENED}, 'cc-by') THEN 'attribution' ELSE 'uncovered' END"""
_RULES = {
    "file is not a plain name": r"NOT regexp_full_match(file, '[^/\\\x00-\x1f\x7f]+')", "sha256 is not 64 lower hex digits": "NOT regexp_full_match(sha256, '[0-9a-f]{64}')",
    "size is not positive": "width <= 0 OR height <= 0", "crop box has not four numbers": "len(crop_box) <> 4",
    "crop box differs from the size": "len(crop_box) = 4 AND (crop_box[3] - crop_box[1] <> width OR crop_box[4] - crop_box[2] <> height)",
    "split is not a side": "split NOT IN ('train', 'validation', 'test')", "licence without url": "licence IS NOT NULL AND licence_url IS NULL",
}
_PROBLEMS = " UNION ALL ".join(f"SELECT row_id, '{k}' AS problem FROM manifest WHERE {v}" for k, v in _RULES.items())

ORACLES = {
    "exact_dedup": f"WITH {LISTED_SQL} SELECT digest, min(row_id) AS kept, count(*) AS n FROM listed GROUP BY 1",
    "band_members": "SELECT kind, idx::INT AS idx, band, count(*) AS n FROM (SELECT unnest(['dhash', 'phash']) AS kind, unnest([dhash, phash]) AS h FROM images), LATERAL (SELECT unnest(range(8)) AS idx), LATERAL (SELECT (('0x' || substr(printf('%016x', h), 15 - 2 * idx::INT, 2))::BIGINT) AS band) GROUP BY ALL",
    "near_dup_pairs": f'WITH {_PAIRS} SELECT "left", "right", distance FROM pairs',
    "hamming_profile": f"WITH {_PAIRS} SELECT distance, other, count(*) AS n FROM pairs GROUP BY 1, 2",
    "texture_gate": "SELECT source, CASE WHEN texture IS NULL THEN 'unknown' WHEN texture < 1 THEN 'refused' WHEN texture < 4 THEN 'low' ELSE 'ok' END AS gate, count(*) AS n, round(avg(texture), 6) AS mean_texture FROM images GROUP BY 1, 2",
    "digest_drift": f"SELECT DISTINCT m.row_id, {DIGEST.format('m.sha256')} AS recorded, {DIGEST.format('r.sha256')} AS actual FROM manifest m JOIN manifest_mirror r USING (row_id) WHERE {DIGEST.format('m.sha256')} <> {DIGEST.format('r.sha256')}",
    "provenance": f"""WITH {LISTED_SQL} SELECT s.arm, count(*) AS n, count(*) FILTER (WHERE s.clean_digest IS NULL) AS unstamped, count(*) FILTER (WHERE c.digest IS NULL) AS unresolved,
count(*) FILTER (WHERE s.clean_digest <> c.digest) AS differ FROM listed s LEFT JOIN listed c ON c.name = s.cover AND NOT c.stego WHERE s.stego GROUP BY 1""",
    "two_way_integrity": f"""WITH {LISTED_SQL}, a AS (SELECT digest AS sha256, min(width) AS w FROM listed WHERE NOT stego GROUP BY 1)
SELECT CASE WHEN i.sha256 IS NULL THEN 'left-only' WHEN a.sha256 IS NULL THEN 'right-only' WHEN a.w IS NOT DISTINCT FROM i.width THEN 'same' ELSE 'mismatch' END AS status, count(*) AS n
FROM a FULL JOIN images i ON i.sha256 = a.sha256 GROUP BY 1""",
    "unknown_sources": f"WITH {LISTED_SQL} SELECT cover, count(*) AS n FROM listed WHERE stego AND cover NOT IN (SELECT name FROM listed WHERE NOT stego) GROUP BY 1",
    "uniqueness_checks": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_values, count({c}) - count(DISTINCT {c}) AS n_repeated FROM manifest WHERE arm IS NULL AND source_png IS NULL" for c in ("file", "sha256", "tier_order", "row_id")),
    "corpus_digests": f"""WITH {LISTED_SQL}, p AS (SELECT name, digest, row_number() OVER (ORDER BY name) - 1 AS position FROM listed WHERE NOT stego),
b AS (SELECT position // 4096 AS block, count(*) AS n, sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY position)) AS h FROM p GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b""",
    "manifest_validation": " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n_checked, count(*) FILTER (WHERE {v}) AS n_failed FROM manifest" for k, v in _RULES.items())
    + " UNION ALL SELECT 'nothing was checked', count(*), (count(*) = 0)::BIGINT FROM manifest",
    "validation_problems": _PROBLEMS,
    "licence_summary": f"WITH {LISTED_SQL}, l AS (SELECT {_canon('licence')} AS licence, uploader FROM listed WHERE NOT stego) SELECT licence, count(*) AS n, {_OBL.format('licence')} AS obligation, count(DISTINCT uploader) AS n_uploaders FROM l GROUP BY licence",
    "attribution_share": f"""WITH {LISTED_SQL}, l AS (SELECT {_canon('licence')} AS licence FROM listed WHERE NOT stego), o AS (SELECT licence, {_OBL.format('licence')} AS o FROM l)
SELECT count(*) AS n, count(*) FILTER (WHERE o = 'attribution') AS n_attribution, round(100.0 * count(*) FILTER (WHERE o = 'attribution') / count(*), 1) AS percent,
max(CASE o WHEN 'uncovered' THEN 2 WHEN 'attribution' THEN 1 ELSE 0 END) AS strictest, coalesce(string_agg(DISTINCT CASE WHEN o = 'uncovered' THEN licence END, ',' ORDER BY CASE WHEN o = 'uncovered' THEN licence END), '') AS uncovered FROM o""",
    "licence_cross_check": f"""WITH {LISTED_SQL}, l AS (SELECT *, {_canon('licence')} AS cl FROM listed) SELECT s.cl AS licence, c.cl AS cover_licence, s.cl IS NOT DISTINCT FROM c.cl AS agree, count(*) AS n FROM l s JOIN l c ON c.name = s.cover AND NOT c.stego
WHERE s.stego GROUP BY 1, 2, 3""",
    "name_functions": r"""WITH n AS (SELECT file, regexp_extract(file, '[^/\\]*$') AS f FROM manifest), e AS (SELECT file, f, nullif(lower(regexp_extract(f, '^.+\.([^.]*)$', 1)), '') AS extension FROM n)
SELECT extension, CASE extension WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' ELSE extension END AS format, regexp_full_match(file, '[^/\\\x00-\x1f\x7f]+') AND file NOT IN ('.', '..') AS plain,
count(*) AS n, min(regexp_replace(f, '^(.+)\.[^.]*$', '\1')) AS first_stem FROM e GROUP BY 1, 2, 3""",
    "arm_keys": f"WITH {LISTED_SQL} SELECT printf('%s-%04d', tool, round_even(rate * 1000, 0)::BIGINT) AS key, arm, count(*) AS n FROM listed WHERE stego AND tool IS NOT NULL AND rate IS NOT NULL GROUP BY 1, 2",
    "licence_hosts": "SELECT nullif(lower(regexp_extract(licence_url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '') AS host, count(*) AS n FROM manifest GROUP BY 1",
    "payload_seeds": f"WITH {LISTED_SQL} SELECT name, sha256(concat_ws(chr(31), 'payload-v1', '7', cover, tool, printf('%.6f', rate))) AS seed FROM listed WHERE stego AND rate IS NOT NULL",
    "mirror_conflicts": f"WITH b AS (SELECT row_id, min({PLAIN.format('file')}) AS b FROM manifest_mirror GROUP BY 1) SELECT {PLAIN.format('m.file')} = b AS alike, count(*) AS n FROM manifest m JOIN b USING (row_id) GROUP BY 1",
}
