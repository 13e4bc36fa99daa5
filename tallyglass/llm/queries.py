"""Queries of the training-data operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.names import plain_digest
from tallyglass.llm import abuse, history, leakage, mixing, sample, splits
from tallyglass.shared import cut, new_folder
from tallyglass.sources.tables import table

SAMPLE_RATE = 0.1
SAMPLE_SALT = "sample-v1"


def p4_sample(spark, folder):
    picked = sample.frozen_bottom_k(table(spark, folder, "manifest"), "batch_no", plain_digest("sha256"), "tier_order", "row_id", SAMPLE_RATE, SAMPLE_SALT)
    return picked.select(F.col("batch").alias("batch_no"), F.col("identity").alias("sha256"), F.col("order").alias("tier_order"), "row_id")


def p5_found(spark, folder):
    return splits.torn(table(spark, folder, "manifest"))


def p5_split_assignment(spark, folder):
    return splits.assign(table(spark, folder, "manifest"), splits.SHARES)


def p5_shares(spark, folder):
    """The shares reached, per side, overall and per kind of row."""
    manifest = table(spark, folder, "manifest")
    dealt = splits.assign(manifest, splits.SHARES)
    return dealt.groupBy("side").agg(F.count("*").alias("n_rows"), F.count_distinct("family").alias("n_families"))


def p5_checks(spark, folder):
    """What must hold of the assignment: rows and families dealt, families on two sides, sides off their share by over a percent."""
    dealt = cut(splits.assign(table(spark, folder, "manifest"), splits.SHARES), "dealt")
    torn = dealt.groupBy("family").agg((F.min("side") != F.max("side")).alias("torn")).agg(F.count("*").alias("n_families"), F.count_if("torn").alias("n_torn"))
    goal = F.create_map(*[F.lit(x) for pair in splits.SHARES.items() for x in pair])[F.col("side")]
    whole = dealt.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_distinct"))
    sides = dealt.groupBy("side").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole)).agg(F.count_if(F.abs(F.col("n") / F.col("n_rows") - goal) > 0.01).alias("n_off"))  # one row
    return whole.crossJoin(F.broadcast(torn)).crossJoin(F.broadcast(sides))  # one row each


def p6_found(spark, folder):
    """Each batch is checked against all batches before it and itself, then accepted, in the order of arrival."""
    rows = cut(history.clean_rows(table(spark, folder, "manifest"), table(spark, folder, "images")), "clean")
    found = history.arrivals(history.HistoryIndex(spark, new_folder(spark, "history")), rows)
    return spark.createDataFrame([], "row_id_a long, row_id_b long") if found is None else found


def _leaks(spark, folder):
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]  # fixed test items
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", items)


def p7_found(spark, folder):
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_leaks(spark, folder):
    return _leaks(spark, folder).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("similarity").alias("similarity"))


MIX_SEED = "mix-v1"


def _mix(spark, folder):
    targets = table(spark, folder, "mix_targets")
    wanted = {r.source: (r.target_share, r.max_repeats) for r in targets.select(mixing.plain_source("source").alias("source"), "target_share", "max_repeats").collect()}  # the request
    sizes = cut(mixing.token_sizes(table(spark, folder, "documents"), "doc_id", "text", mixing.plain_source("source")), "sizes")
    return mixing.mix(sizes, wanted, MIX_SEED), targets


def p8_mix(spark, folder):
    return _mix(spark, folder)[0]


def p8_shares(spark, folder):
    return mixing.shares(*_mix(spark, folder))


def p8_checks(spark, folder):
    """What must hold of the mix: sources in it, documents of others, too many copies, documents listed twice, shares off by over a percent."""
    mixed, targets = _mix(spark, folder)
    mixed = cut(mixed, "mix")
    limits = F.broadcast(targets.select(mixing.plain_source("source").alias("source"), "target_share", "max_repeats"))  # the request
    per = mixed.join(limits, "source", "left").groupBy("source", "target_share").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"), (F.count("*") - F.count_distinct("doc_id")).alias("twice")
    )
    whole = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("target_share").alias("all_shares"))
    off = F.abs(F.col("tokens") / F.col("all_tokens") - F.col("target_share") / F.col("all_shares")) > 0.01
    return per.crossJoin(F.broadcast(whole)).agg(  # one row
        F.count("*").alias("n_sources"), F.count_if(F.col("target_share").isNull()).alias("n_untargeted"), F.sum("over").alias("n_over"), F.sum("twice").alias("n_twice"), F.count_if(off).alias("n_off")
    )


def _scored(spark, folder):
    documents = table(spark, folder, "documents")
    model = abuse.train(documents, table(spark, folder, "moderation_labels"))
    return abuse.score(documents.withColumn("source", mixing.plain_source("source")), model, "source")


def p9_found(spark, folder):
    return _scored(spark, folder).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark, folder):
    return _scored(spark, folder)


def p9_rates(spark, folder):
    return abuse.rates(_scored(spark, folder))


QUERIES = {"p4_sample": p4_sample, "p5_found": p5_found, "p5_split_assignment": p5_split_assignment, "p5_shares": p5_shares, "p5_checks": p5_checks, "p6_found": p6_found, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

_DIGEST = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^sha256:', '')"
_PLAIN = r"lower(regexp_extract(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[^/\\]*$'))"

_FAMILIES = f"""
WITH RECURSIVE rows_ AS (
       SELECT CASE WHEN arm IS NULL AND source_png IS NULL THEN {_PLAIN.format("file")} ELSE {_PLAIN.format("source_png")} END AS name, row_id,
              lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS side, CASE WHEN arm IS NULL AND source_png IS NULL THEN uploader END AS owner
       FROM manifest WHERE NOT (arm IS NOT NULL AND source_png IS NULL)),
     pairs AS (SELECT DISTINCT name, owner FROM rows_ WHERE owner IS NOT NULL),
     links AS (SELECT DISTINCT a.owner AS a, b.owner AS b FROM pairs a JOIN pairs b USING (name) WHERE a.owner <> b.owner),
     reach AS (SELECT DISTINCT owner AS a, owner AS b FROM pairs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
     label AS (SELECT a AS owner, min(b) AS label FROM reach GROUP BY 1),
     family AS (SELECT name, min(label) AS label FROM pairs JOIN label USING (owner) GROUP BY 1),
     total AS (SELECT coalesce('o:' || label, 'n:' || rows_.name) AS family, min(row_id) AS family_row_id, count(DISTINCT side) AS sides, count(*) AS n
               FROM rows_ LEFT JOIN family USING (name) GROUP BY 1)
"""

ORACLES = {
    "p4_sample": f"""
WITH listed AS (SELECT {_DIGEST.format("sha256")} AS sha256, batch_no, tier_order, row_id FROM manifest),
     firsts AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY batch_no, tier_order NULLS LAST, row_id) AS nth FROM listed),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY substr(sha256('{SAMPLE_SALT}:' || sha256), 1, 15), sha256) AS r,
                       count(*) OVER (PARTITION BY batch_no) AS n FROM firsts WHERE nth = 1)
SELECT batch_no, sha256, tier_order, row_id FROM ranked WHERE r <= ceil(n * {SAMPLE_RATE}::DECIMAL(18, 12))""",
    "p5_found": _FAMILIES + "SELECT family_row_id FROM total WHERE sides > 1",
    "p5_checks": _FAMILIES + "SELECT sum(n)::BIGINT AS n_rows, sum(n)::BIGINT AS n_distinct, count(*) AS n_families, 0 AS n_torn, 0 AS n_off FROM total",
    "p8_checks": """
WITH sources AS (SELECT DISTINCT replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '_', '-') AS source FROM documents WHERE text <> ''),
     asked AS (SELECT replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '_', '-') AS source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0)
SELECT count(*) AS n_sources, 0 AS n_untargeted, 0 AS n_over, 0 AS n_twice, 0 AS n_off FROM asked JOIN sources USING (source)""",
    "p6_found": f"""
WITH clean AS (SELECT row_id, batch_no, {_DIGEST.format("m.sha256")} AS digest FROM manifest m WHERE arm IS NULL AND source_png IS NULL),
     printed AS (SELECT c.*, i.dhash, i.phash FROM clean c LEFT JOIN images i ON i.sha256 = c.digest),
     same AS (SELECT a.row_id AS x, b.row_id AS y FROM clean a JOIN clean b ON a.digest = b.digest AND a.row_id < b.row_id
              WHERE greatest(a.batch_no, b.batch_no) > 0),
     near AS (SELECT least(a.row_id, b.row_id) AS x, greatest(a.row_id, b.row_id) AS y FROM printed a JOIN printed b
              ON a.row_id < b.row_id AND greatest(a.batch_no, b.batch_no) > 0
              AND bit_count(xor(a.dhash, b.dhash)) <= 6 AND bit_count(xor(a.phash, b.phash)) <= 6)
SELECT x AS row_id_a, y AS row_id_b FROM same UNION SELECT x, y FROM near""",
}
