"""Checks and rewrites around a release: stamping, credits, packed members, renamed digests, derived figures, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import join_facts


def stamped(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``known`` (``key, column``; unique) where it differs, and ``written``: whether it was.

    Keys that aren't known keep what they have. Null-safe: a missing value is written, an equal one is not.
    """
    want = known.select(key, F.col(column).alias("_want"))
    joined = join_facts(rows, want, key, "left")
    write = F.col("_want").isNotNull() & ~F.col(column).eqNullSafe(F.col("_want"))
    return joined.withColumn("written", write).withColumn(column, F.when(write, F.col("_want")).otherwise(F.col(column))).drop("_want")


def credit_check(credits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key, n_credits, n_rows, status``: absent, extra and repeated names of a credit list."""
    a, b = credits.groupBy(key).agg(F.count("*").alias("n_credits")), rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    both = a.join(b, key, "full").fillna(0, ["n_credits", "n_rows"])
    status = F.when(F.col("n_credits") == 0, "absent").when(F.col("n_rows") == 0, "extra").when((F.col("n_credits") > 1) | (F.col("n_rows") > 1), "repeated").otherwise("ok")
    return both.withColumn("status", status)


def packed_check(members: DataFrame, truth: DataFrame, key: str, digest: str) -> DataFrame:
    """Packed members against what they should hold: ``key, status`` of ``unknown``, ``unreadable``, ``stale`` or ``ok``; ``missing``
    for a truth that nothing was packed of."""
    m, t = members.select(key, F.col(digest).alias("_m"), F.lit(True).alias("_in")), truth.select(key, F.col(digest).alias("_t"), F.lit(True).alias("_is"))
    both = m.join(t, key, "full")
    status = F.when(F.col("_in").isNull(), "missing").when(F.col("_is").isNull(), "unknown").when(F.col("_m").isNull(), "unreadable").when(F.col("_m") != F.col("_t"), "stale").otherwise("ok")
    return both.select(key, status.alias("status"))


def retargeted(lines: DataFrame, renames: DataFrame) -> DataFrame:
    """Digest lines ``digest, name`` with names replaced through ``old, new``; unmapped lines stay as they are."""
    mapped = lines.join(renames.select(F.col("old").alias("name"), "new"), "name", "left")
    return mapped.select("digest", F.coalesce("new", "name").alias("name"))


def sum_lines(files: DataFrame) -> DataFrame:
    """Lines of a digest list, ``digest  name``, in the order of the names."""
    return files.orderBy("name").select(F.concat_ws("  ", "digest", "name").alias("line"))


def contaminated(trained_on: Column, aliases: Column) -> Column:
    """Whether a declared training corpus is one of the corpus' names, trimmed and without regard to case; blanks never match."""
    plain = F.lower(F.trim(trained_on))
    return F.coalesce(F.exists(aliases, lambda a: (F.lower(F.trim(a)) == plain) & (F.trim(a) != "")), F.lit(False))


def firing(thresholds: dict[str, float]) -> Column:
    """Names of the detectors whose score is strictly beyond their threshold, in order; nulls don't fire."""
    each = [F.when(F.col(c) > t, F.lit(c)) for c, t in sorted(thresholds.items())]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def readable(formats: Column, fmt: Column) -> Column:
    """Whether a detector reads a format: none declared or an unknown format always passes; ``jpg`` is ``jpeg``."""
    norm = lambda c: F.when(F.lower(c) == "jpg", "jpeg").otherwise(F.lower(c))
    return (F.size(formats) == 0) | fmt.isNull() | F.exists(formats, lambda f: norm(f) == norm(fmt))


def job_plan(schemes: DataFrame, rates: DataFrame, count: int) -> DataFrame:
    """Every scheme at every rate with its estimated seconds; both sides are small configuration tables."""
    return schemes.crossJoin(F.broadcast(rates)).withColumn("seconds", F.col("seconds_each") * count)


def raised_floors(coverage: DataFrame) -> DataFrame:
    """Per component: percent covered (100 of nothing), the floor raised to its whole part but never lowered, and a verdict."""
    pct = F.coalesce(F.try_divide(100.0 * F.sum("covered"), F.sum("total")), F.lit(100.0))
    per = coverage.groupBy("component").agg(pct.alias("percent"), F.max("floor").alias("floor"))
    return per.select("component", "percent", "floor", F.greatest("floor", F.floor("percent").cast("double")).alias("new_floor"), F.when(F.col("percent") >= F.col("floor"), "ok").otherwise("below").alias("verdict"))


def stale_numbers(claims: DataFrame, figures: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Numbers in sentences that name a figure but are off by more than the tolerance: ``name, stated, value``."""
    numbers = claims.select("name", F.explode(F.regexp_extract_all(F.replace("sentence", F.lit(","), F.lit("")), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.]*\d)"), F.lit(1))).alias("stated"))
    return numbers.select("name", F.col("stated").cast("double").alias("stated")).join(figures, "name").filter(F.abs(F.col("stated") - F.col("value")) > tolerance * F.abs("value"))


def migrated_plugins(plugins: Column, routes: dict[str, tuple[str, str]]) -> Column:
    """An array of plugins whose ``route`` is replaced by what it stood for: ``name, pinned_by, isolation``; unknown routes give nulls."""
    table = F.create_map(*[x for k, (a, b) in routes.items() for x in (F.lit(k), F.struct(F.lit(a).alias("pinned_by"), F.lit(b).alias("isolation")))])
    return F.transform(plugins, lambda p: F.struct(p["name"].alias("name"), table[p["route"]]["pinned_by"].alias("pinned_by"), table[p["route"]]["isolation"].alias("isolation")))
