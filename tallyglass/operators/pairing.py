"""Stego images and their covers: sides, leaks, discipline and whether a pair differs in one thing only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import join_facts


def uniform(column: Column | str) -> Column:
    """Aggregate: ``unstated`` without values, the value if there is one, else ``mixed``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == 0, "unstated").when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise("mixed")


def examples(rows: DataFrame, group: str, column: str, most: int = 3) -> DataFrame:
    """``group, examples``: the ``most`` smallest distinct values of each group, in order; null values are none.

    Values are made distinct with map-side partials and each task keeps the first ``most`` of a group before the shuffle (the
    engine's limit of ranked groups), so no buffer grows with a group.
    """
    from pyspark.sql import Window as W

    each = rows.filter(F.col(column).isNotNull()).select(group, F.col(column).alias("_x")).distinct()
    first = each.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("_x"))).filter(F.col("_n") <= most)
    return first.groupBy(group).agg(F.array_sort(F.collect_list("_x")).alias("examples"))


def with_cover(listed: DataFrame) -> DataFrame:
    """Stego rows with their cover's row: ``cover_row, cover_side, cover_digest, cover_width, cover_height`` (null if not listed)."""
    covers = listed.filter("not stego").select(
        F.col("name").alias("cover"), F.col("row_id").alias("cover_row"), F.col("side").alias("cover_side"), F.col("digest").alias("cover_digest"),
        F.col("width").alias("cover_width"), F.col("height").alias("cover_height"),
    )
    return join_facts(listed.filter("stego"), covers, "cover", "left")


def inherited_side(pairs: DataFrame) -> DataFrame:
    """Adds ``selected_side``: the cover's side, or the row's own where the cover has none."""
    return pairs.withColumn("selected_side", F.coalesce("cover_side", "side"))


def leaks(pairs: DataFrame) -> DataFrame:
    """Pairs on two sides; both must state one."""
    return pairs.filter("side <> cover_side")


def pair_check(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """Adds ``check``: how the stego row compares with its clean half.

    A stated clean digest is looked up among ``digests`` (``digest, half_width, half_height``, unique) and, if absent, leaves the pair
    ``uncomparable``; only rows without one fall back to the cover's name. ``same`` or ``differs`` tells of the size.
    """
    looked = join_facts(pairs, digests.withColumnRenamed("digest", "clean_digest"), "clean_digest", "left")
    stated = F.col("clean_digest").isNotNull()
    width = F.when(stated, F.col("half_width")).otherwise(F.col("cover_width"))
    height = F.when(stated, F.col("half_height")).otherwise(F.col("cover_height"))
    return looked.withColumn(
        "check", F.when(width.isNull() | height.isNull() | F.col("width").isNull(), "uncomparable").when((F.col("width") == width) & (F.col("height") == height), "same").otherwise("differs")
    )


def pairing_verdict(checked: DataFrame, group: list[str]) -> DataFrame:
    """Per group: ``confounded`` if any pair differs, else ``single-variable`` if any was compared, else ``unverified``."""
    n = lambda v: F.count_if(F.col("check") == v)
    return checked.groupBy(*group).agg(
        F.when(n("differs") > 0, "confounded").when(n("same") > 0, "single-variable").otherwise("unverified").alias("pairing"),
        (n("same") + n("differs")).alias("compared"), n("uncomparable").alias("missing"), n("differs").alias("differed"),
    )


def discipline(listed: DataFrame, group: list[str]) -> DataFrame:
    """Per group ``by-cover`` if any row states a side, else ``n/a``."""
    return listed.groupBy(*group).agg(F.when(F.count("side") > 0, "by-cover").otherwise("n/a").alias("split_discipline"))


#: How units of a rate are called in results.
UNITS = {"bits per pixel": "bpp", "bpp": "bpp"}


def arm_facts(listed: DataFrame) -> DataFrame:
    """Per arm what its rows agree on: embedder (tool, else the arm's name), rate with its unit, domain.

    A rate is stated only if all rows that state one agree on value and unit and the unit is known: bits per pixel, or a
    fraction of some capacity.
    """
    stego = listed.filter("stego and arm is not null")
    unit = F.when(F.lower("rate_unit").isin(list(UNITS)), "bpp").when(F.lower("rate_unit").contains("capacity"), "fraction")
    seen = stego.withColumn("unit", unit).groupBy("arm").agg(
        F.count("*").alias("n"), uniform("tool").alias("tool"), uniform("domain").alias("domain"), uniform("unit").alias("unit"),
        F.min("rate").alias("low"), F.max("rate").alias("high"), F.count_if(F.col("rate_unit").isNotNull() & F.col("unit").isNull()).alias("odd"),
    )
    agreed = (F.col("low") == F.col("high")) & F.col("unit").isin("bpp", "fraction") & (F.col("odd") == 0)
    return seen.select(
        "arm", "n", F.when(F.col("tool") == "unstated", F.col("arm")).otherwise(F.col("tool")).alias("embedder"),
        F.when(agreed, F.col("low")).alias("rate"), F.when(agreed, F.col("unit")).alias("unit"), "domain",
    )
