"""Covers behind images: how one is known, which were replaced, what takes their place, and the clean halves of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import cut, join_facts


def cover_map(rows: DataFrame, half: str, cover: str) -> DataFrame:
    """``half, cover, n_covers``: the cover each clean half is recorded against, and against how many different ones.

    The least one stands for several. A map is a function of the half only where ``n_covers`` is 1 (see ``conflicts``). Rows
    without either are left out; no rows give no map.
    """
    known = rows.filter(F.col(half).isNotNull() & F.col(cover).isNotNull())
    return known.groupBy(half, cover).agg(F.lit(1).alias("_one")).groupBy(half).agg(F.min(cover).alias(cover), F.count("*").alias("n_covers"))


def conflicts(mapped: DataFrame) -> DataFrame:
    """Halves recorded against more than one cover: what hangs on them can't be attributed."""
    return mapped.filter("n_covers > 1")


def resolved(rows: DataFrame, mapped: DataFrame, half: str, cover: str) -> DataFrame:
    """Adds ``known_cover`` and ``how``: ``direct`` (the row names it), ``via half`` (its half is mapped to one), ``ambiguous`` (to
    several; no cover is given) or ``unresolved``."""
    facts = mapped.select(half, F.col(cover).alias("_mapped"), F.col("n_covers").alias("_n"))
    joined = join_facts(rows, facts, half, "left")
    direct = F.col(cover).isNotNull()
    how = F.when(direct, "direct").when(F.col("_n") == 1, "via half").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return joined.withColumn("how", how).withColumn("known_cover", F.coalesce(cover, F.when(F.col("_n") == 1, F.col("_mapped")))).drop("_mapped", "_n")


def with_clean_arms(stego: DataFrame, arm: str, half: str, group: str) -> DataFrame:
    """``arm, image, clean``: the images of every arm, and each distinct clean half once, as the arm ``clean-<group>``.

    ``stego`` has ``image`` beside the columns named. A half that several groups share is one of each. Null halves add nothing;
    a null group is ``none``.
    """
    own = stego.select(F.col(arm).alias("arm"), "image", F.lit(False).alias("clean"))
    halves = stego.filter(F.col(half).isNotNull()).select(F.concat(F.lit("clean-"), F.coalesce(F.col(group), F.lit("none"))).alias("arm"), F.col(half).alias("image"), F.lit(True).alias("clean"))
    return own.unionByName(halves.distinct())


def doomed(rows: DataFrame, fields: list[Column], gone: DataFrame, name: str) -> DataFrame:
    """Adds ``doomed``: whether any of the fields names one of ``gone.name``; a pair with one stale half is void as a whole."""
    names = gone.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct().withColumn("_gone", F.lit(True))
    out = rows
    for i, field in enumerate(fields):
        out = join_facts(out.withColumn("_name", field), names, "_name", "left").withColumn(f"_g{i}", F.coalesce("_gone", F.lit(False))).drop("_name", "_gone")
    return out.withColumn("doomed", F.greatest(F.lit(False), *[F.col(f"_g{i}") for i in range(len(fields))])).drop(*[f"_g{i}" for i in range(len(fields))])


def log_checks(log: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``name, n, status`` of the names in a log of replacements: ``unknown`` to the rows, ``repeated`` or ``ok``; nulls are ``unnamed``."""
    each = log.groupBy(name).agg(F.count("*").alias("n"))
    held = rows.filter(F.col(name).isNotNull()).select(name).distinct().withColumn("_held", F.lit(True))
    status = F.when(F.col(name).isNull(), "unnamed").when(F.col("_held").isNull(), "unknown").when(F.col("n") > 1, "repeated").otherwise("ok")
    return each.join(held, name, "left").select(name, "n", status.alias("status"))


def spliced(places: DataFrame, place: str, candidates: DataFrame, order: str) -> DataFrame:
    """``place`` and the columns of the candidate that takes it: the first place gets the first candidate, and so on.

    ``place`` and ``order`` are unique. Places beyond the last candidate are kept with nulls, candidates beyond the last place
    are left out. Positions are counted over ranges, not in one task.
    """
    from tallyglass.operators.assign import dense_position

    a = dense_position(places.select(place), place)
    b = dense_position(candidates, order).withColumnRenamed("position", "_at")
    return a.join(b, F.col("position") == F.col("_at"), "left").drop("position", "_at")


def checked_tally(labels: DataFrame, predictions: DataFrame, group: list[str], key: str) -> DataFrame:
    """Confusion counts per group, with ``status``: ``length-mismatch`` if the sides differ in number or key, ``empty`` without rows.

    ``labels``: ``group, key, label``; ``predictions``: ``group, key, predicted``; keys are unique in a group. Refused groups
    have null counts. One class alone is a measurement and not refused. A null label or prediction counts as missing.
    """
    a = labels.filter("label is not null").select(*group, key, "label")
    b = predictions.filter("predicted is not null").select(*group, key, "predicted")
    named = labels.select(*group).unionByName(predictions.select(*group)).distinct()
    y, p = F.col("label"), F.col("predicted")
    counts = a.join(b, [*group, key], "full").groupBy(*group).agg(
        F.count("*").alias("_n"), F.count_if(y.isNull() | p.isNull()).alias("_odd"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    )
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "empty").when(F.col("_odd") > 0, "length-mismatch").otherwise("ok")
    both = named.join(counts, group, "left").withColumn("status", status)
    return both.select(*group, "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("tp", "fp", "tn", "fn")])


def selection(wanted: DataFrame, registry: DataFrame, kind: str | None = None) -> DataFrame:
    """``name, status`` of detectors asked for by name: ``ok``, ``unknown`` or, where ``kind`` is given, ``other kind``.

    ``wanted``: ``name``; ``registry``: ``name, kind`` (unique). No names asked for select all of the registry's, of that kind.
    """
    held = registry.select("name", F.col("kind").alias("_kind"))
    if wanted.isEmpty():
        chosen = held if kind is None else held.filter(F.col("_kind") == kind)
        return chosen.select("name", F.lit("ok").alias("status"))
    status = F.when(F.col("_kind").isNull(), "unknown").when(F.lit(kind is not None) & (F.col("_kind") != F.lit(kind)), "other kind").otherwise("ok")
    return wanted.select("name").distinct().join(held, "name", "left").select("name", status.alias("status"))


def report_groups(rows: DataFrame) -> DataFrame:
    """``configuration, corpus, digest, n, place``: groups of results in report order: named corpora before custom ones, then by
    corpus name and digest. One name with two digests is two corpora. The table of corpora is small beside the results."""
    rank = F.when(F.col("configuration") == "named", 0).otherwise(1)
    each = cut(rows.groupBy("configuration", "corpus", "digest").agg(F.count("*").alias("n")), "groups")
    from tallyglass.operators.assign import dense_position

    keyed = each.withColumn("_order", F.struct(rank, "corpus", "digest"))
    return dense_position(keyed, "_order").withColumnRenamed("position", "place").drop("_order")
