"""Deterministic assignment: tiers, splits, folds, shards, samples, caps and quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyglass.shared import rank_by_hash, running_totals

#: Tiers by number of covers.
TIERS = {200: "nano", 1000: "lite", 10000: "core", 100000: "full"}


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_unit(salt: str, key: Column | str) -> Column:
    """The first 15 hex digits of SHA-256 of ``salt:key``, as a bigint below 2^60; null keys have none."""
    key = _as_column(key)
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 15), 16, 10).cast("long")


def stable_split(salt: str, key: Column | str, test_fraction: float) -> Column:
    """``test`` for keys whose salted hash lies below the fraction, else ``train``: the same whatever else is listed."""
    return F.when(hash_unit(salt, key) < int(test_fraction * 2**60), "test").when(_as_column(key).isNotNull(), "train")


def hash_fold(key: Column | str, folds: int) -> Column:
    """Fold from the first 8 hex digits of SHA-256 of the key."""
    return F.pmod(F.conv(F.substring(F.sha2(_as_column(key), 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def tier_prefix(rows: DataFrame, order: str, size: int) -> DataFrame:
    """The tier of ``size``: rows whose dense order lies below it. Pushed down to the scan."""
    return rows.filter((F.col(order) >= 0) & (F.col(order) < size))


def tier_name(size: Column | str) -> Column:
    """Name of a tier by its size, else ``custom``."""
    size = _as_column(size)
    out = None
    for n, name in TIERS.items():
        out = F.when(size == n, name) if out is None else out.when(size == n, name)
    return out.otherwise("custom")


def density(rows: DataFrame, order: str) -> DataFrame:
    """One row: how far ``order`` is from a dense ``0 .. n - 1``: ``n, n_null, n_distinct, low, high, n_repeated, n_missing``.

    Gaps are counted, not listed, from two partial aggregations.
    """
    each = rows.groupBy(order).agg(F.count("*").alias("k"))
    o = F.col(order)
    return each.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(o.isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.count(o).alias("n_distinct"),
        F.min(o).alias("low"), F.max(o).alias("high"), F.coalesce(F.sum(F.when(o.isNotNull(), F.col("k") - 1)), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.max(o) + 1 - F.count(F.when(o >= 0, o)), F.lit(0)).alias("n_missing"),
    )


def extend_order(rows: DataFrame, order: str, key: str, seed: str) -> DataFrame:
    """Rows keep their ``order``; rows without one are appended behind the last in the order of their seeded hash."""
    last = rows.agg(F.coalesce(F.max(order), F.lit(-1)).cast("long").alias("_last"))
    new = rank_by_hash(rows.filter(F.col(order).isNull()).withColumn("_h", hash_unit(seed, F.col(key).cast("string")) * 8), [], "_h", [key], out="_r")
    placed = new.crossJoin(F.broadcast(last)).withColumn(order, F.col("_last") + 1 + F.col("_r")).select(*rows.columns)  # one row
    return rows.filter(F.col(order).isNotNull()).withColumn(order, F.col(order).cast("long")).unionByName(placed)


def dense_position(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``position``, the dense 0-based rank by the unique column ``order``, over ranges instead of one task."""
    return running_totals(rows.withColumn("_one", F.lit(1).cast("long")), [], order, {"position": "_one"}).withColumn("position", F.col("position") - 1).drop("_one")


def shard(position: Column | str, per_shard: int) -> Column:
    """Contiguous shard of a dense position."""
    return F.floor(_as_column(position) / per_shard).cast("long")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows (all, if fewer) with the smallest seeded hashes, ties by key: top-n of each task, then of all."""
    return rows.withColumn("_h", hash_unit(seed, F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")


def spread(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows: every group once before any group twice, groups by their first row.

    A round-robin of ``most`` rows needs at most ``most`` rows of a group, so each task of the window sees no more than
    that after its limit; groups may be of any size.
    """
    nth = F.row_number().over(W.partitionBy(group).orderBy(order))
    first = rows.groupBy(group).agg(F.min(order).alias("_first"))
    few = rows.withColumn("_nth", nth).filter(F.col("_nth") <= most)  # Spark cuts each group while sorting (window group limit)
    return few.join(first, group).orderBy("_nth", "_first").limit(most).withColumn("round", F.col("_nth")).drop("_nth", "_first")


def capped(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key in order; null keys are exempt, 0 switches the cap off."""
    if most == 0:
        return rows
    ranked = rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked.filter(F.col("_n") <= most).drop("_n").unionByName(rows.filter(F.col(key).isNull()))


def sequential(rows: DataFrame, order: str, decide, kinds: list[str]) -> DataFrame:
    """Decisions that depend on earlier acceptances: ``order, accepted, refusal``, by one ordered pass.

    ``decide(*values of kinds)`` is made fresh per run by the factory that is passed in and keeps its tallies. Such a chain
    is sequential by definition; only the order and the columns it looks at are sent, in Arrow batches, as a stream.
    """

    def run(batches):
        chosen = decide()
        for pdf in batches:
            out = [chosen(*values) for values in zip(*[pdf[c] for c in kinds], strict=True)]
            yield pd.DataFrame({order: pdf[order], "accepted": [r is None for r in out], "refusal": out})

    kind = rows.schema[order].dataType.simpleString()
    ordered = rows.select(order, *kinds).coalesce(1).sortWithinPartitions(order)
    return ordered.mapInPandas(run, f"{order} {kind}, accepted boolean, refusal string")


def two_way_caps(caps: dict[str, int]):
    """Factory for ``sequential``: per column a cap on accepted rows per value; nulls are exempt, 0 switches a cap off."""

    def make():
        held = {c: {} for c in caps}

        def decide(*values):
            pairs = list(zip(caps, values, strict=True))
            for c, v in pairs:
                if caps[c] and v is not None and v == v and held[c].get(v, 0) >= caps[c]:
                    return c
            for c, v in pairs:
                held[c][v] = held[c].get(v, 0) + 1
            return None

        return decide

    return make


def share_quota(share: float, floor: int):
    """Factory for ``sequential``: a value is refused if it would hold more than ``share`` of the accepted rows, once there
    are ``floor`` of them; nulls are exempt."""

    def make():
        held: dict = {}
        total = 0

        def decide(value):
            nonlocal total
            known = value is not None and value == value
            if known and total >= floor and held.get(value, 0) + 1 > share * (total + 1):
                return "share"
            total += 1
            if known:
                held[value] = held.get(value, 0) + 1
            return None

        return decide

    return make
