"""Append logs with repeated keys: which record of a key stands, what is left to do, and merging of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(columns: list[str]) -> Column:
    """How many of the columns are not null."""
    return sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def _pick(log: DataFrame, key: Column, rank: Column) -> DataFrame:
    """One row per key, that of the greatest rank: an aggregation with map-side partials, no window over a hot key."""
    rows = log.filter(key.isNotNull()).select(key.alias("_key"), F.struct(rank.alias("rank"), F.struct(*log.columns).alias("row")).alias("s"))
    best = rows.groupBy("_key").agg(F.max_by("s.row", "s.rank").alias("row"))
    return best.select(F.col("_key").alias("key"), "row.*")


def most_complete(log: DataFrame, key: Column, fields: list[str], position: str) -> DataFrame:
    """The record with the most non-null ``fields`` of each key, the first of equals; as ``key`` and the log's columns.

    Null keys have none. ``position`` must be unique; an empty log gives no rows.
    """
    return _pick(log, key, F.struct(filled(fields).alias("n"), (-F.col(position)).alias("p")))


def last_record(log: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The last record of each key by ``order`` (nulls first); as ``key`` and the log's columns."""
    return _pick(log, key, F.struct(*order))


def left_to_do(wanted: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """What is wanted and not yet done."""
    return wanted.join(done.select(on).distinct(), on, "left_anti")


def divergence(before: DataFrame, now: DataFrame, position: str, ident: str) -> DataFrame:
    """``position, was, is``: positions where a resumed log names another item than the present order does."""
    a = before.select(F.col(position).alias("position"), F.col(ident).alias("was"))
    b = now.select(F.col(position).alias("position"), F.col(ident).alias("is"))
    return a.join(b, "position", "left").filter(~F.col("was").eqNullSafe(F.col("is")))


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """Rows of all shards once per key, with ``conflict``: whether the shards disagree about it (null-safe, all columns)."""
    rows = shards[0]
    for shard in shards[1:]:
        rows = rows.unionByName(shard)
    others = [c for c in rows.columns if c != key]
    packed = rows.select(key, F.struct(*others).alias("row"))
    merged = packed.groupBy(key).agg(F.min("row").alias("row"), (F.min("row") != F.max("row")).alias("conflict"), F.count("*").alias("n_shards"))
    return merged.select(key, "row.*", "conflict", "n_shards")


def overlay(log: DataFrame, late: DataFrame, position: str) -> DataFrame:
    """A log with late records behind it: their positions follow the log's last."""
    last = log.agg(F.coalesce(F.max(position), F.lit(0)).alias("_last"))
    moved = late.crossJoin(F.broadcast(last)).withColumn(position, F.col(position) + F.col("_last")).drop("_last")  # one row
    return log.unionByName(moved.select(*log.columns))


def first_seen(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """``key, position``: each key once, at its first position."""
    return rows.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.min(position).alias("position"))
