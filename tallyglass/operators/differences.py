"""Row and field differences between two copies of one dataset, by merging sorted key ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, SIDE = "_key", "_side"


def _unequal(column: pa.ChunkedArray, first: np.ndarray) -> np.ndarray:
    """For each row, whether its value differs from that of its group's first row; null and NaN equal only themselves."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    other = flat.take(pa.array(first))
    differs = pc.not_equal(flat, other)
    if pa.types.is_floating(flat.type):
        nan, nan2 = pc.is_nan(flat), pc.is_nan(other)
        differs = pc.or_(pc.and_(differs, pc.invert(pc.and_(nan, nan2))), pc.xor(nan, nan2))
    nulls, nulls2 = pc.is_null(flat), pc.is_null(other)
    return np.asarray(pc.or_(pc.fill_null(differs, False), pc.xor(nulls, nulls2)))


def _merger(fields: list[str]):
    """Streams one sorted key range; memory holds one batch and one open key's first row, however many copies a key has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the open key's first row
        sides, flags = np.zeros(2, bool), np.zeros(len(fields), bool)  # of the open key
        edge = True  # the open key may continue a range that another task began

        def result(keys: pa.Array, has: np.ndarray, diff: np.ndarray, at_edge: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
            shown = at_edge  # a key at either end of a range may go on in the next: its values travel for the last step
            mask = pa.array(~shown)
            arrays = [keys, pa.array(has[:, 0]), pa.array(has[:, 1]), pa.array(at_edge)]
            arrays += [pa.array(diff[:, i]) for i in range(len(fields))]
            for name in fields:
                values = rows.column(name).combine_chunks()
                arrays.append(pc.if_else(mask, pa.scalar(None, values.type), values))
            names = [KEY, "_left", "_right", "_edge", *[f"_d{i}" for i in range(len(fields))], *fields]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            carried = held is not None
            if carried:
                table = pa.concat_tables([held, table]).combine_chunks()
            keys = table.column(KEY).combine_chunks()
            n = table.num_rows
            change = np.ones(n, bool)
            if n > 1:
                same = pc.equal(keys.slice(1), keys.slice(0, n - 1))
                change[1:] = ~np.asarray(pc.fill_null(same, False))
            starts = np.flatnonzero(change)
            first = starts[np.cumsum(change) - 1]
            side = np.asarray(table.column(SIDE).combine_chunks()).astype(bool)
            has = np.stack([np.logical_or.reduceat(~side, starts), np.logical_or.reduceat(side, starts)], 1)
            diff = np.stack([np.logical_or.reduceat(_unequal(table.column(f), first), starts) for f in fields], 1)
            at_edge = np.zeros(len(starts), bool)
            at_edge[0] = edge
            if carried:
                has[0] |= sides
                diff[0] |= flags
            sides, flags = has[-1].copy(), diff[-1].copy()
            held = table.slice(int(starts[-1]), 1)
            if len(starts) > 1:
                keep = np.asarray(at_edge[:-1] | diff[:-1].any(1) | ~has[:-1].all(1))
                pick = np.flatnonzero(keep)
                if len(pick):
                    at = pa.array(starts[:-1][pick])
                    yield result(keys.take(at), has[:-1][pick], diff[:-1][pick], at_edge[:-1][pick], table.take(at))
                edge = False
        if held is not None:
            yield result(held.column(KEY).combine_chunks(), sides[None, :], flags[None, :], np.array([True]), held)

    return merge


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_name: str = "only_left", right_name: str = "only_right") -> DataFrame:
    """``key, difference``: keys of one side only, and the fields whose values differ in any copy of a key.

    Both copies go through one range exchange on ``(key, hash of the row)``, so they share its split points; each range is
    sorted and merged as a stream that keeps one row. A key with very many copies spreads over several ranges: what a range
    knows of its first and last key is combined in a last, small aggregation (two rows a range). Values are compared
    exactly; null equals null only, NaN equals NaN, binary and text by bytes. With copies on both sides a field differs if
    any two copies of the key differ in it. A null key is a key like any other. Empty tables give all rows of the other
    side as missing; two empty ones give no rows. Columns outside ``fields`` aren't read and may have any names.
    """
    plain = [f"_f{i}" for i in range(len(fields))]

    def side(df: DataFrame, value: bool) -> DataFrame:
        return df.select(F.col(key).alias(KEY), F.lit(value).alias(SIDE), *[F.col(c).alias(p) for c, p in zip(fields, plain, strict=True)])

    both = side(left, False).unionByName(side(right, True))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    spread = both.withColumn("_h", F.xxhash64(*plain))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(n, KEY, "_h").sortWithinPartitions(KEY, "_h").drop("_h")
    schema = T.StructType(
        [T.StructField(KEY, kinds[KEY])]
        + [T.StructField(c, T.BooleanType()) for c in ("_left", "_right", "_edge", *[f"_d{i}" for i in range(len(fields))])]
        + [T.StructField(p, kinds[p]) for p in plain]
    )
    merged = ranged.mapInArrow(_merger(plain), schema)
    # A row is kept for each key at a range's edge and each key with a difference; only edge keys can have several.
    def differs(i: int):
        p = plain[i]
        shown = F.col("_edge")
        unlike = (F.min(F.when(shown, F.col(p))) != F.max(F.when(shown, F.col(p)))) | (
            (F.sum(F.when(shown & F.col(p).isNull(), 1).otherwise(0)) > 0) & (F.sum(F.when(shown & F.col(p).isNotNull(), 1).otherwise(0)) > 0)
        )
        return (F.max(f"_d{i}") | F.coalesce(unlike, F.lit(False))).alias(f"_d{i}")

    total = merged.groupBy(KEY).agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"), *[differs(i) for i in range(len(fields))])
    found = F.when(~F.col("_right"), F.array(F.lit(left_name))).when(~F.col("_left"), F.array(F.lit(right_name))).otherwise(
        F.filter(F.array(*[F.when(F.col(f"_d{i}"), F.lit(c)) for i, c in enumerate(fields)]), lambda x: x.isNotNull())
    )
    return total.select(F.col(KEY).alias(key), F.explode(found).alias("difference"))
