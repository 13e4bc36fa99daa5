"""A reproducible sample that keeps its members while data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyglass.shared import cut

BIN_BITS = 12


def hash63(salt: Column | str, key: Column | str) -> Column:
    """The first 60 bits of SHA-256 of ``salt:key`` as a bigint: the same in any engine."""
    key = F.col(key) if isinstance(key, str) else key
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.conv(F.substring(F.sha2(F.concat_ws(":", salt, key), 256), 1, 15), 16, 10).cast("long")


def frozen_bottom_k(rows: DataFrame, batch: str, identity: Column, order: str, row_id: str, rate: float, salt: str) -> DataFrame:
    """Of each batch, exactly ``ceil(rate * size)`` new identities: those with the smallest salted hashes.

    An identity belongs to the first batch that lists it, and a batch's size is the number of identities it brings; later
    listings change nothing. Batches are immutable, so each batch's choice is final and the sample of more batches contains
    the sample of fewer. Returns ``batch, identity, order, row_id, hash`` with the identity's first row by
    ``(order, row_id)`` in that batch (null ``order`` last).

    Listings are reduced to one row per identity with map-side partials, so a digest or batch that holds a third of all
    rows is no hot group: a batch is split into ``2 ** BIN_BITS`` hash bins, whole bins are taken or left by their counts,
    and only the bin where the k-th smallest lies is ordered. Ties of the hash go by identity. Null identities and null
    batches aren't sampled; empty tables give empty samples; extra columns are ignored. ``rate`` is from 0 to 1.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    far = F.lit(2**63 - 1)
    listed = rows.select(
        identity.alias("identity"),
        F.struct(F.col(batch).alias("batch"), F.coalesce(F.col(order).cast("long"), far).alias("o"), F.col(row_id).alias("row_id")).alias("first"),
    ).filter(F.col("identity").isNotNull() & F.col("first.batch").isNotNull())
    firsts = cut(listed.groupBy("identity").agg(F.min("first").alias("first")).select(
        "identity", F.col("first.batch").alias("batch"),
        F.when(F.col("first.o") != far, F.col("first.o")).alias("order"), F.col("first.row_id").alias("row_id"),
        hash63(salt, "identity").alias("hash"),
    ).withColumn("_bin", F.shiftright("hash", 60 - BIN_BITS)), "firsts")  # read for the counts and for the choice
    counts = firsts.groupBy("batch", "_bin").agg(F.count("*").alias("n"))
    upto = W.partitionBy("batch").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn(
        "k", F.ceil(F.sum("n").over(W.partitionBy("batch")).cast("decimal(20,0)") * F.lit(str(rate)).cast("decimal(18,12)")).cast("long")
    )
    open_bins = bins.filter("before < k").select("batch", "_bin", (F.col("k") - F.col("before")).alias("need"), (F.col("k") >= F.col("before") + F.col("n")).alias("whole"))
    chosen = firsts.join(open_bins, ["batch", "_bin"])
    inside = W.partitionBy("batch", "_bin").orderBy("hash", "identity")
    return chosen.withColumn("_r", F.row_number().over(inside)).filter("whole or _r <= need").select("batch", "identity", "order", "row_id", "hash")
