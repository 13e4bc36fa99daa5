"""Session-level helpers: the shared folder, lineage cuts and skew-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most heavy keys a join sets aside; with the share below, the table broadcast for them is bounded whatever the data.
HEAVY_KEYS = 128
#: Counters of the frequent-items sketch. Its error is about 3.5 / SKETCH_ITEMS of the rows, far under 1 / HEAVY_KEYS.
SKETCH_ITEMS = 4096
#: Most tasks that the rows of one heavy key are dealt to.
MOST_SALTS = 1024


def shared_root(spark: SparkSession) -> str:
    """The folder every executor shares, as ``spark.checkpoint.dir`` names it.

    Where it is unset (tests on a local master) a temporary folder is made and set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    made = getattr(spark, "_tallyglass_root", None)
    if made is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        made = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.sparkContext.setCheckpointDir(made)
        spark._tallyglass_root = made
        atexit.register(_remove, made.removeprefix("file://"))
    return made


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_keys(df: DataFrame, key: str, most: int = HEAVY_KEYS) -> list:
    """Keys that hold more than ``1 / most`` of the non-null rows; at most ``most`` of them, found by a fixed-size sketch."""
    row = df.agg(
        F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {most}, {SKETCH_ITEMS})").alias("top")
    ).first()
    return [t["item"] for t in row["top"] or [] if t["count"] * most > row["n"] and t["count"] > 1000]


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``rows`` to ``facts`` (unique per ``key``) without putting a hot key's rows, or those without key, into one task.

    Rows of heavy keys (at most ``HEAVY_KEYS`` keys) and of null keys are dealt to four salts a shuffle partition, at most
    ``MOST_SALTS``, by a hash of the row and its input partition, which is the same when a lost task runs again; the facts of heavy keys, and only these, are repeated once a salt, so at most
    ``HEAVY_KEYS * MOST_SALTS`` rows are added. It is one join: ``rows`` are made once. ``hot`` are the heavy keys where the
    caller knows them; else a sketch finds them, which is one more pass over the key. ``how`` is ``left`` or ``inner``. Null
    keys match nothing.
    """
    hot = heavy_keys(rows, key) if hot is None else hot
    if not hot and how == "inner":
        return rows.join(facts, key, how)
    salts = max(1, min(MOST_SALTS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    deal = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), deal).otherwise(0))
    repeated = facts.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def rank_by_hash(rows: DataFrame, group: list[str], hash_col: str, ties: list[str], out: str = "rank", bits: int = 12) -> DataFrame:
    """Exact 0-based position of each row in its group by ``(hash_col, ties)``, without one task per group.

    A group is cut into ``2 ** bits`` bins by the high bits of the 64-bit hash; bins are counted with map-side partials,
    their running totals give each bin's first position, and only rows of one bin are ever ordered together.
    Null hashes come first. Distinct rows must differ in ``(hash_col, ties)`` for a stable order.
    """
    from pyspark.sql import Window as W

    # shifted to order as unsigned, with nulls in bin 0
    binned = rows.withColumn("_bin", F.coalesce(F.shiftrightunsigned(F.col(hash_col), 64 - bits), F.lit(0).cast("long")))
    counts = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bin").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    unsigned = F.col(hash_col).bitwiseXOR(F.lit(-(2**63)))
    inside = binned.withColumn("_pos", F.row_number().over(W.partitionBy(*group, "_bin").orderBy(unsigned.asc_nulls_first(), *ties)))
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)] + [F.col("_bin") == F.col("_b")]
    joined = inside.join(starts, on)
    return joined.withColumn(out, F.col("_start") + F.col("_pos") - 1).drop("_bin", "_b", "_pos", "_start", *[f"_g{i}" for i in range(len(group))])


def running_totals(rows: DataFrame, group: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, per group, the total of a column over all rows ordered before and including this one.

    ``sums`` maps a new column to the summed one. ``order`` must be unique within a group. The rows are range-partitioned by
    ``(group, order)`` into a table, so that a group with very many rows spreads over tasks: ranges are totalled, the few
    totals are accumulated, and each range adds its own start.
    """
    from pyspark.sql import Window as W

    # the ranges are sampled, so the table fixes them
    ranged = cut(rows.repartitionByRange(*group, order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*group, "_p").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    span = (F.col("_p").desc() if descending else F.col("_p").asc())
    before = W.partitionBy(*[F.lit(0), *group]).orderBy(span).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_q"),
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))],
    )
    within = W.partitionBy(*group, "_p").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(W.unboundedPreceding, 0)
    inside = ranged.select("*", *[F.sum(c).over(within).alias(f"_i{i}") for i, c in enumerate(sums.values())])
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_p") == F.col("_q")]
    joined = inside.join(starts, on)
    return joined.select(*rows.columns, *[(F.col(f"_s{i}") + F.col(f"_i{i}")).alias(new) for i, new in enumerate(sums)])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: they may start where it isn't on the path."""
    import os
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tallyglass_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallyglass-code-")
    atexit.register(_remove, folder)
    archive = os.path.join(folder, "tallyglass.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._tallyglass_shipped = True
