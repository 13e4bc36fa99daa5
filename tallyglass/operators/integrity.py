"""Digests, two-way checks and document validation."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import cut


def two_way(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status``: ``left-only``, ``right-only``, ``mismatch`` or ``same``; keys must be unique on either side."""
    a, b = left.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    joined = a.join(b, key, "full")
    status = F.when(F.col("_r").isNull(), "left-only").when(F.col("_l").isNull(), "right-only").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("mismatch")
    return joined.select(key, status.alias("status"))


def drift(recorded: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose recorded digest is not the actual one; keys that only one side has aren't compared."""
    return recorded.select(key, F.col(digest).alias("recorded")).join(actual.select(key, F.col(digest).alias("actual")), key).filter("recorded <> actual")


def uniqueness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, values and rows beyond the first of their value."""
    per = [rows.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    both = per[0]
    for p in per[1:]:
        both = both.unionByName(p)
    each = both.groupBy("column", "v").agg(F.count("*").alias("k"))
    return each.groupBy("column").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k") - 1)), F.lit(0)).alias("n_repeated"),
    )


def corpus_digest(rows: DataFrame, ident: str, digest: str, per_block: int = 4096) -> DataFrame:
    """One row: ``n, digest`` of a corpus in the order of its ids; null if it is empty or a row has no digest.

    A tree of SHA-256: each block of ``per_block`` rows hashes its ``id\\0digest\\n`` lines in order, and so on with the blocks'
    digests until one block is left, so no task holds more than a block. The same set of rows has the same digest on every run
    and partitioning.
    """
    from tallyglass.operators.assign import dense_position

    placed = dense_position(rows.select(F.col(ident).alias("i"), F.col(digest).alias("d")), "i")
    level = placed.select("position", F.concat("i", F.lit("\x00"), "d", F.lit("\n")).alias("line"), F.lit(1).cast("long").alias("n"), F.when(F.col("d").isNotNull(), 1).otherwise(0).cast("long").alias("known"))
    while True:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"])
        level = cut(level.groupBy(F.floor(F.col("position") / per_block).alias("position")).agg(F.sha2(F.array_join(lines, ""), 256).alias("line"), F.sum("n").alias("n"), F.sum("known").alias("known")), "level")
        if level.count() <= per_block:
            break
    root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), ""), 256)
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when((F.sum("n") > 0) & (F.sum("n") == F.sum("known")), root).alias("digest"))


#: Members of a result that don't enter its seal.
UNSEALED = ("content_digest", "started_utc", "elapsed_seconds")


def seal(document: str) -> str | None:
    """SHA-256 of the canonical JSON (sorted keys, no blanks) without the members that vary from run to run."""
    try:
        doc = json.loads(document)
    except (TypeError, ValueError):
        return None
    if not isinstance(doc, dict):
        return None

    def strip(value):
        if isinstance(value, dict):
            return {k: strip(v) for k, v in value.items() if k not in UNSEALED}
        return [strip(v) for v in value] if isinstance(value, list) else value

    return hashlib.sha256(json.dumps(strip(doc), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def seals(documents: Column) -> Column:
    """``seal`` of a column of documents, in Arrow batches."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(seal)

    return run(documents)


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, as an array; a rule over nulls isn't broken."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def result_rules() -> dict[str, Column]:
    """Rules of a result row ``auc, low, high, n_clean, n_stego, tpr_at_fpr, fpr_achieved, rate, unit`` (maps by budget)."""
    budget = lambda k: k.try_cast("double")
    within = F.lit(1e-9)
    return {
        "auc out of range": ~F.col("auc").between(0, 1), "interval out of range": (F.col("low") < 0) | (F.col("high") > 1) | (F.col("low") > F.col("high")),
        "auc outside its interval": (F.col("auc") < F.col("low") - within) | (F.col("auc") > F.col("high") + within),
        "a class is empty": (F.col("n_clean") <= 0) | (F.col("n_stego") <= 0),
        "budget not a rate": F.exists(F.map_keys("tpr_at_fpr"), lambda k: budget(k).isNull() | (budget(k) < 0) | (budget(k) > 1)),
        "tpr not a rate": F.exists(F.map_values("tpr_at_fpr"), lambda v: (v < 0) | (v > 1)),
        "achieved beyond its budget": F.exists(F.map_entries("fpr_achieved"), lambda e: e["value"] > budget(e["key"]) + within),
        "rate out of range": ((F.col("unit") == "fraction") & ~((F.col("rate") > 0) & (F.col("rate") <= 1))) | ((F.col("unit") == "bpp") & ~((F.col("rate") > 0) & (F.col("rate") <= 8))),
    }


def manifest_rules() -> dict[str, Column]:
    """Rules of a manifest row."""
    return {
        "file is not a plain name": ~F.col("file").rlike(r"^[^/\\\x00-\x1f\x7f]+$"), "sha256 is not 64 lower hex digits": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "size is not positive": (F.col("width") <= 0) | (F.col("height") <= 0), "crop box has not four numbers": F.size("crop_box") != 4,
        "crop box differs from the size": (F.size("crop_box") == 4) & ((F.col("crop_box")[2] - F.col("crop_box")[0] != F.col("width")) | (F.col("crop_box")[3] - F.col("crop_box")[1] != F.col("height"))),
        "split is not a side": ~F.col("split").isin("train", "validation", "test"), "licence without url": F.col("licence").isNotNull() & F.col("licence_url").isNull(),
    }


def run_rules() -> dict[str, Column]:
    """Rules of an arm's state in a run: ``state, error, result``."""
    return {
        "unknown state": ~F.col("state").isin("queued", "running", "done", "failed"), "failed without an error": (F.col("state") == "failed") & F.col("error").isNull(),
        "error without failure": (F.col("state") != "failed") & F.col("error").isNotNull(), "done without a result": (F.col("state") == "done") & F.col("result").isNull(),
    }


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule: rows that break it. A table without rows fails ``nothing was checked``."""
    names = list(rules) + ["nothing was checked"]
    counts = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.count_if(broken), F.lit(0)).alias(f"r{i}") for i, broken in enumerate(rules.values())])
    each = [F.struct(F.lit(name).alias("rule"), (F.col(f"r{i}") if i < len(rules) else F.when(F.col("n") == 0, 1).otherwise(0).cast("long")).alias("n_failed")) for i, name in enumerate(names)]
    return counts.select("n", F.explode(F.array(*each)).alias("e")).select("e.rule", F.col("n").alias("n_checked"), "e.n_failed")
