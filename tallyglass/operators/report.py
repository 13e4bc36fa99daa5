"""Result rows and reports: one row per detector and arm, flags, order, repeats and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyglass.functions.text import arm_text, csv_field, markdown_cell, percent

TOLERANCE = 1e-9


def rate_key(unit: Column | str = "unit", rate: Column | str = "rate") -> Column:
    """Sort key of a rate: its unit and zero-filled value, before all of them ``0-none``."""
    unit, rate = (F.col(x) if isinstance(x, str) else x for x in (unit, rate))
    return F.when(rate.isNull() | unit.isNull(), "0-none").otherwise(F.concat(unit, F.lit("-"), F.lpad(F.format_string("%.6f", rate), 16, "0")))


def flags(rules: dict[str, Column]) -> Column:
    """Names of the flags that are set, in their order, as one text; empty without any."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()), ", ")


def mark_repeats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``repeats``: how many rows share detector, embedder and arm. Counts are joined back, so no group is windowed."""
    n = rows.groupBy(*by).agg(F.count("*").alias("repeats"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    return rows.alias("r").join(n.alias("n"), on).select("r.*", "n.repeats")


def fpr_columns(documents: DataFrame, column: str = "tpr_at_fpr") -> DataFrame:
    """Budgets that any document reports, alike within 1e-9, in order."""
    return documents.select(F.explode(F.map_keys(column)).alias("k")).select(F.round(F.col("k").cast("double"), 9).alias("budget")).distinct()


def budget_cell(tpr: Column, achieved: Column, target: float) -> Column:
    """A reported rate; with the false alarm rate really achieved where the target couldn't be expressed."""
    shown = percent(tpr)
    return F.when(tpr.isNull(), "not reported").when(achieved < target - TOLERANCE, F.concat(shown, F.lit(" at "), percent(achieved), F.lit(" FA"))).otherwise(shown)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of a report: embedder, rate, detector; never by score."""
    return rows.orderBy("embedder", rate_key(), "detector")


def report_rows(results: DataFrame) -> DataFrame:
    """Adds ``arm_text``, ``rate_key`` and ``flags`` to rows ``detector, embedder, rate, unit, auc, low, high, n_pos, n_neg, n_error``."""
    few = (F.col("n_pos") < 100) | (F.col("n_neg") < 100)
    rules = {
        "inverted": F.col("auc") < 0.5, "no interval": F.col("low").isNull(), "chance within interval": (F.col("low") <= 0.5) & (F.col("high") >= 0.5), "few": few,
        "errors": F.col("n_error") > 0,
    }
    return results.withColumn("arm_text", arm_text(F.col("embedder"), F.col("rate"), F.col("unit"))).withColumn("rate_key", rate_key()).withColumn("flags", flags(rules))


def withheld(rows: DataFrame, size: str, order: list[str], most: int = 200) -> DataFrame:
    """Adds ``shown``: whole rows until their lines are more than ``most``; a report is bounded (10,000 documents)."""
    lines = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("shown", lines <= most)


def nearest_names(names: DataFrame, name: str, typed: str, most: int = 3) -> DataFrame:
    """The ``most`` names nearest to what was typed: within an edit distance of 3, or one holding the other."""
    d = F.levenshtein(F.col(name), F.lit(typed))
    near = names.select(name).distinct().withColumn("distance", d)
    return near.filter((F.col("distance") <= 3) | F.col(name).contains(typed) | F.lit(typed).contains(F.col(name))).orderBy("distance", name).limit(most)


def aligned(rows: DataFrame, columns: list[str], gutter: str = "  ") -> DataFrame:
    """Lines of a text table: every column padded to its widest cell. Widths come from one aggregation."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    width = rows.agg(*[F.max(F.length(t)).alias(f"_w{i}") for i, t in enumerate(text.values())])
    cells = [F.rpad(t, F.greatest(F.col(f"_w{i}"), F.lit(0)), F.lit(" ")) for i, t in enumerate(text.values())]
    return rows.crossJoin(F.broadcast(width)).select(F.rtrim(F.concat_ws(gutter, *cells)).alias("line"))  # one row


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("line"))


def markdown_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def one_answer(cells: DataFrame, column: str, cell: str) -> DataFrame:
    """Columns (of two cells or more, none missing) that give one answer for everything."""
    each = cells.groupBy(column).agg(F.count("*").alias("n"), F.count(cell).alias("known"), F.min(cell).alias("low"), F.max(cell).alias("high"))
    return each.filter("n >= 2 and known = n and low = high").select(column, "n", F.col("low").alias("answer"))


def documents(results: DataFrame, schema: str = "result-v1") -> DataFrame:
    """Adds ``document``: the JSON of each result row."""
    return results.withColumn("document", F.to_json(F.struct(F.lit(schema).alias("schema"), *results.columns)))


def plan_cost(detectors: DataFrame, items: int) -> DataFrame:
    """One row over the runnable detectors: estimated seconds, how many have no estimate, worst case and size of the records."""
    run = detectors.filter("runnable")
    return run.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("seconds_per_image"), F.lit(0.0)).alias("per_image"), F.count_if(F.col("seconds_per_image").isNull()).alias("unestimated"),
        (F.coalesce(F.sum("seconds_per_image"), F.lit(0.0)) * items).alias("seconds"), F.coalesce(F.sum("timeout") * items, F.lit(0)).alias("worst_seconds"), (F.count("*") * items * 60 / 2**20).alias("records_mb"),
    )


def footprint(entries: DataFrame) -> DataFrame:
    """Bytes of images, each reference once (the last entry's size counts), split by whether they are bundled."""
    once = entries.groupBy("reference").agg(F.max_by(F.struct("bytes", "bundled"), "position").alias("e")).select("e.*")
    return once.groupBy("bundled").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
