"""Confusion tallies and the rates made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def tally(judged: DataFrame, group: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """``tp, fp, tn, fn`` per group; rows where either is null aren't counted."""
    y, p = F.col(label), F.col(predicted)
    return judged.groupBy(*group).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    )


def rates(tallied: DataFrame) -> DataFrame:
    """Adds ``tpr, fpr, precision, accuracy, f1``; every ratio over nothing is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return tallied.select(
        "*", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def says_positive(score: Column, threshold: float, higher: bool = True, verdict: Column | None = None) -> Column:
    """The verdict if there is one, else the score strictly beyond the threshold on its side; null where neither is known."""
    beyond = score > threshold if higher else score < threshold
    return F.coalesce(verdict, beyond) if verdict is not None else beyond
