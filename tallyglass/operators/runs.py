"""Scoring runs: detectors over images in Arrow batches, outputs parsed, failures recorded and never fatal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "id string, score double, verdict boolean, error string"


def score(items: DataFrame, ident: str, content: str, detector: Callable[[list[bytes]], list], batch: int = 64) -> DataFrame:
    """``id, score, verdict, error`` of every item.

    ``detector`` gets at most ``batch`` contents and returns as many readings: a number, a bool or an exception. If it raises or
    answers another number of items, they are tried one by one, so one bad item can't take others with it.
    """

    def one(data):
        try:
            got = detector([data])
            return got[0] if len(got) == 1 else ValueError(f"{len(got)} answers to one question")
        except Exception as e:  # noqa: BLE001
            return e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                contents = part[content].tolist()
                try:
                    answers = detector(contents)
                    if len(answers) != len(contents):
                        raise ValueError("answers missing")
                except Exception:  # noqa: BLE001
                    answers = [one(c) for c in contents]
                for i, a in zip(part[ident], answers, strict=True):
                    if isinstance(a, bool):
                        rows.append((i, None, a, None))
                    elif isinstance(a, (int, float)) and a == a and abs(a) != float("inf"):
                        rows.append((i, float(a), None, None))
                    else:
                        rows.append((i, None, None, str(a) if a is not None else "no answer"))
            out = pd.DataFrame(rows, columns=["id", "score", "verdict", "error"])
            yield out.astype({"verdict": "object"})

    return items.select(F.col(ident).cast("string").alias(ident), content).mapInPandas(run, RECORD)


def keyed_answers(batches: DataFrame, asked: DataFrame) -> DataFrame:
    """``batch, key, answer, error``: answers of batched plugins, one line ``key<tab>answer`` each.

    ``batches``: ``batch, stdout``; ``asked``: ``batch, key``. A line without a tab or an unknown key spoils its whole batch; a
    key without an answer fails alone.
    """
    lines = batches.select("batch", F.explode(F.filter(F.split("stdout", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    parts = lines.select("batch", F.when(F.col("line").contains("\t"), F.substring_index("line", "\t", 1)).alias("key"), F.when(F.col("line").contains("\t"), F.regexp_replace("line", "^[^\t]*\t", "")).alias("answer"))
    known = parts.join(asked.select("batch", "key", F.lit(True).alias("asked")), ["batch", "key"], "left")
    spoiled = known.groupBy("batch").agg(F.max(F.col("key").isNull() | F.col("asked").isNull()).alias("spoiled"))
    answers = known.filter("asked").groupBy("batch", "key").agg(F.max("answer").alias("answer"))
    joined = asked.join(answers, ["batch", "key"], "left").join(spoiled, "batch", "left")
    bad = F.coalesce("spoiled", F.lit(False))
    return joined.select("batch", "key", F.when(~bad, F.col("answer")).alias("answer"), F.when(bad, "batch spoiled").when(F.col("answer").isNull(), "no answer").alias("error"))


def self_test(readings: DataFrame, detector: str = "detector") -> DataFrame:
    """Outcome per detector from its two fixtures: ``detector, must_fire, fired``."""
    f = lambda must: F.max(F.when(F.col("must_fire") == must, F.col("fired")))
    hit, clear = f(True), f(False)
    outcome = (
        F.when(hit.isNull() & clear.isNull(), "failed").when(hit.isNull() | clear.isNull(), "incomplete").when(hit & ~clear, "passed").when(hit & clear, "fires at everything")
        .when(~hit & ~clear, "fires at nothing").otherwise("inverted")
    )
    return readings.groupBy(detector).agg(outcome.alias("outcome"))


def tally(records: DataFrame) -> DataFrame:
    """One row: scored and failed records."""
    return records.agg(F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(F.col("error").isNotNull()).alias("errored"))


def revised_estimate(scored: Column, left: Column, elapsed: Column, declared: Column, after: int = 16) -> Column:
    """Seconds left by the measured rate, once ``after`` items are scored and unless it is near what was declared."""
    measured = elapsed / scored * left
    ratio = F.try_divide(measured, declared)
    return F.when((scored >= after) & (ratio.isNull() | (ratio < 0.7) | (ratio >= 1.4)), measured)
