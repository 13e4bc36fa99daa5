"""Differences of two copies against brute force."""

import datetime as dt
import math
import random

from tallyglass.operators.differences import differences

SCHEMA = "k long, a string, b double, t timestamp, n int"
FIELDS = ["a", "b", "t", "n"]


def brute(left, right):
    out = set()
    keys = {r[0] for r in left + right}

    def norm(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    for k in keys:
        a, b = [r for r in left if r[0] == k], [r for r in right if r[0] == k]
        if not b:
            out.add((k, "only_left"))
        elif not a:
            out.add((k, "only_right"))
        else:
            for i, f in enumerate(FIELDS, 1):
                if len({norm(r[i]) for r in a + b}) > 1:
                    out.add((k, f))
    return out


def row(rng, k):
    return (k, rng.choice(["x", "y", None, ""]), rng.choice([1.0, None, float("nan"), -0.5]), rng.choice([dt.datetime(2024, 1, 1), None]), rng.choice([1, 2, None]))


def check(spark, left, right):
    got = [tuple(r) for r in differences(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", FIELDS).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(left, right)


def test_random_copies(spark):
    rng = random.Random(1)
    left = [row(rng, rng.randrange(200)) for _ in range(150)]
    right = left[:100] + [row(rng, rng.randrange(220)) for _ in range(80)]
    check(spark, left, right)


def test_a_third_of_all_rows_is_one_key(spark):
    rng = random.Random(2)
    left = [row(rng, k) for k in range(1, 400)] + [(0, "x", 1.0, None, 1)]
    right = left[:300] + [(0, "x", 1.0, None, 1)] * 250 + [(0, "x", None, None, 1)]
    check(spark, left, right)
    check(spark, [(0, "x", 1.0, None, i % 3) for i in range(500)], [(0, "x", 1.0, None, 1)] * 400)


def test_null_key_and_ties(spark):
    check(spark, [(None, "x", 1.0, None, 1), (1, None, None, None, None)], [(None, "y", 1.0, None, 1), (1, None, None, None, None)])


def test_empty(spark):
    one = [(1, "x", 1.0, None, 1)]
    check(spark, [], [])
    check(spark, one, [])
    check(spark, [], one)


def test_long_texts_and_clashing_names(spark):
    big = "x" * 3_000_000
    left = spark.createDataFrame([(1, big, "s"), (2, "é\0", "s")], "k long, _f0 string, _key string")
    right = spark.createDataFrame([(1, big + "y", "t"), (2, "é\0", "t")], "k long, _f0 string, _key string")
    assert [tuple(r) for r in differences(left, right, "k", ["_f0"]).collect()] == [(1, "_f0")]
    assert {tuple(r) for r in differences(left, right, "k", ["_f0", "_key"]).collect()} == {(1, "_f0"), (1, "_key"), (2, "_key")}
