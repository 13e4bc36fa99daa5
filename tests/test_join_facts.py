"""The salted join: hot keys, null keys, equal rows."""

import pytest

from tallyglass.shared import join_facts


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [None, [], ["hot"], ["hot", "absent"]])
def test_same_rows_as_a_plain_join(spark, how, hot):
    rows = spark.createDataFrame([("hot", 1)] * 2000 + [(f"k{i}", i) for i in range(50)] + [(None, 7)] * 900, "k string, v int")
    facts = spark.createDataFrame([("hot", "h"), ("k3", "x"), ("k4", None), ("other", "o"), (None, "n")], "k string, fact string")
    got, want = join_facts(rows, facts, "k", how, hot), rows.join(facts, "k", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_and_null_rows_are_spread(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(2000)] + [(None, i) for i in range(2000)], "k string, v int").repartition(16)
    facts = spark.createDataFrame([("hot", "h")], "k string, fact string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join so few bytes in one task again
    try:
        sizes = join_facts(rows.hint("merge"), facts, "k", "left", ["hot"]).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 4000 and max(sizes) < 2000  # a plain join puts at least 2000 into one task


def test_empty(spark):
    none = spark.createDataFrame([], "k string, v int")
    assert join_facts(none, none.withColumnRenamed("v", "w"), "k", "left").count() == 0
