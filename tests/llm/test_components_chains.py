"""Components of long chains, in whatever order their names come."""

import random

import pytest

from tallyglass.llm import families


def named_path(n):
    names = [f"{i:04d}" for i in range(n)]
    random.Random(5).shuffle(names)
    return names


@pytest.mark.parametrize("path", [[*(f"{i}" for i in range(100, 220)), "1"], named_path(400)], ids=["small end", "random names"])
def test_long_chains_settle(spark, path):
    rows = families.components(spark.createDataFrame(list(zip(path, path[1:])), "a string, b string")).collect()
    assert {r.node for r in rows} == set(path) and {r.label for r in rows} == {min(path)}


def test_chains_of_owners_are_one_family(spark):
    owners = named_path(150)
    rows = [(f"n{i}", o) for i, pair in enumerate(zip(owners, owners[1:])) for o in pair]
    assert {r.family for r in families.name_families(spark.createDataFrame(rows, "name string, owner string")).collect()} == {"o:0000"}
