"""Mixing: budgets, knapsack, repeats and determinism."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import mixing
from tallyglass.llm.mixing import TokenCounter, budgets, fit_budget, mix


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 300), st.integers(1, 6), min_size=1, max_size=25), st.floats(0, 1.2))
def test_fit_is_within_and_near(counts, part):
    total = sum(k * n for k, n in counts.items())
    goal = int(total * part)
    take = fit_budget(counts, goal, 400)
    got = sum(k * n for k, n in take.items())
    assert all(0 <= take[k] <= counts[k] for k in take) and got <= max(goal, 0) or goal >= total and got == total
    if goal < total:
        assert goal - got < max(counts)  # never short of a whole document that is left


def test_fit_is_exact_with_many_lengths():
    rng = random.Random(1)
    counts = {k: rng.randrange(1, 30) for k in range(5, 900)}
    total = sum(k * n for k, n in counts.items())
    for part in (0.01, 0.3, 0.77):
        goal = int(total * part)
        assert sum(k * n for k, n in fit_budget(counts, goal).items()) == goal


def test_budgets():
    t = {"a": 100, "b": 100, "c": 50}
    got = budgets(t, {"a": (0.5, 1), "b": (0.3, 2), "c": (None, 9), "d": (0.2, 9)})
    assert got == {"a": 100, "b": 60}
    assert budgets(t, {"a": (0.5, 1), "b": (0.5, 1)}, 180) == {"a": 90, "b": 90}
    assert budgets(t, {"a": (0.9, 1), "b": (0.1, 3)}, 250) == {"a": 100, "b": 150}
    assert budgets({}, {"a": (1.0, 1)}) == {} and budgets(t, {}) == {}


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mix_reaches_shares_and_limits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", "d", None]), rng.choice([0, 100, *range(20, 400)])) for i in range(3000)]
    targets = {"a": (0.4, 1), "b": (0.3, 3), "c": (0.2, 2), "e": (0.1, 4), "d": (None, 1)}
    got = mix(sizes(spark, rows), targets, "s").collect()
    tokens = {}
    for r in got:
        assert 1 <= r.copies <= targets[r.source][1] and r.n_tokens > 0
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens * r.copies
    assert len({r.doc_id for r in got}) == len(got)
    whole = sum(tokens.values())
    for s in "abc":
        assert abs(tokens[s] / whole - targets[s][0] / 0.9) < 0.002
    again = mix(sizes(spark, rows[::-1]).repartition(5), targets, "s").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert {tuple(r) for r in mix(sizes(spark, rows), targets, "t").collect()} != {tuple(r) for r in got}


def test_mix_edges(spark):
    assert mix(sizes(spark, []), {"a": (1.0, 1)}, "s").count() == 0
    assert mix(sizes(spark, [(1, "a", 5)]), {}, "s").count() == 0
    assert [tuple(r) for r in mix(sizes(spark, [(1, "a", 5), (2, None, 5), (3, "a", 0)]), {"a": (1.0, 3)}, "s").collect()] == [(1, "a", 5, 3)]


def test_ties_of_one_length(spark):
    got = mix(sizes(spark, [(i, "a" if i % 2 else "b", 10) for i in range(1000)]), {"a": (0.25, 1), "b": (0.5, 1)}, "s")
    assert got.filter("source = 'a'").count() == 250 and got.filter("source = 'b'").count() == 500


@pytest.mark.parametrize("text", ["", "plain words here", "x" + " " * 5000 + "word", " " * 30_000, "a\n" + "\n" * 4000 + "b", "naïve 日本語 🙂"])
def test_tokens_agree_with_the_other_library(text):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(mixing.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert TokenCounter(mixing.VOCABULARY).count(text) == len(other.encode(text, add_special_tokens=False))


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, None, " Forum_X ", 9), (2, "", "forum-x", 9), (3, "one two", None, 9)], "doc_id long, text string, source string, n_tokens int")
    assert [tuple(r) for r in mixing.token_sizes(df, "doc_id", "text", mixing.plain_source()).orderBy("doc_id").collect()] == [(1, "forum-x", 0), (2, "forum-x", 0), (3, None, 2)]
