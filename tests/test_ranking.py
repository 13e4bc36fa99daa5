"""Ranking statistics: hand-computed values, brute force over ties, invariants, edge cases."""

import math
import random

import pytest

from tallyglass.operators import confusion, ranking
from tallyglass.shared import heavy_keys, join_facts, rank_by_hash, running_totals


def rows(spark, scores, labels, group="g"):
    return spark.createDataFrame([(group, s, y) for s, y in zip(scores, labels, strict=True)], "g string, score double, label boolean")


def brute_auc(scores, labels):
    p, n = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    v10 = [sum((a > b) + 0.5 * (a == b) for b in n) / len(n) for a in p]
    v01 = [sum((a > b) + 0.5 * (a == b) for a in p) / len(p) for b in n]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
    return sum(v10) / len(v10), math.sqrt(var(v10) / len(p) + var(v01) / len(n))


def test_auc_and_interval_against_brute_force(spark):
    rng = random.Random(1)
    data, want = [], {}
    for g in range(6):
        s = [rng.randrange(8) / 8 for _ in range(60)]
        y = [rng.random() < 0.4 for _ in range(60)]
        data += [(f"g{g}", a, b) for a, b in zip(s, y, strict=True)]
        want[f"g{g}"] = brute_auc(s, y)
    df = spark.createDataFrame([*data, ("g0", None, True), ("g0", 0.5, None)], "g string, score double, label boolean")
    for r in ranking.auc(df, ["g"]).collect():
        assert r.auc == pytest.approx(want[r.g][0], abs=1e-12) and r.se == pytest.approx(want[r.g][1], abs=1e-12)
        assert 0 <= r.low <= r.auc <= r.high <= 1


T, F_ = True, False


@pytest.mark.parametrize(
    ("scores", "labels", "budget", "tpr"),
    [([0.1, 0.2, 0.8, 0.9], [F_, F_, T, T], 0.0, 1.0), ([0.9, 0.4, 0.5, 0.1], [T, T, F_, F_], 0.0, 0.5), ([0.9, 0.4, 0.5, 0.1], [T, T, F_, F_], 0.5, 1.0), ([0.1, 0.2, 0.8, 0.9], [T, T, F_, F_], 0.0, 0.0),
     ([1, 1, 1, 0], [T, T, F_, F_], 0.0, 0.0), ([1, 1, 1, 0], [T, T, F_, F_], 0.5, 1.0)],
)
def test_budgets(spark, scores, labels, budget, tpr):
    r = ranking.operating_points(rows(spark, [float(s) for s in scores], labels), ["g"], [budget]).first()
    assert r.tpr == tpr and r.achieved_fpr <= budget + 1e-12


def test_threshold_and_constant_scores(spark):
    r = ranking.operating_points(rows(spark, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [T, T, T, F_, F_, F_]), ["g"], [0.0, 2.0]).orderBy("budget").collect()
    assert (r[0].tpr, r[0].achieved_fpr, r[0].threshold) == (1.0, 0.0, 0.7) and r[1].tpr is None
    points = ranking.roc_points(rows(spark, [0.5] * 4, [T, T, F_, F_]), ["g"]).collect()
    assert sorted((p.tpr, p.fpr) for p in points) == [(0.0, 0.0), (1.0, 1.0)]


def test_findings_and_refusals(spark):
    f = ranking.findings(rows(spark, [0.9, 0.8, 0.2, 0.1], [F_, F_, T, T]), ["g"]).first()
    assert f.auc == 0 and f.inverted == 1 and not f.all_identical
    assert ranking.findings(rows(spark, [0.5] * 4, [T, T, F_, F_]), ["g"]).first().all_identical
    cases = [([1.0], [T, F_], [0.1], "length-mismatch"), ([], [], [0.1], "empty"), ([1.0, None], [T, F_], [0.1], "not-a-number"), ([1.0, float("nan")], [T, F_], [0.1], "not-a-number"), ([1.0, 2.0], [T, T], [0.1], "one-sided"),
             ([1.0, 2.0], [T, F_], [1.5], "budget-not-a-rate"), ([1.0, 2.0], [T, F_], [0.1, 0.1], "duplicate-budget"), ([1.0, 2.0], [T, F_], [0.1], "ok")]
    df = spark.createDataFrame([c[:3] + (c[3],) for c in cases], "scores array<double>, labels array<boolean>, budgets array<double>, want string")
    assert all(r.status == r.want for r in ranking.refusal(df).collect())


def test_one_class_nan_and_nothing(spark):
    one = ranking.auc(rows(spark, [0.1, 0.2], [T, T]), ["g"]).first()
    assert one.auc is None and one.se is None
    assert ranking.auc(rows(spark, [0.1, float("nan")], [T, F_]), ["g"]).first().auc is None
    assert ranking.auc(rows(spark, [], []), ["g"]).count() == 0
    perfect = ranking.auc(rows(spark, [0.1, 0.2, 0.8, 0.9], [F_, F_, T, T]), ["g"]).first()
    assert perfect.auc == 1 and perfect.low is None
    assert ranking.auc(rows(spark, [0.1, 0.2, 0.8, 0.9], [F_, F_, T, T]), []).first().auc == 1


def test_midranks(spark):
    got = {r.score: r.midrank for r in ranking.midranks(rows(spark, [3.0, 1.0, 2.0, 2.0, 2.0], [T] * 5), ["g"]).collect()}
    assert got == {1.0: 1.0, 2.0: 3.0, 3.0: 5.0}


def test_shared_negatives(spark):
    df = spark.createDataFrame([("a", 0.9, T), ("b", 0.4, T), (None, 0.5, F_), (None, 0.1, F_), (None, 0.5, F_)], "arm string, score double, label boolean")
    got = {r.arm: r.auc for r in ranking.auc(ranking.shared_negatives(df, []), ["arm"]).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(1 / 3)}


def test_confusion(spark):
    df = spark.createDataFrame([(T, T), (T, T), (T, F_), (F_, T), (F_, F_), (None, T), (T, None)], "label boolean, predicted boolean")
    r = confusion.rates(confusion.tally(df, [])).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 1, 1) and r.tpr == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 / 3)
    zero = confusion.rates(confusion.tally(df.limit(0), [])).first()
    assert zero.tpr == zero.precision == zero.accuracy == zero.f1 == 0


def test_running_totals_and_hash_ranks(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9), rng.getrandbits(64) - (1 << 63) if i % 5 else 7) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o int, v long, h long")
    for down in (False, True):
        got = {(r.g, r.o): r.t for r in running_totals(df, ["g"], "o", {"t": "v"}, down).collect()}
        assert got == {(g, o): sum(v for g2, o2, v, _ in data if g2 == g and (o2 >= o if down else o2 <= o)) for g, o, _, _ in data}
    got = {r.o: r["rank"] for r in rank_by_hash(df, ["g"], "h", ["o"]).collect()}
    for g in ("a", "b", None):
        mine = sorted((h % (1 << 64), o) for g2, o, _, h in data if g2 == g)
        assert [got[o] for _, o in mine] == list(range(len(mine)))


def test_joins_keep_hot_keys_in_place(spark):
    df = spark.createDataFrame([("hot" if i % 2 else f"k{i % 700}" if i % 7 else None, i) for i in range(6000)], "k string, i int")
    facts = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, f int")
    assert heavy_keys(df, "k") == ["hot"]
    plan = join_facts(df, facts, "k", "left")
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(map(tuple, df.join(facts, "k", "left").collect()), key=str)
    assert heavy_keys(df.limit(0), "k") == []
