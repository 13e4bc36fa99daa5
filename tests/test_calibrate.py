"""Calibration kernels: worked values, brute force and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import calibrate as c


def test_cllr_values(spark):
    assert c.cllr_of([1, 1], [1]) == 1
    assert c.cllr_of([0.0], [1]) == math.inf
    for bad in (([], [1]), ([1], [-1])):
        with pytest.raises(ValueError):
            c.cllr_of(*bad)
    df = spark.createDataFrame([("a", 4.0, True), ("a", 0.25, False), ("b", 0.0, True), ("b", 1.0, False), ("c", 1.0, True)], "g string, lr double, label boolean")
    got = {r.g: r.cllr for r in c.cllr(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(math.log2(1.25)) and got["b"] == math.inf and got["c"] is None
    assert c.bound_cost(100) == pytest.approx(c.cllr_of([100], [0.01]))


def test_pav_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 8, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    p = c.pav(s, y)
    order = np.argsort(s)
    assert (np.diff(p[order]) >= -1e-12).all() and p.mean() == pytest.approx(y.mean())
    assert all(len(set(p[s == v])) == 1 for v in set(s))
    for _ in range(300):  # no other monotone function is nearer
        q = np.maximum.accumulate(np.clip(np.array([p[s == v][0] for v in range(8)]) + rng.normal(0, 0.1, 8), 0, 1))[s.astype(int)]
        assert ((y - p) ** 2).sum() <= ((y - q) ** 2).sum() + 1e-9
    assert len(c.pav(np.zeros(0), np.zeros(0))) == 0


def test_logistic_recovers_and_is_scale_free():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.5
    x = rng.normal(0, 1, 4000) + 2 * y
    lr = c.Logistic(1e9).fit(x, y).transform(x)
    truth = np.exp(2 * x - 2)
    assert np.median(np.abs(np.log(lr / truth))) < 0.15
    assert np.allclose(lr, c.Logistic(1e9).fit(x * 1e6 + 5e6, y).transform(x * 1e6 + 5e6), rtol=1e-6)
    flat = c.Logistic().fit(np.ones(10), np.arange(10) < 3).transform(np.ones(2))
    assert np.allclose(flat, 1)
    assert c.Logistic().fit([0.0, 0, 1, 1], [0, 0, 1, 1]).transform([1.0])[0] == 100
    with pytest.raises(ValueError):
        c.Logistic().fit([1.0, np.nan], [0, 1])


def test_decomposition_and_folds():
    rng = np.random.default_rng(3)
    y = np.arange(400) % 2 == 0
    x = rng.normal(0, 1, 400) + y
    groups = np.arange(400) // 2
    lr = c.cross_validated(x, y, 10, seed=1, groups=groups)
    total, floor, loss = c.decompose(lr, y)
    assert 0 < floor <= total < 1 and loss == pytest.approx(total - floor)
    fold = c.folds_of(y, groups, 10, 4)
    assert all(len(set(fold[groups == g])) == 1 for g in range(200)) and (c.folds_of(y, groups, 10, 4) == fold).all()
    strat = c.folds_of(y, None, 10, 4)
    assert {(strat[y] == k).sum() for k in range(10)} == {20}
    with pytest.raises(ValueError):
        c.folds_of(y[:5], None, 10, 0)
    flipped = c.permuted(y, groups, 5)
    assert all(sorted(flipped[groups == g]) == sorted(y[groups == g]) for g in range(200)) and (flipped != y).any()
    o = c.observed(x, y, seeds=3, groups=groups)
    assert o["sd"] >= 0 and o["cllr"] == pytest.approx(o["cllr_min"] + o["cllr_cal"])


def test_null_scores_have_no_value():
    rng = np.random.default_rng(5)
    y = np.arange(600) % 2 == 0
    cost = c.observed(rng.normal(size=600), y, seeds=2, groups=np.arange(600) // 2)["cllr"]
    assert cost > 0.95
    strong = c.observed(rng.normal(size=600) + 4 * y, y, seeds=2, groups=np.arange(600) // 2)["cllr"]
    assert strong < 0.3


def test_indices_wilson_crossing_sign_verbal(spark):
    assert c.critical_places(99) == (4, 94)
    with pytest.raises(ValueError):
        c.critical_places(10)
    low, high = c.wilson("k", "n")
    df = spark.createDataFrame([(0, 0), (8, 10), (10, 10)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(df[0]) == (0.0, 1.0) and df[1].l == pytest.approx(0.4902, abs=1e-3) and df[1].h == pytest.approx(0.9433, abs=1e-3) and df[2].h == pytest.approx(1.0)
    curve = spark.createDataFrame([("a", 0.0, 0.1), ("a", 1.0, 0.4), ("a", 2.0, 0.6), ("a", 3.0, 0.4), ("a", 4.0, 0.9), ("b", 0.0, 0.1), ("b", 1.0, 0.1)], "g string, x double, p double")
    assert {r.g: r.crossing for r in c.crossing(curve, ["g"], "x", "p", 0.5).collect()} == {"a": pytest.approx(1.5), "b": None}
    areas = spark.createDataFrame([("a", 0.6)] * 9 + [("a", 0.4)] + [("a", 0.5)] + [("b", 0.5)], "g string, auc double")
    got = {r.g: r.p for r in c.sign_test(areas, ["g"]).collect()}
    assert got["a"] == pytest.approx(22 / 1024) and got["b"] == 1
    words = spark.createDataFrame([(1.0,), (3.0,), (0.05,), (150.0,), (5000.0,)], "lr double").select(c.verbal("lr"), c.verbal("lr", F.lit(True))).collect()
    assert [tuple(r) for r in words] == [("no support", "no support"), ("weak", "no support"), ("moderate", "weak"), ("strong", "moderate"), ("very strong", "strong")]


def test_fan_out_and_p(spark):
    cells = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 2.0)], "arm string, score double")
    draws = c.fan_out(cells, ["arm"], 4, lambda pdf, d: {"v": pdf["score"].sum() + d}, "v double")
    assert sorted((r.arm, r.draw, r.v) for r in draws.collect()) == sorted([("a", d, 10.0 + d) for d in range(4)] + [("b", d, 2.0 + d) for d in range(4)])
    p = draws.groupBy("arm").agg(c.p_value("v", F.lit(11.0)).alias("p"))
    assert {r.arm: r.p for r in p.collect()} == {"a": 3 / 5, "b": 1.0}
    verdicts = spark.createDataFrame([(0.01, 0.5), (0.01, 0.99), (0.05, 0.1)], "p double, c double").select(c.verdict("p", "c"))
    assert [r[0] for r in verdicts.collect()] == ["informative", "detectable, not useful", "no evidential value"]


def test_ensemble():
    rng = np.random.default_rng(1)
    y = rng.random(600) < 0.5
    x = rng.normal(size=(600, 40))
    x[:, :5] += 1.2 * y[:, None]
    m = c.FisherEnsemble(sizes=(4, 20), seed=3).fit(x[:400], y[:400])
    assert ((m.decision(x[400:]) > 0.5) == y[400:]).mean() > 0.85 and m.oob_error < 0.25
    null = c.FisherEnsemble(sizes=(4,), seed=3).fit(x[:400], rng.permutation(y[:400]))
    assert abs(((null.decision(x[400:]) > 0.5) == y[400:]).mean() - 0.5) < 0.15


def test_power_grows_with_the_shift(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.normal(size=60)
    hit = lambda shift: np.mean([c.shifted_replicate(a, b, shift, s, 19) <= 0.05 for s in range(4)])
    assert hit(2.0) == 1.0 and hit(0.0) < 1.0
    parts = [F.lit(1.0), F.lit(2.0)]
    assert len(c.shares(F.lit(4.0), dict(zip("ab", parts, strict=True)))) == 2
