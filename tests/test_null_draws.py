"""Permutation nulls of whole cells: every detector, every draw averaged over the fold seeds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import calibrate as c
from tallyglass.plans import results

FOLDER = "/root/testdata/sf0.001"


def direct(stego, clean, flip, seeds, folds):
    y, g, s = np.repeat([True, False], len(stego)), np.tile(np.arange(len(stego)), 2), np.concatenate([stego, clean])
    z, out = y ^ flip[g], []
    for seed in range(seeds):
        lr = c.cross_validated(s, z, folds, seed=seed, groups=g)
        out.append(c.cllr_of(lr[z], lr[~z]))
    return out


@pytest.mark.parametrize("n, shift", [(12, 0.0), (60, 0.3), (60, 9.0), (3000, 0.1)])
def test_paired_costs_equal_one_fit_per_fold(n, shift):
    rng = np.random.default_rng(n)
    clean = rng.standard_t(4, size=n)
    stego = clean * 0.8 + shift + rng.normal(size=n) * 0.3
    flips = np.concatenate([np.zeros((1, n), bool), c.pair_flips(n, 2)])
    got = c.paired_costs(stego, clean, flips, 3, 10)
    assert np.allclose(got, [direct(stego, clean, f, 3, 10) for f in flips], rtol=0, atol=2e-8)


def test_equal_sides_cost_exactly_one_bit():
    x = np.random.default_rng(1).normal(size=200)
    assert np.allclose(c.paired_costs(x, x, c.pair_flips(200, 3), 4, 10), 1, rtol=0, atol=1e-13)
    assert (c.paired_costs(np.ones(20), np.ones(20), c.pair_flips(20, 2), 2, 10) == 1).all()


def test_first_draws_do_not_depend_on_the_block():
    assert (c.pair_flips(50, 3) == c.pair_flips(50, 9)[:3]).all()


@pytest.fixture(scope="module")
def pairs(spark):
    """Three detectors on one arm of 40 pairs, one of which tells the sides apart, and a cell with too few pairs."""
    rng = np.random.default_rng(7)
    rows = []
    for d, shift in (("aletheia_rs", 0.0), ("aletheia_spa", 3.0), ("stegexpose", 0.2)):
        for i in range(40):
            clean = float(rng.normal())
            rows.append(("a", d, f"c{i:02d}", clean * 0.5 + shift, clean))
    rows += [("b", "stegexpose", f"c{i}", 1.0, 0.5) for i in range(4)]
    return spark.createDataFrame(rows, "arm string, detector string, cover string, stego double, clean double").cache()


def averaged(pairs, detector):
    p = pairs.filter((F.col("arm") == "a") & (F.col("detector") == detector)).toPandas().sort_values("cover")
    stego, clean = p["stego"].to_numpy(), p["clean"].to_numpy()
    null = [np.mean(direct(stego, clean, f, 20, 10)) for f in c.pair_flips(40, 200)]
    return np.mean(direct(stego, clean, np.zeros(40, bool), 20, 10)), np.array(null)


def test_pvalue_of_every_detector(spark, monkeypatch, pairs):
    monkeypatch.setattr(results, "_pairs", lambda *_: pairs)
    got = {(r.arm, r.detector): r for r in results.permutation_pvalue(spark, FOLDER).collect()}
    assert set(got) == {("a", "aletheia_rs"), ("a", "aletheia_spa"), ("a", "stegexpose"), ("b", "stegexpose")}
    seen, null = averaged(pairs, "aletheia_rs")
    assert got["a", "aletheia_rs"].cllr == pytest.approx(seen, abs=1e-8)
    assert got["a", "aletheia_rs"].p == pytest.approx((1 + (null <= seen).sum()) / 201, abs=1e-9)
    assert got["a", "aletheia_spa"].p == pytest.approx(1 / 201, abs=1e-9) and got["a", "aletheia_spa"].verdict == "informative"
    assert got["b", "stegexpose"].p is None and got["b", "stegexpose"].verdict == "too few scored to calibrate"


def test_mde_of_every_detector(spark, monkeypatch, pairs):
    monkeypatch.setattr(results, "_pairs", lambda *_: pairs)
    got = {(r.arm, r.detector): r for r in results.mde_summary(spark, FOLDER).collect()}
    assert set(got) == {("a", "aletheia_rs"), ("a", "aletheia_spa"), ("a", "stegexpose")}
    seen, null = averaged(pairs, "aletheia_rs")
    null, r = np.sort(null), got["a", "aletheia_rs"]
    low, high, mean = null[9], null[190], null.mean()
    assert r.n == 200 and (r.crit_low, r.crit_high, r.observed) == pytest.approx((low, high, seen), abs=1e-8)
    assert (r.mde_down, r.mde_up, r.observed_effect) == pytest.approx((mean - low, high - mean, mean - seen), abs=1e-8)
    assert r.shortfall_ratio == pytest.approx((mean - seen) / (mean - low), abs=1e-5)
