"""The power curve runs bootstrap replicates with a permutation null of their own."""

import numpy as np
import pytest

from tallyglass.operators import calibrate as c
from tallyglass.plans import results


def test_power_curve_counts_rejections(spark, monkeypatch):
    rng = np.random.default_rng(3)
    clean, noise = rng.normal(size=30), rng.normal(size=30)
    rows = [("a", "spa", f"c{i:02d}", float(noise[i]), float(clean[i])) for i in range(30)] + [("b", "spa", "c", 1.0, 0.0)]
    pairs = spark.createDataFrame(rows, "arm string, detector string, cover string, stego double, clean double")
    monkeypatch.setattr(results, "_pairs", lambda *_: pairs)
    for name, value in (("SHIFTS", (0.0, 3.0)), ("REPLICATES", 3), ("POWER_DRAWS", 19), ("FOLD_SEEDS", 2), ("REPLICATE_BLOCK", 4)):
        monkeypatch.setattr(results, name, value)
    got = {r.x: r for r in results.power_curve(spark, "").collect()}
    for x in (0.0, 3.0):
        ps = [c.shifted_replicate(noise, clean, x, (0, k, round(x * 1e6)), 19, seeds=2, flip_seed=k) for k in range(3)]
        assert (got[x].n, got[x].hits) == (3, sum(p <= 0.05 for p in ps)) and got[x].low <= got[x].power <= got[x].high
    assert got[3.0].power == 1.0
    low, high = got[0.0].power, got[3.0].power
    assert got[0.0].crossing_80 == (pytest.approx((0.8 - low) / (high - low) * 3) if low < 0.8 else 0.0)


def test_defaults_are_the_whole_job():
    assert (len(results.SHIFTS), results.REPLICATES, results.POWER_DRAWS, results.FOLD_SEEDS, c.FOLDS) == (7, 100, 100, 20, 10)
