"""The decisions of the power curve: the same as whole replicates give, without fitting each of their labellings."""

import numpy as np
import pytest

from tallyglass.operators import calibrate as c
from tallyglass.plans import results

SHIFTS = [0.0, 0.2, 0.45, 3.0]


def scores(kind, n):
    rng = np.random.default_rng(n)
    clean, stego = rng.normal(size=n), rng.normal(size=n) + 0.1
    return {
        "normal": (stego, clean), "near": (clean + 0.3 * stego, clean), "apart": (stego + 9, clean), "heavy": (rng.standard_t(1.5, n), rng.standard_t(1.5, n)),
        "ties": (stego.round(), clean.round()), "same": (clean, clean), "flat": (np.ones(n), np.ones(n)), "skewed": (np.exp(stego), np.exp(clean)), "far": (stego * 1e-7 + 1e6, clean * 1e-7 + 1e6),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "near", "apart", "heavy", "ties", "same", "flat", "skewed", "far"])
@pytest.mark.parametrize("n", [10, 33, 350])
def test_decisions_equal_whole_replicates(kind, n):
    stego, clean = scores(kind, n)
    for rep in range(2):
        seeds_of = [(0, rep, round(x * 1e6)) for x in SHIFTS]
        got = c.rejections(stego, clean, SHIFTS, seeds_of, 39, seeds=2, flip_seed=rep)
        want = [c.shifted_replicate(stego, clean, x, s, 39, seeds=2, flip_seed=rep) <= 0.05 for x, s in zip(SHIFTS, seeds_of, strict=True)]
        assert got == want


def test_costs_of_few_pairs():
    rng = np.random.default_rng(5)
    for n, shift in ((14, 0.0), (40, 0.5), (40, 4.0)):
        pos, neg = rng.normal(size=n) + shift, rng.normal(size=n)
        got = c._direct_cost(pos, neg, c._deal(n, 10, 3), 10)
        assert np.isnan(got) or got == pytest.approx(c.paired_costs(pos, neg, np.zeros((1, n), bool), 3, 10).mean(), abs=1e-6)


def test_least_draws_and_bad_scores():
    stego, clean = scores("apart", 60)
    assert c.rejections(stego, clean, [0.0], [0], 19, seeds=2) == [True]
    assert c.rejections(stego, clean, [0.0], [0], 18, seeds=2) == [False]  # its least p is above the level
    with pytest.raises(ValueError):
        c.rejections(np.append(stego, np.nan), np.append(clean, 0), [0.0], [0], 19, seeds=2)
    with pytest.raises(ValueError):
        c.rejections(stego[:9], clean[:9], [0.0], [0], 19, seeds=2)


def test_a_replicate_does_not_fit_each_labelling(monkeypatch):
    import pandas as pd

    fitted, whole = [], c.paired_costs
    monkeypatch.setattr(c, "paired_costs", lambda stego, clean, flips, *rest: fitted.append(len(flips)) or whole(stego, clean, flips, *rest))
    stego, clean = scores("normal", 600)
    pdf = pd.DataFrame({"cover": [f"c{i:03d}" for i in range(600)], "stego": stego, "clean": clean})
    grid = [(rep, x) for rep in range(2) for x in results.SHIFTS]
    done = results._replicates(grid, results.POWER_DRAWS, results.FOLD_SEEDS, pdf, range(len(grid)))
    assert [d["x"] for d in done] == [x for _, x in grid] and sum(fitted) < len(grid)


@pytest.mark.parametrize("n, shift", [(30, 0.0), (100, 1.0), (490, 2.0), (490, 5.0)])
def test_a_bound_on_the_cost_holds(n, shift):
    rng = np.random.default_rng(n)
    z = rng.normal(size=2 * n) + np.repeat([shift, 0.0], n)
    z = (z - z.mean()) / z.std()
    most, cost = c._most_cost(z[:n], z[n:], c._deal(n, 10, 4), 10), c.paired_costs(z[:n], z[n:], np.zeros((1, n), bool), 4, 10).mean()
    assert cost <= most and (shift != 2.0 or most < cost + 0.05)


def test_a_strong_effect_needs_no_fits(monkeypatch):
    monkeypatch.setattr(c, "paired_costs", None)
    rng = np.random.default_rng(6)
    assert c.rejections(rng.normal(size=2000) + 1.2, rng.normal(size=2000), [0.0, 0.45], [0, 1]) == [True, True]
