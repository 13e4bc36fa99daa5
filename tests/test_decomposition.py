"""The registered decomposition against ``observed`` with the reference's seeds and folds."""

import numpy as np
import pytest

from tallyglass.operators import calibrate as c
from tallyglass.plans import results


def test_decomposition_has_all_seeds_and_folds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    clean = rng.normal(size=40)
    stego = clean * 0.5 + rng.normal(size=40) + 0.4
    rows = [("a", "spa", f"c{i:02d}", float(stego[i]), float(clean[i])) for i in range(40)] + [("b", "spa", "c", 1.0, 0.0)]
    monkeypatch.setattr(results, "_pairs", lambda *_: spark.createDataFrame(rows, "arm string, detector string, cover string, stego double, clean double"))
    got = {r.arm: r for r in results.cllr_decomposition(spark, "").collect()}
    want = c.observed(np.concatenate([stego, clean]), np.repeat([True, False], 40), 20, 10, groups=np.tile(np.arange(40), 2))
    assert got["a"].n == 80 and got["b"].cllr is None
    assert {k: got["a"][k] for k in want} == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
