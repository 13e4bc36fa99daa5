"""The registered isotonic fit pools equal scores only."""

from tallyglass.plans import results


def test_near_scores_are_not_ties(spark, monkeypatch):
    rows = [("a", "spa", f"c{i}", 0.5002 + i / 1e5, 0.5001 - i / 1e5) for i in range(5)]
    monkeypatch.setattr(results, "_pairs", lambda *_: spark.createDataFrame(rows, "arm string, detector string, cover string, stego double, clean double"))
    row = results.pav_calibration(spark, "").first()
    assert (row.low, row.high, row.steps) == (0.0, 1.0, 2)
