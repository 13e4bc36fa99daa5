"""Likelihood ratios from scores: calibration, cost, cross-validation, permutation nulls, power.

Numeric kernels are plain numpy; ``fan_out`` runs one cell (arm x detector x seed or permutation) per group in Arrow batches, so
the many independent fits spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of a reported likelihood ratio and the probability next to 0 or 1 that a fit may give.
BOUND = 100.0
EPSILON = 1e-12
FOLDS = 10


def cllr(lrs: DataFrame, group: list[str], lr: str = "lr", label: str = "label") -> DataFrame:
    """``group, cllr``: half the sum of the mean costs of either side, in bits.

    A ratio of 0 for a positive costs infinity. Null where a side is empty or a ratio is negative or null.
    """
    v = F.col(lr)
    pos = F.when(F.col(label), F.when(v == 0, F.lit(float("inf"))).otherwise(F.log1p(F.try_divide(F.lit(1.0), v)) / math.log(2)))
    neg = F.when(~F.col(label), F.log1p(v) / math.log(2))
    bad = F.max(v.isNull() | (v < 0) | F.isnan(v))
    return lrs.groupBy(*group).agg(F.when(~bad, (F.avg(pos) + F.avg(neg)) / 2).alias("cllr"))


def bound_cost(bound: float = BOUND) -> float:
    """Cost of a perfect detector whose ratios are cut at the bound."""
    return math.log2(1 + 1 / bound)


def cllr_of(pos: np.ndarray, neg: np.ndarray) -> float:
    """``cllr`` of two arrays; refuses empty sides and negative ratios."""
    pos, neg = np.asarray(pos, float), np.asarray(neg, float)
    if not len(pos) or not len(neg):
        raise ValueError("both sides need a ratio")
    if (pos < 0).any() or (neg < 0).any():
        raise ValueError("a likelihood ratio is never negative")
    with np.errstate(divide="ignore"):
        return float((np.log2(1 + 1 / pos).mean() + np.log2(1 + neg).mean()) / 2)


def pav(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Isotonic probabilities: ties share one value, neighbours are pooled while a block exceeds its successor."""
    values, where = np.unique(np.asarray(scores, float), return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, np.asarray(labels, float)) / weight
    blocks: list[list[float]] = []  # value, weight, number of distinct scores
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])[where] if len(values) else np.zeros(0)


def decompose(lrs: np.ndarray, labels: np.ndarray, bound: float = BOUND) -> tuple[float, float, float]:
    """``(total, floor, calibration loss)``: the floor is the cost after an isotonic fit of the reported ratios themselves."""
    lrs, labels = np.asarray(lrs, float), np.asarray(labels, bool)
    total = cllr_of(lrs[labels], lrs[~labels])
    p = np.clip(pav(lrs, labels), EPSILON, 1 - EPSILON)
    odds = p / (1 - p) / (labels.sum() / (~labels).sum())
    best = np.clip(odds, 1 / bound, bound)
    floor = cllr_of(best[labels], best[~labels])
    return total, floor, total - floor


class Logistic:
    """Two-parameter logistic calibration by Newton's method on standardised scores."""

    def __init__(self, bound: float = BOUND):
        self.bound = bound

    def fit(self, scores: np.ndarray, labels: np.ndarray) -> Logistic:
        x, y = np.asarray(scores, float), np.asarray(labels, float)
        if not np.isfinite(x).all():
            raise ValueError("a score is not finite")
        self.mean, sd = x.mean(), x.std()
        self.scale = sd if sd > 0 else 1.0
        rate = y.mean()
        if not 0 < rate < 1:
            raise ValueError("both classes are needed")
        self.odds = rate / (1 - rate)
        self.a, self.b = 0.0, math.log(self.odds)
        if sd == 0:
            return self
        z = (x - self.mean) / self.scale
        # separable scores have no finite optimum; a vanishing ridge keeps the step finite and the gradient within tolerance
        ridge = 1e-6
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -700, 700)))
            g = np.array([((p - y) * z).sum() + ridge * self.a, (p - y).sum()])
            if np.abs(g).max() / len(y) < 1e-10:
                break
            w = p * (1 - p) + 1e-12
            h = np.array([[(w * z * z).sum() + ridge, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            step /= max(1.0, np.abs(step).max() / 5)
            self.a, self.b = self.a - step[0], self.b - step[1]
        p = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -700, 700)))
        if max(abs(((p - y) * z).mean()), abs((p - y).mean())) > 1e-3:
            raise ValueError("the fit did not settle")
        return self

    def transform(self, scores: np.ndarray) -> np.ndarray:
        z = self.a * (np.asarray(scores, float) - self.mean) / self.scale + self.b
        return np.clip(np.exp(np.clip(z, -700, 700)) / self.odds, 1 / self.bound, self.bound)


def folds_of(labels: np.ndarray, groups: np.ndarray | None, folds: int, seed: int) -> np.ndarray:
    """Fold per row: stratified by label, or by whole groups so that a cover is never on two sides."""
    rng = np.random.default_rng(seed)
    if groups is not None:
        names, where = np.unique(groups, return_inverse=True)
        if len(names) < folds:
            raise ValueError("fewer groups than folds")
        return (rng.permutation(len(names)) % folds)[where]
    out = np.empty(len(labels), int)
    for side in (False, True):
        at = np.flatnonzero(labels == side)
        if len(at) < folds:
            raise ValueError("fewer cases than folds")
        out[rng.permutation(at)] = np.arange(len(at)) % folds
    return out


def cross_validated(scores: np.ndarray, labels: np.ndarray, folds: int = FOLDS, bound: float = BOUND, seed: int = 0, groups: np.ndarray | None = None) -> np.ndarray:
    """Ratio of every row from a fit that didn't see its fold."""
    scores, labels = np.asarray(scores, float), np.asarray(labels, bool)
    fold = folds_of(labels, groups, folds, seed)
    out = np.empty(len(scores))
    for k in range(folds):
        held = fold == k
        if held.any():
            out[held] = Logistic(bound).fit(scores[~held], labels[~held]).transform(scores[held])
    return out


def observed(scores, labels, seeds: int = 20, folds: int = FOLDS, bound: float = BOUND, groups=None) -> dict[str, float]:
    """Mean decomposition over fold seeds, with the population deviation of the totals."""
    parts = np.array([decompose(cross_validated(scores, labels, folds, bound, s, groups), labels, bound) for s in range(seeds)])
    total, floor, loss = parts.mean(0)
    return {"cllr": total, "cllr_min": floor, "cllr_cal": loss, "sd": parts[:, 0].std()}


def permuted(labels: np.ndarray, pairs: np.ndarray | None, seed: int) -> np.ndarray:
    """Labels of a null draw: shuffled freely, or flipped within pairs."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, bool)
    if pairs is None:
        return rng.permutation(labels)
    _, where = np.unique(pairs, return_inverse=True)
    return labels ^ (rng.random(where.max() + 1) < 0.5)[where]


def pair_flips(pairs: int, upto: int, seed: int = 0) -> np.ndarray:
    """``(upto, pairs)``: which pairs swap their labels in each of the first null draws of one random stream."""
    rng = np.random.default_rng(seed)
    return np.array([rng.integers(0, 2, pairs) for _ in range(upto)], bool).reshape(upto, pairs)


def _moments(z: np.ndarray, y: float, a: float, b: float) -> np.ndarray:
    """Per row, the gradient of the logistic loss at (a, b) and its next three derivatives, each times powers of ``z``."""
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -700, 700)))
    w = p * (1 - p)
    powers = np.stack([np.ones_like(z), z, z * z, z**3, z**4], 1)
    return np.concatenate([(p - y)[:, None] * powers[:, :2], w[:, None] * powers[:, :3], (w * (1 - 2 * p))[:, None] * powers[:, :4], (w * (1 - 6 * w))[:, None] * powers], 1)


def _polynomial(t: np.ndarray, da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradient (of b, of a) and its derivatives at an offset, from summed ``_moments`` of any number of training sides."""
    at = lambda first, j: t[:, first + j]
    two = lambda first, j: at(first, j) * db * db + 2 * at(first, j + 1) * da * db + at(first, j + 2) * da * da
    g = [at(0, j) + at(2, j) * db + at(2, j + 1) * da + two(5, j) / 2 + (at(9, j) * db**3 + 3 * at(9, j + 1) * da * db * db + 3 * at(9, j + 2) * da * da * db + at(9, j + 3) * da**3) / 6 for j in (0, 1)]
    h = [at(2, j) + at(5, j) * db + at(5, j + 1) * da + two(9, j) / 2 for j in (0, 1, 2)]
    return g[0], g[1], h[0], h[1], h[2]


def paired_costs(stego: np.ndarray, clean: np.ndarray, flips: np.ndarray, seeds: int = 20, folds: int = FOLDS, bound: float = BOUND) -> np.ndarray:
    """``(draws, seeds)``: cross-validated cost of each labelling of the pairs, whole pairs being dealt to folds.

    Row ``d`` of ``flips`` says which pairs swap their labels. The same numbers as ``cllr_of`` over ``cross_validated``, which
    fits ``draws x seeds x folds`` times: here all seeds and folds of a draw start at its fit to all rows. What a training side
    lacks is a fold, so its optimum is near; it is found from derivatives summed by fold. Where their remainder could count,
    the true gradients of the training sides are taken until they vanish, and what does not settle is fitted by itself.
    """
    m, both = len(stego), np.concatenate([stego, clean]).astype(float)
    if not np.isfinite(both).all():
        raise ValueError("a score is not finite")
    if m < folds:
        raise ValueError("fewer groups than folds")
    out, sd = np.empty((len(flips), seeds)), both.std()
    if sd == 0:
        return np.ones_like(out)
    z = (both - both.mean()) / sd
    zs, zc = z[:m], z[m:]
    deal = np.array([np.random.default_rng(s).permutation(m) % folds for s in range(seeds)])
    into = (deal[:, None, :] == np.arange(folds)[:, None]).reshape(seeds * folds, m).astype(float)
    heavy, top, ridge = max(1.0, (z**4).mean(), (np.abs(z) ** 5).mean()), math.log(bound), 1e-6
    for d, flip in enumerate(flips):
        pos, neg = np.where(flip, zc, zs), np.where(flip, zs, zc)
        near = Logistic(bound).fit(np.concatenate([pos, neg]), np.repeat([True, False], m))
        a = near.a / near.scale
        b = near.b - a * near.mean
        each = _moments(pos, 1.0, a, b) + _moments(neg, 0.0, a, b)
        train = each.sum(0) - into @ each
        train[:, 1] += ridge * a
        train[:, 4] += ridge
        da = db = np.zeros(len(train))
        with np.errstate(all="ignore"):
            for _ in range(6):
                gb, ga, hbb, hab, haa = _polynomial(train, da, db)
                det = hbb * haa - hab * hab
                da, db = da - (hbb * ga - hab * gb) / det, db - (haa * gb - hab * ga) / det
            rest = np.nan_to_num((da**4 * heavy + db**4) / 24, nan=np.inf).reshape(seeds, folds).max(1)
        fits, bad = np.stack([a + da, b + db], 1), np.repeat(rest > 1e-8, folds)
        if bad.any():
            fits[bad], settled = _refined(fits[bad], np.stack([hbb, hab, haa], 1)[bad], pos, neg, 1 - into[bad], ridge)
            bad[bad] = ~settled
        fits, bad = fits.reshape(seeds, folds, 2), bad.reshape(seeds, folds).any(1)
        for s in range(seeds):
            if bad[s]:
                y, g = np.repeat([True, False], m), np.tile(np.arange(m), 2)
                lr = cross_validated(np.concatenate([pos, neg]), y, folds, bound, s, g)
                out[d, s] = cllr_of(lr[:m], lr[m:])
                continue
            ka, kb = fits[s, deal[s]].T
            up, down = np.clip(ka * pos + kb, -top, top), np.clip(ka * neg + kb, -top, top)
            out[d, s] = (np.log1p(np.exp(-up)).mean() + np.log1p(np.exp(down)).mean()) / (2 * math.log(2))
    return out


def _refined(fits: np.ndarray, curve: np.ndarray, pos: np.ndarray, neg: np.ndarray, keep: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)`` of each training side (a row of ``keep``) moved until its true gradient vanishes, and whether it did."""
    a, b = fits.T.copy()
    hbb, hab, haa = curve.T
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(a[:, None] * z + b[:, None], -700, 700)))
    n, done = 2 * keep.sum(1), np.zeros(len(a), bool)
    with np.errstate(all="ignore"):
        det = hbb * haa - hab * hab
        for _ in range(8):
            up, down = (sigma(pos) - 1) * keep, sigma(neg) * keep
            ga, gb = up @ pos + down @ neg + ridge * a, up.sum(1) + down.sum(1)
            done = (np.maximum(np.abs(ga), np.abs(gb)) / n < 1e-10) & (det > 0)
            if done.all():
                break
            a, b = np.where(done, a, a - (hbb * ga - hab * gb) / det), np.where(done, b, b - (haa * gb - hab * ga) / det)
    return np.stack([a, b], 1), done


def rank_area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Area under the curve from the sum of the positives' mean ranks, ties counting half; NaN where a class is empty."""
    values, where, count = np.unique(np.asarray(scores, float), return_inverse=True, return_counts=True)
    labels = np.asarray(labels, bool)
    ranks = (np.cumsum(count) - (count - 1) / 2)[where]
    n, m = labels.sum(), (~labels).sum()
    return float((ranks[labels].sum() - n * (n + 1) / 2) / (n * m)) if n and m else math.nan


def fan_out(cells: DataFrame, group: list[str], draws: int, kernel, schema: str) -> DataFrame:
    """Run ``kernel(rows, draw) -> dict`` for every cell and draw, each in its own task group.

    Cells are bounded by their design (one arm and detector); rows are replicated once per draw, which is the work itself.
    """
    work = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = dict(zip(group, key[:-1], strict=True)) | {"draw": key[-1]} | kernel(pdf, int(key[-1]))
        return pd.DataFrame([row])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in group)
    return work.groupBy(*group, "draw").applyInPandas(run, f"{kinds}, draw int, {schema}")


def fan_out_blocks(cells: DataFrame, group: list[str], draws: int, block: int, kernel, schema: str) -> DataFrame:
    """``fan_out`` with ``kernel(rows, draws) -> list of dicts``, one for each of up to ``block`` draws: a cell's rows are replicated
    once per block, and what its draws share is made once."""
    work = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))))
    # few bytes and much work: parts must not be coalesced by size
    work = work.repartition(8 * work.sparkSession.sparkContext.defaultParallelism, *group, "_block")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        some = range(int(key[-1]) * block, min(draws, (int(key[-1]) + 1) * block))
        same = dict(zip(group, key[:-1], strict=True))
        return pd.DataFrame([same | {"draw": d} | row for d, row in zip(some, kernel(pdf, some), strict=True)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in group)
    return work.groupBy(*group, "_block").applyInPandas(run, f"{kinds}, draw int, {schema}")


def p_value(null: Column | str, observed_value: Column | str) -> Column:
    """Aggregate: ``(1 + draws at or below the observed value) / (1 + draws)``."""
    n = F.col(null) if isinstance(null, str) else null
    o = F.col(observed_value) if isinstance(observed_value, str) else observed_value
    return (1 + F.count_if(n <= o)) / (1 + F.count(n))


def verdict(p: Column | str, cost: Column | str) -> Column:
    p, cost = (F.col(x) if isinstance(x, str) else x for x in (p, cost))
    return F.when((p < 0.05) & (cost < 0.95), "informative").when(p < 0.05, "detectable, not useful").otherwise("no evidential value")


def shifted_replicate(stego: np.ndarray, clean: np.ndarray, shift: float, seed, permutations: int = 100, folds: int = FOLDS, seeds: int = 20, flip_seed: int | None = None) -> float:
    """The permutation p of one bootstrap replicate: pairs drawn with replacement, the stego side moved by ``shift`` deviations.

    The observed cost and each of the replicate's own null draws are averaged over ``seeds`` fold seeds, whole pairs being
    dealt to folds. ``flip_seed`` (``seed``, if it is a number) begins the stream of the null's flips.
    """
    rng = np.random.default_rng(seed)
    at = rng.integers(0, len(stego), len(stego))
    moved = stego[at] + shift * (np.concatenate([stego, clean]).std() or 1.0)
    flips = np.concatenate([np.zeros((1, len(at)), bool), pair_flips(len(at), permutations, seed if flip_seed is None else flip_seed)])
    costs = paired_costs(moved, clean[at], flips, seeds, folds).mean(1).round(12)
    return float((1 + (costs[1:] <= costs[0]).sum()) / (1 + permutations))


#: Coefficients of t^2, t^4, ... in ``log(2 cosh(t / 2)) - log 2``; its series alternates and falls where ``|t| < pi``.
_EVEN = (1 / 8, -1 / 192, 1 / 2880, -17 / 645120, 31 / 14515200, -691 / 3832012800)
#: Positions whose one-hot folds are made at a time.
_CHUNK = 2048
#: Most pairs whose training sides are fitted all at once.
_FEW = 300


def _series(power: np.ndarray, a: np.ndarray, k: int, j: int) -> np.ndarray:
    """Sum of ``z^j`` times the ``k``-th derivative of the even part of the loss at ``a z``; ``power[i]`` are sums of ``z^i``."""
    terms = [(c * math.perm(2 * i, k), 2 * i - k) for i, c in enumerate(_EVEN[:-1], 1) if 2 * i >= k]
    out, square = 0.0, a * a
    for c, n in reversed(terms):
        out = out * square + c * power[n + j]
    return out * a ** terms[0][1] if terms[0][1] else out


def _settle(power: np.ndarray, total: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b)`` of least ``-a total / 2 +`` even part, and the mean gradient that is left."""
    rows = power[0]
    a = 2 * total / power[2]
    b = -a * power[1] / rows
    for step in range(5):
        s = lambda k, j: _series(power, a, k, j)
        s20, s21, s30, s31, s40, s41 = s(2, 0), s(2, 1), s(3, 0), s(3, 1), s(4, 0), s(4, 1)
        ga = s(1, 1) - total / 2 + b * (s21 + b * (s31 / 2 + b * s41 / 6)) + ridge * a
        gb = s(1, 0) + b * (s20 + b * (s30 / 2 + b * s40 / 6))
        left = np.maximum(np.abs(ga), np.abs(gb)) / rows
        if step == 4 or left.max() < 1e-11:
            break
        haa, hab, hbb = s(2, 2) + b * s(3, 2) + ridge, s21 + b * s31, s20 + b * s30
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a, b, left


def _loss(power: np.ndarray, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed loss at ``(a, b)`` of the rows with these sums."""
    s = lambda k: _series(power, a, k, 0)
    return math.log(2) * power[0] - a * total / 2 + s(0) + b * (s(1) + b * (s(2) / 2 + b * (s(3) / 6 + b * s(4) / 24)))


def _slack(a: np.ndarray, b: np.ndarray, tail: np.ndarray, largest: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How far a cost from the series may be off: infinite beyond its radius. ``tail`` is the mean of ``z`` to the first power left out."""
    n = 2 * len(_EVEN)
    with np.errstate(all="ignore"):
        out = 1e-9 + 20 * -_EVEN[-1] * (np.abs(a) * tail ** (1 / n) + np.abs(b)) ** n + np.abs(b) ** 5 / 48
        return np.where((np.abs(a) * largest + np.abs(b) < 3) & (left < 1e-9), out, np.inf)


@lru_cache(maxsize=1)
def _deal(pairs: int, folds: int, seeds: int) -> np.ndarray:
    """``(seeds, pairs)``: fold of each pair under each fold seed, the same as ``paired_costs`` has."""
    return np.array([np.random.default_rng(s).permutation(pairs) % folds for s in range(seeds)], np.int16 if folds < 2**15 else int)


def _fold_sums(deal: np.ndarray, folds: int, columns: Callable[[slice], np.ndarray]) -> np.ndarray:
    """``(seeds * folds, columns)``: sums of the columns, made for some positions at a time, over the positions dealt to each fold."""
    out = 0.0
    for low in range(0, deal.shape[1], _CHUNK):
        at = slice(low, low + _CHUNK)
        into = deal[:, None, at] == np.arange(folds, dtype=deal.dtype)[:, None]
        out = out + into.reshape(len(deal) * folds, -1).astype(float) @ columns(at)
    return out


def _direct_cost(pos: np.ndarray, neg: np.ndarray, deal: np.ndarray, folds: int, bound: float = BOUND) -> float:
    """Averaged cross-validated cost of one labelling by the steps of ``Logistic``, all training sides at once; NaN if one does not settle."""
    keep = (deal[:, None, :] != np.arange(folds)[:, None]).reshape(-1, len(pos)).astype(float)
    n, top, ridge = 2 * keep.sum(1), math.log(bound), 1e-6
    mean = keep @ (pos + neg) / n
    scale = np.sqrt((keep * ((pos - mean[:, None]) ** 2 + (neg - mean[:, None]) ** 2)).sum(1) / n)
    if not (scale > 1e-9 * max(np.abs(pos).max(), np.abs(neg).max())).all():
        return math.nan
    up, down = (pos - mean[:, None]) / scale[:, None], (neg - mean[:, None]) / scale[:, None]
    a, b, live = np.zeros(len(n)), np.zeros(len(n)), np.arange(len(n))
    rate = lambda z: 1 / (1 + np.exp(-np.clip(a[live, None] * z + b[live, None], -700, 700)))
    for _ in range(101):
        u, d, k = up[live], down[live], keep[live]
        p, q = rate(u), rate(d)
        ga, gb = (k * ((p - 1) * u + q * d)).sum(1) + ridge * a[live], (k * (p - 1 + q)).sum(1)
        open_ = np.maximum(np.abs(ga), np.abs(gb)) / n[live] >= 1e-10
        if not open_.any():
            break
        v, w = k * (p * (1 - p) + 1e-12), k * (q * (1 - q) + 1e-12)
        haa, hab, hbb = (v * u * u + w * d * d).sum(1) + ridge, (v * u + w * d).sum(1), (v + w).sum(1)
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        much = np.maximum(1.0, np.maximum(np.abs(da), np.abs(db)) / 5)
        a[live] -= np.where(open_, da / much, 0)
        b[live] -= np.where(open_, db / much, 0)
        live = live[open_]
    else:
        return math.nan
    side = np.arange(len(deal))[:, None] * folds + deal
    ka, kb = a[side] / scale[side], b[side] - a[side] * mean[side] / scale[side]
    up, down = np.clip(ka * pos + kb, -top, top), np.clip(ka * neg + kb, -top, top)
    return float((np.log1p(np.exp(-up)).mean() + np.log1p(np.exp(down)).mean()) / (2 * math.log(2)))


def _most_cost(pos: np.ndarray, neg: np.ndarray, deal: np.ndarray, folds: int, bound: float = BOUND) -> float:
    """A bound from above on the averaged cross-validated cost of one labelling, from its fit to all rows; infinite if there is none.

    The loss is self-concordant: how far a training side's fit lies from that fit, ``far`` at most at any row, follows from its
    gradient there. Cutting at ``bound`` adds at most the cost of a row at the bound.
    """
    m, ridge = len(pos), 1e-6
    try:
        fit = Logistic(bound).fit(np.concatenate([pos, neg]), np.repeat([True, False], m))
    except ValueError:
        return math.inf
    a = fit.a / fit.scale
    b = fit.b - a * fit.mean
    up, down = a * pos + b, a * neg + b
    p, q = (1 / (1 + np.exp(-np.clip(t, -700, 700))) for t in (up, down))
    v, w = p * (1 - p), q * (1 - q)
    columns = np.stack([(p - 1) * pos + q * neg, p - 1 + q, v * pos * pos + w * neg * neg, v * pos + w * neg, v + w, np.ones(m)], 1)
    held = _fold_sums(deal, folds, lambda at: columns[at]).T
    ga, gb, haa, hab, hbb, _ = columns.sum(0)[:, None] - held
    ga, haa = ga + ridge * a, haa + ridge
    with np.errstate(all="ignore"):
        norm = lambda x, y: np.sqrt((hbb * x * x - 2 * hab * x * y + haa * y * y) / (haa * hbb - hab * hab))
        end = max(np.abs(pos).max(), np.abs(neg).max())
        reach = np.maximum(norm(end, 1.0), norm(-end, 1.0))
        far = -np.log1p(-reach * norm(ga, gb))
        more = (norm(held[0], held[1]) * far / reach + held[5] * far**2 / 4).sum() / len(deal)
    most = (np.logaddexp(0, -up).sum() + np.logaddexp(0, down).sum() + more) / (2 * m * math.log(2)) + bound_cost(bound) + 1e-9
    return most if np.isfinite(most) else math.inf


def rejections(stego: np.ndarray, clean: np.ndarray, shifts: list[float], seeds_of: list, permutations: int = 100, folds: int = FOLDS, seeds: int = 20, flip_seed: int = 0, alpha: float = 0.05) -> list[bool]:
    """Whether ``shifted_replicate`` is within ``alpha``, for replicates (a shift and a seed each) with the same stream of flips.

    Swapping a pair's labels leaves the even part of its loss as it is and turns the sign of the rest, which is linear: the
    loss of a labelling is ``-a D / 2`` with its own ``D`` (the sum of signed differences) plus what all labellings share. So
    sums of powers by fold, made once a replicate, give every labelling's fits and costs from its ``D`` by fold. A cross-validated
    cost is never below the least cost on all rows, which falls as ``|D|`` grows: draws whose least cost is above the observed
    cost need no folds, the others are taken in the order of that cost until the number at or below the observed one is
    settled. Every comparison has a bound on the error of both sides; what is within it, or beyond the series, is
    decided by the costs of ``paired_costs``, as ``shifted_replicate`` does.
    """
    m, bound = len(stego), math.log(BOUND)
    scale = np.concatenate([stego, clean]).std() or 1.0
    most = int((np.arange(1, permutations + 2) / (1 + permutations) <= alpha).sum()) - 1  # draws at or below that still reject
    flips = pair_flips(m, permutations, flip_seed)
    moved, kept, zs, zc = [], [], [], []
    for x, seed in zip(shifts, seeds_of, strict=True):
        at = np.random.default_rng(seed).integers(0, m, m)
        moved.append(stego[at] + x * scale)
        kept.append(clean[at])
        both = np.concatenate([moved[-1], kept[-1]]).astype(float)
        if not np.isfinite(both).all():
            raise ValueError("a score is not finite")
        z = (both - both.mean()) / (both.std() or 1.0)
        zs.append(z[:m])
        zc.append(z[m:])
    if m < folds:
        raise ValueError("fewer groups than folds")
    zs, zc = np.stack(zs, 1), np.stack(zc, 1)
    jobs, degree = len(shifts), 2 * len(_EVEN) - 2
    difference, same = zs - zc, (zs.std(0) + zc.std(0) + np.abs(zs - zc).max(0)) == 0
    total = np.zeros((permutations + 1, jobs))
    for low in range(0, m, _CHUNK):
        total[1:] += (1.0 - 2.0 * flips[:, low : low + _CHUNK]) @ difference[low : low + _CHUNK]
    total[0] = difference.sum(0)
    deal = _deal(m, folds, seeds)

    def powers(at: slice) -> np.ndarray:
        s, c = zs[at], zc[at]
        columns, ps, pc = [difference[at], difference[at] ** 2], 1.0, 1.0
        for _ in range(degree):
            ps, pc = ps * s, pc * c
            columns.append(ps + pc)
        return np.concatenate(columns, 1)

    sums = _fold_sums(deal, folds, powers).reshape(-1, degree + 2, jobs).transpose(1, 0, 2)
    tail = sum(((z * z * z) ** 4).mean(0) / 2 for z in (zs, zc))
    largest = np.maximum(np.abs(zs).max(0), np.abs(zc).max(0))
    size = np.broadcast_to(2.0 * np.array([np.bincount(d, minlength=folds) for d in deal]).reshape(-1, 1), sums.shape[1:])
    first, squares, held = sums[0], sums[1], np.concatenate([size[None], sums[2:]])
    whole = held[:, :folds].sum(1)
    train = whole[:, None] - held

    def costs(of: np.ndarray, part: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Averaged cross-validated costs of labellings of the jobs ``of``, and how far they may be off."""
        a, b, left = _settle(train[:, :, of], all_ - part)
        cost = _loss(held[:, :, of], part, a, b).sum(0) / (seeds * 2 * m * math.log(2))
        return cost, _slack(np.abs(a).max(0), np.abs(b).max(0), tail[of], largest[of], left.max(0))

    with np.errstate(all="ignore"):
        seen, off = costs(np.arange(jobs), first, total[0])
        a, b, left = _settle(np.repeat(whole[:, None], permutations, 1), total[1:])
        least = _loss(np.repeat(whole[:, None], permutations, 1), total[1:], a, b) / (2 * m * math.log(2))
        least = least - _slack(a, b, tail, largest, left)
        # the cost cuts a held-out row's loss at the bound; no fit of a draw reaches it where this holds: on the way from 0 to a
        # fit the linear part gains at least what the even part loses, which up to the bound is at least a quadratic
        spread, n = train[2] - train[1] ** 2 / train[0], train[0]
        reach = (np.abs(total[1:]) + np.sqrt(size / 2 * squares).max(0)) / spread.min(0)
        far = largest + (np.abs(train[1]) / n).max(0)
        least = np.where(reach * (far + np.sqrt(far**2 + (spread / n).max(0))) / 2 < math.tanh(bound / 2), least, -np.inf)

    exact = [{} for _ in range(jobs)]

    def exactly(r: int, d: int) -> float:
        """The averaged cost of draw ``d`` (0 is the true labelling), as ``shifted_replicate`` takes it."""
        if d not in exact[r]:
            flip = np.zeros((1, m), bool) if d == 0 else flips[d - 1 : d]
            exact[r][d] = float(paired_costs(moved[r], kept[r], flip, seeds, folds).mean(1).round(12)[0])
        return exact[r][d]

    def anew(r: int, d: int) -> tuple[float, float]:
        """The cost of a draw that the series does not give, and how far it may be off."""
        if m <= _FEW and not same[r]:
            swap = flips[d - 1] if d else np.zeros(m, bool)
            c = _direct_cost(np.where(swap, zc[:, r], zs[:, r]), np.where(swap, zs[:, r], zc[:, r]), deal, folds)
            if np.isfinite(c):
                return c, 1e-6
        return exactly(r, d), 2e-8

    def below(r: int, d: int, c: float, e: float) -> bool:
        """Whether the draw costs no more than the true labelling."""
        for again in (False, True):
            if again or not (np.isfinite(c) and np.isfinite(e)):
                c, e = anew(r, d)
            if again and off[r] > 1e-6:
                seen[r], off[r] = anew(r, 0)
            if abs(c - seen[r]) > e + off[r]:
                return c < seen[r]
        return exactly(r, d) <= exactly(r, 0)

    order, at_most, answers, step = [], np.zeros(jobs, int), [None] * jobs, most + 3
    for r in range(jobs):
        if same[r] or not np.isfinite(seen[r]) or not np.isfinite(off[r]):
            if (~(least[:, r] > _most_cost(zs[:, r], zc[:, r], deal, folds))).sum() <= most:
                order.append([])  # the others cost more, whatever the observed cost is
                continue
            seen[r], off[r] = anew(r, 0)
        open_ = np.flatnonzero(~(least[:, r] > seen[r] + off[r]))
        order.append(list(open_[np.argsort(-np.abs(total[1 + open_, r]), kind="stable")]))
    while True:
        for r in range(jobs):
            if answers[r] is None and (at_most[r] > most or at_most[r] + len(order[r]) <= most):
                answers[r] = bool(at_most[r] <= most)
        pick = [(r, d) for r in range(jobs) if answers[r] is None for d in order[r][:step]]
        if not pick:
            return answers
        of, draws = np.array([p[0] for p in pick]), np.array([p[1] for p in pick])
        part = _fold_sums(deal, folds, lambda at: (1.0 - 2.0 * flips[draws, at].T) * difference[at][:, of])
        with np.errstate(all="ignore"):
            cost, slack = costs(of, part, total[1 + draws, of])
        for r, d, c, e in zip(of, draws, cost, slack, strict=True):
            order[r].remove(d)
            at_most[r] += below(r, d + 1, c, e)
        step = 16


def critical_places(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """Places (from 0) of the lower and upper critical value among ``n`` sorted null draws.

    With ``k`` draws at or below it an observation has ``p = (1 + k) / (1 + n)``. The lower place is the largest ``k`` whose p is
    within ``alpha``, the upper one the smallest whose p is at least ``1 - alpha`` (the last draw, where none is). Refuses so few
    draws that even the least p is beyond ``alpha``.
    """
    p = np.arange(1, n + 2) / (1 + n)
    low = int(np.searchsorted(p, alpha + EPSILON, "right")) - 1
    if low < 0:
        raise ValueError("too few draws for this level")
    return low, min(n - 1, int(np.searchsorted(p, 1 - alpha - EPSILON, "left")))


def null_summary(draws: DataFrame, group: list[str], value: str, n: int, alpha: float = 0.05, extra: list[Column] | None = None) -> DataFrame:
    """Mean, median, deviation, extremes and critical values of each cell's ``n`` null draws, and ``extra`` aggregates."""
    ordered = F.array_sort(F.collect_list(value))  # ``n`` draws a cell
    below, above = critical_places(n, alpha)
    return draws.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.try_element_at(ordered, F.lit(below + 1)).alias("crit_low"), F.try_element_at(ordered, F.lit(above + 1)).alias("crit_high"), *(extra or []),
    )


def effect_columns(observed_value: str, mean: str = "mean", low: str = "crit_low", high: str = "crit_high") -> list[Column]:
    """Least effect that can be detected either way, the observed one, and how much of the lower one that is; null when the null
    has no width."""
    o, m, lo, hi = (F.col(c) for c in (observed_value, mean, low, high))
    return [(m - lo).alias("mde_down"), (hi - m).alias("mde_up"), (m - o).alias("observed_effect"), F.try_divide(m - o, m - lo).alias("shortfall_ratio")]


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high of the Wilson interval, (0, 1) without trials."""
    k, n = (F.col(x).cast("double") if isinstance(x, str) else x for x in (k, n))
    p = F.try_divide(k, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(ok, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def crossing(curve: DataFrame, group: list[str], x: str, power: str, level: float) -> DataFrame:
    """Per group the first ``x`` at which the power reaches the level from below, linearly interpolated; null if never."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group).orderBy(x)
    step = curve.withColumn("_x", F.lag(x).over(w)).withColumn("_p", F.lag(power).over(w))
    up = (F.col("_p") < level) & (F.col(power) >= level)
    at = F.when(up, F.col("_x") + (level - F.col("_p")) / (F.col(power) - F.col("_p")) * (F.col(x) - F.col("_x"))).when(F.col("_p").isNull() & (F.col(power) >= level), F.col(x))
    return step.groupBy(*group).agg(F.min(at.cast("double")).alias("crossing"))


def sign_test(areas: DataFrame, group: list[str], auc: str = "auc") -> DataFrame:
    """``group, above, below, p``: exact two-sided sign test of areas against one half; ties are dropped."""
    n = areas.groupBy(*group).agg(F.count_if(F.col(auc) > 0.5).alias("above"), F.count_if(F.col(auc) < 0.5).alias("below"))
    total, few = F.col("above") + F.col("below"), F.least("above", "below")
    # log binomial terms summed by a fold over 0 .. min
    lgamma = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double")))
    logs = lambda i: lgamma(total) - lgamma(i) - lgamma(total - i) - total * math.log(2)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), few), F.lit(0.0), lambda acc, i: acc + F.exp(logs(i)))
    return n.select(*group, "above", "below", F.when(total > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0).alias("p"))


#: Verbal bands of a likelihood ratio by their lower bound.
BANDS = {1000: "very strong", 100: "strong", 10: "moderate", 2: "weak"}


def verbal(lr: Column | str, censored: Column | None = None) -> Column:
    """Verbal band of a ratio (of its inverse for support of the other side); a censored value, one at the bound, takes the
    lower band."""
    v = F.col(lr) if isinstance(lr, str) else lr
    size = F.when(v >= 1, v).otherwise(F.try_divide(F.lit(1.0), v))
    names = [*BANDS.values(), "no support"]
    steps = F.lit(len(BANDS))
    for i, low in reversed(list(enumerate(BANDS))):
        steps = F.when(size >= low, F.lit(i)).otherwise(steps)
    if censored is not None:
        steps = F.when(censored, F.least(steps + 1, F.lit(len(BANDS)))).otherwise(steps)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (steps + 1).cast("int"))


def shares(total: Column, parts: dict[str, Column]) -> list[Column]:
    """Each part's share of a loss; NaN where the loss is next to nothing."""
    return [F.when(F.abs(total) > 1e-9, part / total).otherwise(F.lit(float("nan"))).alias(name) for name, part in parts.items()]


class FisherEnsemble:
    """Bagged Fisher discriminants on random subspaces; the subspace size is the one with the least out-of-bag error."""

    def __init__(self, learners: int = 21, sizes: tuple[int, ...] = (8, 16, 32), ridge: float = 1e-6, seed: int = 0):
        self.learners, self.sizes, self.ridge, self.seed = learners, sizes, ridge, seed

    def _grow(self, x, y, size, rng):
        made, votes, seen = [], np.zeros(len(y)), np.zeros(len(y))
        for _ in range(self.learners):
            cols = np.sort(rng.choice(x.shape[1], size, replace=False))
            bag = rng.integers(0, len(y), len(y))
            a, b = x[bag][y[bag]][:, cols], x[bag][~y[bag]][:, cols]
            if len(a) < 2 or len(b) < 2:
                continue
            within = np.cov(a.T) + np.cov(b.T)
            within = np.atleast_2d(within)
            w = np.linalg.solve(within + self.ridge * (np.trace(within) / size + 1e-12) * np.eye(size), a.mean(0) - b.mean(0))
            threshold = w @ (a.mean(0) + b.mean(0)) / 2
            made.append((cols, w, threshold))
            out = np.setdiff1d(np.arange(len(y)), bag)
            votes[out] += x[out][:, cols] @ w > threshold
            seen[out] += 1
        known = seen > 0
        error = np.mean((votes[known] / seen[known] > 0.5) != y[known]) if known.any() else 1.0
        return made, error

    def fit(self, x: np.ndarray, y: np.ndarray) -> FisherEnsemble:
        x, y = np.asarray(x, float), np.asarray(y, bool)
        rng = np.random.default_rng(self.seed)
        grown = [self._grow(x, y, min(s, x.shape[1]), rng) for s in self.sizes]
        self.members, self.oob_error = min(grown, key=lambda g: g[1])
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Share of the learners that vote positive."""
        x = np.asarray(x, float)
        return np.mean([x[:, cols] @ w > t for cols, w, t in self.members], axis=0)
