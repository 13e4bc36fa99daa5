"""The deduplication store: exact and near matches of image prints, decided in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import band, hamming

BANDS = 8


def bands(prints: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """``kind, idx, band, key``: the eight bytes of every print; two prints within 7 bits share one."""
    each = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("idx"), band(col, i).alias("band")) for kind, col in kinds.items() for i in range(BANDS)]
    return prints.select(F.explode(F.array(*each)).alias("b"), F.col(key).alias("key")).select("b.*", "key").filter("band is not null")


def near_pairs(prints: DataFrame, key: str, column: str, radius: int) -> DataFrame:
    """``left, right, distance`` (left < right) of prints within ``radius`` (at most 7) differing bits.

    Equal prints are one node first, so copies don't multiply the candidates; candidates share a pair of neighbouring
    bands: with 8 bands and ``radius`` errors at least ``8 - radius`` bands agree, and with two or more agreeing the join is
    on two bands at once. Every pair is reported from its lowest agreeing bands only.
    """
    if not 0 <= radius <= BANDS - 1:
        raise ValueError("the radius must be from 0 to 7")
    nodes = prints.filter(F.col(column).isNotNull()).select(F.col(column).alias("print")).distinct()
    twice = BANDS - radius >= 2
    combos = [(i, j) for i in range(BANDS) for j in range(i + 1, BANDS)] if twice else [(i, i) for i in range(BANDS)]
    # only the first ``radius + 2`` bands are needed: at least two (one) of them agree
    used = radius + 2 if twice else BANDS
    combos = [(i, j) for i, j in combos if j < used]
    code = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (band("print", i) * 256 + band("print", j)).alias("v")) for n, (i, j) in enumerate(combos)]))
    keyed = nodes.select("print", code.alias("c")).select("print", "c.n", "c.v")
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.print").bitwiseXOR(F.col("b.print"))
    agree = [band(x, i) == 0 for i in range(used)]
    first = None
    for n, (i, j) in enumerate(combos):
        both = agree[i] & agree[j]
        first = F.when(both, n) if first is None else first.when(both, n)
    met = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.print") < F.col("b.print")))
    close = met.filter((F.bit_count(x) <= radius) & (first == F.col("a.n"))).select(F.col("a.print").alias("p"), F.col("b.print").alias("q"))
    same = prints.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("print")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("print").alias("p"), F.col("print").alias("q"))
    rows = prints.select(F.col(key).alias("k"), F.col(column).alias("print"))
    out = (
        close.unionByName(same).join(rows.select(F.col("k").alias("x"), F.col("print").alias("p")), "p").join(rows.select(F.col("k").alias("y"), F.col("print").alias("q")), "q")
        .filter((F.col("p") != F.col("q")) | (F.col("x") < F.col("y")))
    )
    return out.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), hamming("p", "q").alias("distance"))


def exact_first(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Adds nothing but decides: per digest the first row is kept; ``digest, kept, n``."""
    return rows.groupBy(F.col(digest).alias("digest")).agg(F.min(order).alias("kept"), F.count("*").alias("n"))


def keep_first(rows: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """``order, accepted, matched, distance``: rows in order; one is rejected if an earlier *accepted* row is linked to it.

    ``links`` are ``left, right, distance`` in terms of ``order`` (left < right). Rejection depends on earlier decisions, but
    only along links: rows without an earlier link are accepted at once. The others are decided in rounds: a row whose
    earlier neighbours are all decided is settled by one join and aggregation per round, so no chain enters one task. The
    nearest accepted neighbour is reported, the earliest of equals.
    """
    from tallyglass.shared import cut

    todo = cut(links.select("left", "right", "distance"), "links")
    decided = cut(rows.select(order).join(todo.select(F.col("right").alias(order)).distinct(), order, "left_anti").select(
        order, F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("matched"), F.lit(None).cast("int").alias("distance")), "decided")
    state = decided
    while not todo.isEmpty():
        known = todo.join(state.select(F.col(order).alias("left"), "accepted"), "left", "left")
        each = known.groupBy("right").agg(
            F.count_if(F.col("accepted").isNull()).alias("open"), F.min(F.when(F.col("accepted"), F.struct("distance", "left"))).alias("best")
        )
        new = cut(each.filter("open = 0").select(
            F.col("right").alias(order), F.col("best").isNull().alias("accepted"), F.col("best.left").cast("long").alias("matched"), F.col("best.distance").cast("int").alias("distance")), "decided")
        todo = cut(todo.join(new.select(F.col(order).alias("right")), "right", "left_anti"), "links")
        state = cut(state.unionByName(new), "state")
    return state


def store_stats(decisions: DataFrame) -> DataFrame:
    """Accepted and rejected rows."""
    return decisions.groupBy("accepted").agg(F.count("*").alias("n"))


def dhash(rows: pd.Series) -> pd.Series:
    """64-bit difference print of 9 x 8 grey values given row by row: bit set where a value exceeds its left neighbour's."""
    import numpy as np

    grid = np.stack(rows.to_numpy()).reshape(len(rows), 8, 9)
    bits = (grid[:, :, 1:] > grid[:, :, :-1]).reshape(len(rows), 64)
    return pd.Series(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64))


def phash(rows: pd.Series) -> pd.Series:
    """64-bit print of 32 x 32 grey values: signs of the low 8 x 8 cosine coefficients against their median, the mean's bit set."""
    import numpy as np

    n = np.arange(32)
    base = np.cos(np.pi * (2 * n[None, :] + 1) * n[:8, None] / 64)
    grid = np.stack(rows.to_numpy()).reshape(len(rows), 32, 32).astype(float)
    low = np.einsum("ui,bij,vj->buv", base, grid, base).reshape(len(rows), 64)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    bits[:, 0] = True
    return pd.Series(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64))
