"""Train, validation and test sides for whole families, by min-cost flow over bundles of like families."""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.names import plain_name, plain_side
from tallyglass.llm.families import name_families
from tallyglass.llm.sample import hash63
from tallyglass.shared import HEAVY_KEYS, cut, join_facts, rank_by_hash

#: Sizes up to this are bundled exactly; larger families by size class, see ``bundle_columns``.
EXACT_SIZE = 64
#: Size classes per doubling beyond ``EXACT_SIZE``, and levels of a family's label share.
CLASSES = 8
LEVELS = 4
#: Weight of a side's deviation from its rows against a bundle's deviation from its own quota.
SIDE_WEIGHT = 4


def family_rows(manifest: DataFrame) -> DataFrame:
    """``name, row_id, side, salt, label, owner`` of each row that belongs to a family.

    A clean row (null ``arm`` and ``source_png``) belongs to its plain ``file`` and carries its uploader as owner, a stego
    row to its plain ``source_png``; stego rows without one are left out.
    """
    clean = F.col("arm").isNull() & F.col("source_png").isNull()
    return manifest.select(
        F.when(clean, plain_name("file")).otherwise(plain_name("source_png")).alias("name"), "row_id", plain_side("split").alias("side"),
        "split_salt", F.when(clean, F.lit(0)).otherwise(F.lit(1)).alias("label"), F.when(clean, F.col("uploader")).alias("owner"),
    ).filter("name is not null")


def families(manifest: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(name, family)``, one row per family (``family, n, n_label, smallest, low_side, high_side, salt``) and the heavy names.

    Rows are first reduced to one per name with map-side partials, so a cover that holds a third of the rows shuffles once
    per task. ``low_side`` and ``high_side`` are the least and greatest side shown (null if none); ``salt`` the least
    ``split_salt`` shown.
    """
    rows = family_rows(manifest)
    facts = rows.groupBy("name").agg(
        F.count("*").alias("n"), F.sum("label").alias("n_label"), F.min("row_id").alias("smallest"),
        F.min("side").alias("low_side"), F.max("side").alias("high_side"), F.min("split_salt").alias("salt"),
        F.min("owner").alias("owner"), F.max("owner").alias("other"),
    )
    facts = cut(facts, "names")
    whole = facts.agg(F.sum("n")).first()[0] or 0
    hot = [r.name for r in facts.filter(F.col("n") * HEAVY_KEYS > whole).select("name").collect()]  # fewer than HEAVY_KEYS
    # names with several owners need all of their pairs; the others are known from their two extremes
    several = facts.filter("owner <> other").select("name")
    extra = join_facts(rows.filter("owner is not null").select("name", "owner").distinct(), several, "name", "inner", hot)
    named = name_families(facts.select("name", "owner").unionByName(extra))
    joined = facts.drop("owner", "other").join(named, "name")
    total = joined.groupBy("family").agg(
        F.sum("n").alias("n"), F.sum("n_label").alias("n_label"), F.min("smallest").alias("smallest"),
        F.min("low_side").alias("low_side"), F.max("high_side").alias("high_side"), F.min("salt").alias("salt"),
    )
    return named, total, hot


def torn(manifest: DataFrame) -> DataFrame:
    """Families whose rows show two or more sides, as ``family_row_id`` (their smallest row)."""
    return families(manifest)[1].filter("low_side <> high_side").select(F.col("smallest").alias("family_row_id"))


def bundle_columns(total: DataFrame) -> DataFrame:
    """Adds ``size_class`` and ``level``: the bundle of a family by size and label profile.

    Up to ``EXACT_SIZE`` rows a bundle holds families of one size and one count of labelled rows; larger ones share a size
    class of ``2 ** (1 / CLASSES)`` and a level of the label share. So there are at most about ``EXACT_SIZE ** 2 / 2 +
    64 * CLASSES * (LEVELS + 1)`` bundles whatever the data: the table that goes to the driver has a proven bound.
    """
    small = F.col("n") <= EXACT_SIZE
    size = F.when(small, F.col("n")).otherwise(EXACT_SIZE + F.floor(F.log2(F.col("n") / EXACT_SIZE) * CLASSES).cast("long") + 1)
    level = F.when(small, F.col("n_label")).otherwise(F.round(F.col("n_label") / F.col("n") * LEVELS).cast("long"))
    return total.withColumn("size_class", size).withColumn("level", level)


def min_cost_flow(supply: dict, arcs: list[tuple], sink: str) -> dict:
    """Integral min-cost flow by successive shortest paths.

    ``arcs``: ``(from, to, capacity, cost)``; parallel arcs model convex costs. Every unit of ``supply`` is sent to ``sink``.
    Returns the flow per ``(from, to)``.
    """
    graph: dict = defaultdict(list)
    cap, cost, ends = [], [], []

    def add(u, v, c, w):
        for a, b, c_, w_ in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(cap))
            cap.append(c_)
            cost.append(w_)
            ends.append((a, b))

    for node, units in supply.items():
        add("*", node, units, 0.0)
    first = len(cap)
    for u, v, c, w in arcs:
        add(u, v, c, w)
    left = sum(supply.values())
    order = itertools.count()
    potential = _bellman_ford("*", graph, cap, cost, ends)
    while left:
        dist, back, heap = {"*": 0.0}, {}, [(0.0, next(order), "*")]
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u] + 1e-9:
                continue
            for e in graph[u]:
                v = ends[e][1]
                if cap[e] and v in potential and u in potential:
                    step = d + max(0.0, cost[e] + potential[u] - potential[v])
                    if step < dist.get(v, float("inf")) - 1e-12:
                        dist[v], back[v] = step, e
                        heapq.heappush(heap, (step, next(order), v))
        if sink not in dist:
            raise ValueError("the supply does not fit the arcs")
        for v, d in dist.items():
            potential[v] += d
        units, v = left, sink
        while v != "*":
            units, v = min(units, cap[back[v]]), ends[back[v]][0]
        v = sink
        while v != "*":
            cap[back[v]] -= units
            cap[back[v] ^ 1] += units
            v = ends[back[v]][0]
        left -= units
    flow: dict = defaultdict(int)
    for e in range(first, len(cap), 2):
        flow[ends[e]] += cap[e ^ 1]
    return flow


def _bellman_ford(source, graph, cap, cost, ends) -> dict:
    dist, todo = {source: 0.0}, [source]
    while todo:
        after = []
        for u in todo:
            for e in graph[u]:
                v = ends[e][1]
                if cap[e] and dist[u] + cost[e] < dist.get(v, float("inf")) - 1e-12:
                    dist[v] = dist[u] + cost[e]
                    after.append(v)
        todo = list(dict.fromkeys(after))
    return dist


def first_flow(bundles: list[dict], shares: dict[str, float]) -> dict[tuple, dict[str, int]]:
    """A feasible integral flow to start from: families of each bundle per side, keyed by ``(size_class, level)``.

    From the largest families down, a bundle first gives each side
    the whole part of its share of what the sides still need, so that what large families cost a side is made good by
    all smaller ones alike; the families left over (fewer than there are sides) are placed by one min-cost flow per size
    class: an arc costs what it strays from the bundle's own quota, and each further family on a side costs what it adds
    to the deviation of the side's rows from its target.
    """
    total = sum(shares.values())
    share = {s: v / total for s, v in shares.items()}
    have = dict.fromkeys(share, 0.0)
    out: dict[tuple, dict[str, int]] = {}
    by_size: dict = defaultdict(list)
    for b in bundles:
        by_size[b["size_class"]].append(b)
    all_rows = sum(b["rows"] for b in bundles)
    for size in sorted(by_size, reverse=True):
        group = by_size[size]
        mean = sum(b["rows"] for b in group) / sum(b["families"] for b in group)
        supply, arcs = {}, []
        need = {s: max(0.0, all_rows * p - have[s]) for s, p in share.items()}
        weight = {s: n / sum(need.values()) for s, n in need.items()}
        group_rows = sum(b["rows"] for b in group)
        goal = {s: have[s] + group_rows * weight[s] for s in share}
        for b in group:
            key = (size, b["level"])
            exact = {s: b["families"] * w for s, w in weight.items()}
            out[key] = {s: int(x + 1e-9) for s, x in exact.items()}
            rest = b["families"] - sum(out[key].values())
            for s in share:
                have[s] += out[key][s] * b["rows"] / b["families"]
            if rest:
                supply[key] = rest
                for s in share:
                    part = exact[s] - out[key][s]
                    for unit in range(rest):  # squared deviation from the bundle's own quota, per further family
                        arcs.append((key, s, 1, (unit + 1 - part) ** 2 - (unit - part) ** 2))
        units = sum(supply.values())
        if units:
            due = {s: (goal[s] - have[s]) / mean for s in share}
            for s in share:
                for unit in range(units):  # squared deviation of the side's rows, weighted above single bundles
                    arcs.append((s, "sink", 1, 4 * ((unit + 1 - due[s]) ** 2 - (unit - due[s]) ** 2)))
            flow = min_cost_flow(supply, arcs, "sink")
            for b in group:
                key = (size, b["level"])
                for s in share:
                    moved = flow.get((key, s), 0)
                    out[key][s] += moved
                    have[s] += moved * b["rows"] / b["families"]
    return out


def deviation(bundles: list[dict], shares: dict[str, float], quotas: dict[tuple, dict[str, int]]) -> float:
    """The cost that ``solve_quotas`` lowers: the squared rows that sides are off, weighted ``SIDE_WEIGHT``, and the squared
    families that bundles are off."""
    size, x, q, off = _state(bundles, shares, quotas)
    return float(SIDE_WEIGHT * (off**2).sum() + ((x - q) ** 2).sum())


def _state(bundles, shares, quotas):
    share = np.array(list(shares.values())) / sum(shares.values())
    count = np.array([b["families"] for b in bundles], float)
    size = np.array([b["rows"] for b in bundles], float) / count
    x = np.array([[quotas[b["size_class"], b["level"]][s] for s in shares] for b in bundles], float)
    return size, x, count[:, None] * share, size @ x - (size * count).sum() * share


def solve_quotas(bundles: list[dict], shares: dict[str, float]) -> dict[tuple, dict[str, int]]:
    """Families of each bundle per side, keyed by ``(size_class, level)``: an integral flow of low cost in one network.

    ``bundles`` have ``size_class, level, families, rows``. The network holds all bundles: an arc from each to every side costs
    the squared families that the bundle strays from its own quota, an arc from a side to the sink the squared rows that the
    side strays from its share of all rows. From ``first_flow`` on, negative cycles of the residual network are cancelled: a family
    moves from one side to another, alone or against a family of any other bundle that moves back. It ends where no
    such cycle lowers the cost; the cost falls with every one, so it always ends. Of bundles of one size only the cheapest arc
    matters, so a round looks at pairs of sizes.
    """
    quotas = first_flow(bundles, shares)
    if not bundles:
        return quotas
    size, x, q, off = _state(bundles, shares, quotas)
    allowed = np.array(list(shares.values())) > 0
    sizes, of = np.unique(size, return_inverse=True)
    step = sizes[:, None] - sizes[None, :]
    pairs = [(s, t) for s in range(len(shares)) for t in range(len(shares)) if s != t and allowed[t]]
    while True:
        best, move = -1e-6, None
        arcs = {}
        for s, t in pairs:
            own = np.where(x[:, s] > 0, 2 * (x[:, t] - q[:, t] - x[:, s] + q[:, s] + 1), np.inf)
            order = np.lexsort((own, of))
            arcs[s, t] = order[np.searchsorted(of[order], np.arange(len(sizes)))], own
        for s, t in pairs:
            at, own = arcs[s, t]
            gap = off[t] - off[s]
            alone = own[at] + SIDE_WEIGHT * 2 * sizes * (gap + sizes)
            k = int(alone.argmin())
            if alone[k] < best:
                best, move = alone[k], [(at[k], s, t)]
            if (t, s) in arcs and s < t:
                back, own_back = arcs[t, s]
                both = own[at][:, None] + own_back[back][None, :] + SIDE_WEIGHT * 2 * step * (gap + step)
                both[at[:, None] == back[None, :]] = np.inf
                k = int(both.argmin())
                if both.flat[k] < best:
                    i, j = divmod(k, len(sizes))
                    best, move = both.flat[k], [(at[i], s, t), (back[j], t, s)]
        if move is None:
            break
        for b, s, t in move:
            x[b, s], x[b, t] = x[b, s] - 1, x[b, t] + 1
            off[s], off[t] = off[s] - size[b], off[t] + size[b]
    return {(b["size_class"], b["level"]): dict(zip(shares, map(int, row), strict=True)) for b, row in zip(bundles, x, strict=True)}


def assign(manifest: DataFrame, shares: dict[str, float], salt: str = "strand") -> DataFrame:
    """``row_id, family, side`` for every row that belongs to a family: no family is on two sides, shares are met in rows.

    Families are bundled by size and label profile (clean or stego), the bundles' quotas are solved on the driver (a
    bounded table, see ``bundle_columns``), and a bundle's families are dealt by their rank under a salted hash: exact
    counts, the same on every run and partitioning. The salt is the family's own ``split_salt`` or else ``salt``. An empty
    table gives no rows; a share of 0 gets no family unless rounding leaves no other side.
    """
    spark = manifest.sparkSession
    named, total, hot = families(manifest)
    named, sized = cut(named, "named"), cut(bundle_columns(total), "families")
    bundles = [r.asDict() for r in sized.groupBy("size_class", "level").agg(F.count("*").alias("families"), F.sum("n").alias("rows")).collect()]
    quotas = solve_quotas(bundles, shares) if bundles else {}
    cuts = []
    for (size, level), per_side in quotas.items():
        at = 0
        for side, count in per_side.items():
            if count:
                cuts.append((size, level, at, at + count, side))
            at += count
    table = F.broadcast(spark.createDataFrame(cuts, "size_class long, level long, low long, high long, new_side string"))
    hashed = sized.withColumn("_h", hash63(F.coalesce("salt", F.lit(salt)), "family") * 8)
    ranked = rank_by_hash(hashed, ["size_class", "level"], "_h", ["family"])
    dealt = ranked.join(table, ["size_class", "level"]).filter("rank >= low and rank < high").select("family", F.col("new_side").alias("side"))
    sides = join_facts(named, dealt, "family", "inner")
    return join_facts(family_rows(manifest).select("name", "row_id"), sides, "name", "inner", hot).select("row_id", "family", "side")


#: Sides and their shares, as TESTDATA.md states them.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
