"""Orphan references against brute force."""

import datetime as dt
import random

from tallyglass.operators import orphans as o

REFS, PARENTS, GONE = "ref_table string, row_key long, name string, at timestamp, junk string", "kind string, name string, since timestamp, _maybe int", "name string, gone timestamp, reason string"
KINDS = {"manifest": "clean", "panel": "any"}


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents, gone):
    out = set()
    for table, key, name, at, _ in refs:
        if name is None or at is None:
            continue
        since = [s for k, n, s, _ in parents if k == KINDS[table] and n == name and s is not None]
        removed = [g for n, g, _ in gone if n == name and g is not None and g <= at]
        alive = any(s <= at for s in since)
        if not alive or removed:
            out.add((table, key, "missing" if not since else "deleted" if removed else "late"))
    return out


def check(spark, refs, parents, gone):
    got = [(r.ref_table, r.row_key, r.reason) for r in o.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(gone, GONE), KINDS).collect()]
    assert len(got) == len(set(got))
    want = brute(refs, parents, gone)
    assert {g[:2] for g in got} == {w[:2] for w in want}
    for g in got:
        assert g[2] in ("missing", "late", "deleted")


def test_random(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)] + [None, ""]
    refs = [(rng.choice(["manifest", "panel"]), i, rng.choice(names), rng.choice([day(rng.randrange(30)), None]), "j") for i in range(600)]
    parents = [(rng.choice(["clean", "any"]), rng.choice(names), rng.choice([day(rng.randrange(30)), None]), 1) for _ in range(60)]
    gone = [(rng.choice(names), rng.choice([day(rng.randrange(30)), None]), "r") for _ in range(20)]
    check(spark, refs, parents, gone)


def test_hot_name(spark):
    refs = [("manifest", i, "hot" if i % 2 else f"n{i}", day(i % 30), None) for i in range(4000)]
    parents = [("clean", "hot", day(10), 0), ("any", "hot", day(0), 0), ("clean", "n2", day(1), 0)] * 3
    check(spark, refs, parents, [("hot", day(20), None)])


def test_empty(spark):
    check(spark, [], [], [])
    check(spark, [("panel", 1, "a", day(1), None)], [], [])
    check(spark, [], [("any", "a", day(1), 0)], [("a", day(1), "")])


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    inside, outside = spark.range(5000).selectExpr("cast(id as string) k"), spark.range(5000, 25000).selectExpr("cast(id as string) k")
    blocks = o.filter_blocks_for(5000)
    sieve = o.bloom_blocks(inside, "k", blocks)

    def hits(df):
        return df.withColumn("_block", o._block(F.col("k"), blocks)).join(sieve, "_block", "left").filter(o.might_contain(F.col("k"), F.col("_bitmap"))).count()

    assert hits(inside) == 5000
    assert hits(outside) < 20000 * 0.02
    assert o.filter_blocks_for(0) == 1
    assert o.filter_blocks_for(10**12) * o.BLOCK_BITS >= 10**12 * o.BITS_PER_KEY  # as selective, however many keys


def test_filter_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(o, "MOST_BLOCKS", 0)
    test_random(spark)
    test_hot_name(spark)
    test_empty(spark)


def test_counts_per_period(spark):
    found = o.orphans(spark.createDataFrame([("panel", 1, "a", day(1), ""), ("panel", 2, "a", day(40), "")], REFS), spark.createDataFrame([], PARENTS), spark.createDataFrame([], GONE), KINDS)
    assert sorted(tuple(r)[2:] for r in o.per_table_and_period(found).collect()) == [("missing", 1), ("missing", 1)]
