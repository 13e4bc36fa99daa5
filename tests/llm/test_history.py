"""Duplicates of new batches against brute force."""

import random

import pytest
from tallyglass.llm import history
from tallyglass.shared import new_folder

ROWS = "row_id long, batch int, digest string, d long, p long, content string, bucket int"


def flip(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x - (1 << 64) if x >= 1 << 63 else x


def make(rng, n):
    prints, rows = {}, []
    for i in range(n):
        if rows and rng.random() < 0.4:
            old = rng.choice(rows)
            if rng.random() < 0.4 or old[3] is None:
                digest, d, p = old[2], old[3], old[4]
            else:
                digest, d, p = f"d{i}", flip(rng, old[3] % (1 << 64), rng.randrange(9)), flip(rng, old[4] % (1 << 64), rng.randrange(9))
        else:
            digest, d, p = f"d{i}", rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)
            if rng.random() < 0.1:
                d = p = None
        d, p = prints.setdefault(digest, (d, p))
        rows.append((i, rng.choice([0, 0, 1, 2]), digest if rng.random() > 0.02 or d is not None else None, d, p, "c", 1))
    return rows


def brute(rows):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if max(a[1], b[1]) == 0:
                continue
            same = a[2] is not None and a[2] == b[2]
            near = None not in (a[3], b[3], a[4], b[4]) and ((a[3] ^ b[3]) % (1 << 64)).bit_count() <= 6 and ((a[4] ^ b[4]) % (1 << 64)).bit_count() <= 6
            if same or near:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def run(spark, rows):
    """The old rows at once, then the others as one batch."""
    df = spark.createDataFrame(rows, ROWS)
    index = history.HistoryIndex(spark, new_folder(spark, "h"), 4)
    index.append("old", df.filter("batch = 0"))
    got = [tuple(r) for r in index.check("new", df.filter("batch > 0")).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random(spark):
    rows = make(random.Random(1), 400)
    assert run(spark, rows) == brute(rows)


def test_flat_images_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(history, "CHUNK", 40)
    monkeypatch.setattr(history, "ROW_CHUNK", 7)
    monkeypatch.setattr(history, "BLOCK", 50)
    rng = random.Random(2)
    rows = [(i, i % 3, f"f{i}", 0, flip(rng, 0, rng.randrange(20)), "", 0) for i in range(200)] + [(1000 + i, i % 2, "hot", 5, 7, "", 0) for i in range(60)] + [(2000 + i, 1, "bare", None, None, "", 0) for i in range(30)]
    seen = {}
    rows = [(r[0], r[1], seen.setdefault((r[3], r[4]), r[2]) if r[3] is not None else r[2], *r[3:]) for r in rows]
    assert run(spark, rows) == brute(rows)


def test_batches_one_after_another(spark):
    rows = make(random.Random(3), 300)
    df = spark.createDataFrame(rows, ROWS)
    folder = new_folder(spark, "h")
    got = [tuple(r) for r in history.arrivals(history.HistoryIndex(spark, folder, 4), df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert history.arrivals(history.HistoryIndex(spark, folder), df) is None  # all is accepted: a run again adds nothing


def test_reopened_with_other_settings(spark):
    rows = make(random.Random(5), 300)
    df = spark.createDataFrame(rows, ROWS)
    folder = new_folder(spark, "h")
    history.HistoryIndex(spark, folder, 16).append("old", df.filter("batch = 0"))
    for buckets in (None,):
        again = history.HistoryIndex(spark, folder, buckets)
        assert again.buckets == 16 and again.accepted() == ["old"]
        assert {tuple(r) for r in again.check("new", df.filter("batch > 0")).collect()} == brute(rows)


def test_repeated_attempts_count_once(spark):
    rows = make(random.Random(6), 200)
    df = spark.createDataFrame(rows, ROWS)
    folder = new_folder(spark, "h")
    first = history.HistoryIndex(spark, folder, 4)
    first.append("old", df.filter("batch = 0"))
    first.put("new", df.filter("batch > 0"))  # lost before it was accepted
    second = history.HistoryIndex(spark, folder)
    second.append("old", df.filter("batch = 0"))  # accepted before: nothing happens
    got = [tuple(r) for r in second.check("new", df.filter("batch > 0")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    second.accept("new")
    with pytest.raises(ValueError):
        history.HistoryIndex(spark, folder).stage("new")
    assert second.read("contents").count() == sum(r[2] is not None or r[3] is not None for r in rows)


def test_history_is_not_shuffled(spark):
    df = spark.createDataFrame(make(random.Random(7), 100), ROWS)
    index = history.HistoryIndex(spark, new_folder(spark, "h"), 4)
    index.append("old", df.filter("batch = 0"))
    index.put("new", df.filter("batch > 0"))
    plan = index.near("new")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan


def test_edges(spark):
    assert run(spark, []) == set()
    assert history.arrivals(history.HistoryIndex(spark, new_folder(spark, "h"), 4), spark.createDataFrame([], ROWS)) is None
    assert run(spark, [(1, 1, None, None, None, "", 0), (2, 1, None, None, None, "", 0)]) == set()
    assert run(spark, [(1, 1, "x" * 100_000, None, None, "", 0), (2, 0, "x" * 100_000, None, None, "", 0), (3, 0, "x" * 100_000, None, None, "", 0)]) == {(1, 2), (1, 3)}


def test_bands_guarantee():
    rng = random.Random(4)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = flip(rng, a, history.RADIUS) % (1 << 64)
        assert any((a >> s) & ((1 << w) - 1) == (b >> s) & ((1 << w) - 1) for s, w in zip(history.SHIFTS, history.WIDTHS, strict=True))
    assert sum(history.WIDTHS) == 64
