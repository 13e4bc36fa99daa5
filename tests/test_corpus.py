"""Assignment, pairing, compaction, store, integrity, text and media functions."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import media
from tallyglass.functions import text as X
from tallyglass.functions.names import plain_digest, plain_name, plain_side
from tallyglass.operators import assign, compaction, integrity, pairing, prints, release, report, runs


def test_names(spark):
    df = spark.createDataFrame([(" a/B\\C.PNG \n",), ("x",), ("",), (None,), ("a/",)], "v string")
    assert [r[0] for r in df.select(plain_name("v")).collect()] == ["c.png", "x", "", None, ""]
    d = spark.createDataFrame([(" SHA256:AB ",), ("ab",), (None,), ("sha256:",)], "v string")
    assert [r[0] for r in d.select(plain_digest("v")).collect()] == ["ab", "ab", None, ""]
    assert d.select(plain_side(F.lit(" TrAin\t"))).first()[0] == "train"


def test_caps_and_quota_in_order(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None])) for i in range(300)]
    df = spark.createDataFrame(data, "o int, u string, c string").repartition(5)
    held, want = {"u": {}, "c": {}}, {}
    for o, u, c in data:
        if u is not None and held["u"].get(u, 0) >= 10:
            want[o] = "u"
        elif c is not None and held["c"].get(c, 0) >= 30:
            want[o] = "c"
        else:
            want[o] = None
            held["u"][u] = held["u"].get(u, 0) + 1
            held["c"][c] = held["c"].get(c, 0) + 1
    got = {r.o: r.refusal for r in assign.sequential(df, "o", assign.two_way_caps({"u": 10, "c": 30}), ["u", "c"]).collect()}
    assert got == want
    quota = [r.accepted for r in assign.sequential(df, "o", assign.share_quota(0.4, 20), ["u"]).orderBy("o").collect()]
    assert all(quota[:20]) and not all(quota)
    assert assign.sequential(df.limit(0), "o", assign.share_quota(0.4, 20), ["u"]).count() == 0


def test_orders_and_tiers(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i // 2) for i in range(30)], "k int, o long")
    full = {r.k: r.o for r in assign.extend_order(df, "o", "k", "s").collect()}
    last = max(o for _, o in [(r.k, r.o) for r in df.collect()] if o is not None)
    assert all(full[r.k] == r.o for r in df.collect() if r.o is not None)
    assert sorted(full[k] for k in range(0, 30, 3)) == list(range(last + 1, last + 11))
    dense = assign.density(spark.createDataFrame([(0,), (1,), (1,), (4,), (None,)], "o long"), "o").first()
    assert (dense.n, dense.n_null, dense.n_distinct, dense.n_repeated, dense.n_missing) == (5, 1, 3, 1, 2)
    assert assign.density(spark.createDataFrame([], "o long"), "o").first().n == 0
    assert [r.position for r in assign.dense_position(spark.createDataFrame([(x,) for x in "dacb"], "v string"), "v").orderBy("v").collect()] == [0, 1, 2, 3]
    small = assign.tier_prefix(df, "o", 3)
    assert {r.k for r in small.collect()} <= {r.k for r in assign.tier_prefix(df, "o", 9).collect()}


def test_split_is_stable(spark):
    df = spark.range(3000).selectExpr("cast(id as string) k")
    one = {r.k: r.s for r in df.select("k", assign.stable_split("a", "k", 0.2).alias("s")).collect()}
    assert 0.15 < sum(v == "test" for v in one.values()) / 3000 < 0.25
    assert int(hashlib.sha256(b"a:7").hexdigest()[:15], 16) < 0.2 * 2**60 or one["7"] == "train"
    folds = df.select(assign.hash_fold("k", 5).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 5


def test_spread_takes_every_group_once_first(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 60), ("c", 61), ("c", 62)], "g string, o int")
    assert {r.g for r in assign.spread(df, "g", "o", 3).collect()} == {"a", "b", "c"}
    assert assign.spread(df, "g", "o", 10).filter("g = 'c'").count() == 2


def test_log_compaction(spark):
    log = spark.createDataFrame([(1, "a", 1.0, None), (2, "a", 1.0, 2.0), (3, "a", 3.0, 4.0), (4, None, 1.0, 1.0), (5, "b", None, None)], "p int, f string, x double, y double")
    got = {r.key: r.p for r in compaction.most_complete(log, F.col("f"), ["x", "y"], "p").collect()}
    assert got == {"a": 2, "b": 5}
    assert {r.key: r.p for r in compaction.last_record(log, F.col("f"), ["p"]).collect()} == {"a": 3, "b": 5}
    assert compaction.most_complete(log.limit(0), F.col("f"), ["x", "y"], "p").count() == 0
    m = compaction.merge_shards([log.select("p", "f"), log.filter("p < 3").select("p", F.lit("z").alias("f"))], "p")
    assert {r.p for r in m.filter("conflict").collect()} == {1, 2}
    assert [tuple(r) for r in compaction.divergence(spark.createDataFrame([(0, "a"), (1, "b")], "p int, i string"), spark.createDataFrame([(0, "a"), (1, "c")], "p int, i string"), "p", "i").collect()] == [(1, "b", "c")]


def test_pairing(spark):
    listed = spark.createDataFrame(
        [("c1", 1, False, None, "c1", "d1", None, "train", 10, 10), ("s1", 2, True, "a", "c1", "e1", "d1", "test", 10, 10), ("s2", 3, True, "a", "c1", "e2", "zz", None, 10, 10), ("s3", 4, True, "b", "c9", "e3", None, "test", 9, 9),
         ("s4", 5, True, "b", "c1", "e4", None, "train", 7, 10)],
        "name string, row_id int, stego boolean, arm string, cover string, digest string, clean_digest string, side string, width int, height int",
    )
    pairs = pairing.with_cover(listed)
    assert {r.name for r in pairing.leaks(pairs).collect()} == {"s1"}
    assert {r.name: r.selected_side for r in pairing.inherited_side(pairs).collect()} == {"s1": "train", "s2": "train", "s3": "test", "s4": "train"}
    halves = listed.filter("not stego").select("digest", F.col("width").alias("half_width"), F.col("height").alias("half_height"))
    got = {r.arm: (r.pairing, r.compared, r.missing) for r in pairing.pairing_verdict(pairing.pair_check(pairs, halves), ["arm"]).collect()}
    assert got == {"a": ("single-variable", 1, 1), "b": ("confounded", 1, 1)}
    uniform = listed.groupBy("stego").agg(pairing.uniform("arm").alias("a"), pairing.uniform("clean_digest").alias("d")).orderBy("stego").collect()
    assert [(r.a, r.d) for r in uniform] == [("unstated", "unstated"), ("mixed", "mixed")]


def test_keep_first_against_greedy(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(160):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(7)):
            x ^= 1 << b
        rows.append((i, x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame([*rows, (999, None)], "k long, h long")
    for radius in (3, 6, 7):
        pairs = {(r.left, r.right): r.distance for r in prints.near_pairs(df, "k", "h", radius).collect()}
        want = {(a, b): ((x ^ y) % (1 << 64)).bit_count() for a, x in rows for b, y in rows if a < b and ((x ^ y) % (1 << 64)).bit_count() <= radius}
        assert pairs == want
    links = spark.createDataFrame([(a, b, d) for (a, b), d in want.items()], "left long, right long, distance int")
    accepted, decided = set(), {}
    for k, _ in rows:
        near = sorted((want[a, k], a) for a in accepted if (a, k) in want)
        decided[k] = (not near, near[0][1] if near else None)
        if not near:
            accepted.add(k)
    got = {r.k: (r.accepted, r.matched) for r in prints.keep_first(df.filter("k < 999").select("k"), links, "k").collect()}
    assert got == decided


def test_prints_of_pixels():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    grid = rng.random(72)
    (h,) = prints.dhash(pd.Series([grid]))
    bits = [int(grid[r * 9 + c + 1] > grid[r * 9 + c]) for r in range(8) for c in range(8)]
    assert h % (1 << 64) == int("".join(map(str, bits)), 2)
    (p,) = prints.phash(pd.Series([rng.random(1024)]))
    assert 24 <= (p % (1 << 64)).bit_count() <= 40 and p < 0


def test_integrity(spark):
    rows = [(f"n{i:03d}", f"d{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "i string, d string")
    got = integrity.corpus_digest(df, "i", "d", 64).first()
    blocks = [hashlib.sha256("".join(f"{i}\0{d}\n" for i, d in rows[k : k + 64]).encode()).hexdigest() for k in range(0, 300, 64)]
    assert (got.n, got.digest) == (300, hashlib.sha256("".join(blocks).encode()).hexdigest())
    assert integrity.corpus_digest(df.repartition(9), "i", "d", 64).first() == got
    assert integrity.corpus_digest(df.limit(0), "i", "d").first().digest is None
    assert integrity.corpus_digest(df.withColumn("d", F.when(F.col("i") != "n001", F.col("d"))), "i", "d").first().digest is None
    assert integrity.seal('{"b": 1, "a": [1.5], "started_utc": "x"}') == integrity.seal('{"a":[1.5],"b":1}') and integrity.seal("no") is None
    both = {r.i: r.status for r in integrity.two_way(df.filter("i < 'n003'"), df.filter("i > 'n000' and i < 'n004'").withColumn("d", F.when(F.col("i") == "n001", "x").otherwise(F.col("d"))), "i", "d").collect()}
    assert both == {"n000": "left-only", "n001": "mismatch", "n002": "same", "n003": "right-only"}
    assert {r.rule: r.n_failed for r in integrity.checked(df.limit(0), {"r": F.col("i") == "x"}).collect()} == {"r": 0, "nothing was checked": 1}


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [(X.stem, "a.b.png", "a.b"), (X.stem, ".hidden", ".hidden"), (X.extension, "x.PNG", "png"), (X.extension, ".hidden", None), (X.image_format, "x.jpg", "jpeg"), (X.is_plain_file_name, "a/b", False), (X.is_plain_file_name, "..", False),
     (X.canonical_licence, " cc_by 4.0", "CC-BY-4.0"), (X.obligation, "CC-BY-SA-4.0", "uncovered"), (X.obligation, "pd", "none"), (X.obligation, None, "uncovered"), (X.iso_band, "200", "low"), (X.iso_band, "ISO", None), (X.iso_band, "3200", "extreme"),
     (X.undouble, "abcd abcd", "abcd"), (X.undouble, "aaa", "aaa"), (X.strip_html, "<p>a&amp;b<br>c</p><script>x</script>", "a&b c"), (X.host, "HTTPS://u@Ex.org:80/p", "ex.org"), (X.urls, "see http://a.b/c, and https://x.", ["http://a.b/c", "https://x"]),
     (X.abbreviated, "0123456789abcdef", "0123456789ab…"), (X.csv_field, 'a"b,', '"a""b,"'), (X.human_bytes, "1536", "1.5 KiB"), (X.only_number, " 0.25 \n", 0.25), (X.only_number, "1 2", None), (X.last_csv_number, "a,1\nname,0.5,x\n\n", 0.5),
     (X.zsteg_reading, "", None), (X.zsteg_reading, "b1,r,lsb .. text: \"hi\"", True), (X.zsteg_reading, "nothing", False), (X.json_score, '{"overall_score": 0.7}', 0.7), (X.json_score, "x", None), (X.version_token, "tool v1.2.3 built", "1.2.3")],
)
def test_text(spark, f, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(f("v")).first()[0] == want


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"a") + chunk(b"IDAT", b"b") + chunk(b"IEND", b"")
JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08\x00\x14\x00\x1e\x01\x01\x11\x00" + b"\xff\xda\x00\x03x" + b"12\xff\x0034\xff\xd0" + b"\xff\xd9"


def test_media(spark):
    df = spark.createDataFrame([(0, PNG), (1, JPEG + b"PK\x03\x04xx"), (2, PNG[:20]), (3, b""), (4, None), (5, PNG + b"hello there")], "k int, c binary")
    got = {r.k: r for r in df.select("k", media.sniff("c").alias("f"), media.png_geometry("c").alias("g"), media.inspect(F.col("c")).alias("i")).collect()}
    assert [got[k].f for k in range(5)] == ["png", "jpeg", "png", None, None]
    assert tuple(got[0].g) == (30, 20, 8, 3) and got[1].g is None and got[2].g is None
    assert (got[1].i.width, got[1].i.height, got[1].i.depth, got[1].i.channels) == (30, 20, 8, 1)
    assert got[0].i.trailing_bytes == 0 and got[1].i.trailing_bytes == 6 and got[1].i.trailing_kind == "zip" and got[5].i.trailing_kind == "text" and got[3].i.trailing_bytes == -1
    assert got[0].i.container == got[5].i.container and got[0].i.container.count("IDAT") == 1 and got[3].i.container is None
    assert media.texture([[0] * 4] * 4) == 0 and media.texture([[0, 0, 0], [0, 8, 0], [0, 0, 0]]) == 32 and media.clipped_fraction([[0, 255], [3, 4]]) == 0.5


def test_runs(spark):
    def detector(contents):
        if any(c == b"bad" for c in contents):
            raise RuntimeError("no")
        return [len(c) / 10 if c != b"flag" else True for c in contents]

    df = spark.createDataFrame([("a", b"xx"), ("b", b"bad"), ("c", b"flag"), ("d", b"x")], "i string, c binary").coalesce(1)
    got = {r.id: (r.score, r.verdict, r.error) for r in runs.score(df, "i", "c", detector).collect()}
    assert got == {"a": (0.2, None, None), "b": (None, None, "no"), "c": (None, True, None), "d": (0.1, None, None)}
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "batch int, key string")
    out = spark.createDataFrame([(1, "a\t0.5\n\n"), (2, "a\t1\nzz\t2"), (3, "noise")], "batch int, stdout string")
    assert {(r.batch, r.key): (r.answer, r.error) for r in runs.keyed_answers(out, asked).collect()} == {(1, "a"): ("0.5", None), (1, "b"): (None, "no answer"), (2, "a"): (None, "batch spoiled"), (3, "a"): (None, "batch spoiled")}
    tests = spark.createDataFrame([("p", True, True), ("p", False, False), ("q", True, True), ("q", False, True), ("r", True, None)], "detector string, must_fire boolean, fired boolean")
    assert {r.detector: r.outcome for r in runs.self_test(tests).collect()} == {"p": "passed", "q": "fires at everything", "r": "failed"}


def test_report_cells(spark):
    df = spark.createDataFrame([("b", 0.2, "bpp", 0.1), ("a", None, None, 0.2), ("b", 0.1, "bpp", 0.3)], "embedder string, rate double, unit string, x double").withColumn("detector", F.lit("d"))
    assert [r.x for r in report.ordered(df).collect()] == [0.2, 0.3, 0.1]
    cell = df.select(report.budget_cell(F.lit(0.25), F.lit(0.004), 0.01), report.budget_cell(F.lit(0.25), F.lit(0.01), 0.01), report.budget_cell(F.lit(None), F.lit(0.0), 0.01)).first()
    assert tuple(cell) == ("25% at 0.4% FA", "25%", "not reported")
    assert [r.line for r in report.aligned(df.orderBy("x"), ["embedder", "x"]).collect()] == ["b  0.1", "a  0.2", "b  0.3"]
    many = report.mark_repeats(df, ["detector", "embedder"])
    assert {(r.embedder, r.repeats) for r in many.collect()} == {("a", 1), ("b", 2)}


def test_release_checks(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "x", 2), ("c", "y", 3), (None, "z", 4)], "k string, d string, i int")
    known = spark.createDataFrame([("a", "n"), ("b", "x"), ("c", "w")], "k string, d string")
    assert {r.i: (r.d, r.written) for r in release.stamped(rows, known, "k", "d").collect()} == {1: ("n", True), 2: ("x", False), 3: ("w", True), 4: ("z", False)}
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert {r.k: r.status for r in release.credit_check(names("aabc"), names("abd"), "k").collect()} == {"a": "repeated", "b": "ok", "c": "extra", "d": "absent"}
    got = release.packed_check(known, spark.createDataFrame([("a", "n"), ("b", "q"), ("e", "e")], "k string, d string"), "k", "d")
    assert {r.k: r.status for r in got.collect()} == {"a": "ok", "b": "stale", "c": "unknown", "e": "missing"}
    lines = spark.createDataFrame([("1", "x"), ("2", "y")], "digest string, name string")
    moved = release.retargeted(lines, spark.createDataFrame([("x", "zz")], "old string, new string"))
    assert [r.line for r in release.sum_lines(moved).collect()] == ["2  y", "1  zz"]
    flags = spark.createDataFrame([(" Kiln ", ["kiln"]), ("", [""]), (None, ["a"]), ("x", None)], "t string, a array<string>").select(release.contaminated(F.col("t"), F.col("a")))
    assert [r[0] for r in flags.collect()] == [True, False, False, False]
    floors = spark.createDataFrame([("a", 9, 10, 80.0), ("a", 0, 0, 80.0), ("b", 1, 2, 60.0)], "component string, covered int, total int, floor double")
    assert {r.component: (r.new_floor, r.verdict) for r in release.raised_floors(floors).collect()} == {"a": (90.0, "ok"), "b": (60.0, "below")}
    claims = spark.createDataFrame([("covers", "there are 1,200 covers in 3 tiers")], "name string, sentence string")
    assert [r.stated for r in release.stale_numbers(claims, spark.createDataFrame([("covers", 1200.0)], "name string, value double")).collect()] == [3.0]
    plugins = spark.createDataFrame([([("p", "docker")],)], "p array<struct<name:string,route:string>>").select(release.migrated_plugins(F.col("p"), {"docker": ("digest", "container")}).alias("p")).first().p
    assert tuple(plugins[0]) == ("p", "digest", "container")
