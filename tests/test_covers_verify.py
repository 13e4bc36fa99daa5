"""Covers, replaced rows, selections, checked tallies, report groups and the chain of verification."""

import hashlib
import json

from tallyglass.functions.text import arm_of_path, cover_of_path
from tallyglass.operators import covers, verify
from tallyglass.operators.calibrate import rank_area
from tallyglass.operators.integrity import seal
from tallyglass.shared import new_folder

ROWS = "image string, arm string, half string, cover string, domain string, how string, known_cover string"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_cover_map_and_resolution(spark):
    rows = [("a", "x", "h1", "c1", "s", "", ""), ("b", "x", "h1", None, "s", "", ""), ("c", "x", "h2", "c1", "s", "", ""), ("d", "x", "h2", "c2", None, "", ""), ("e", "x", "h2", None, "s", "", ""), ("f", "x", None, None, "s", "", ""), ("g", "x", "h9", None, "s", "", "")]
    df = spark.createDataFrame(rows, ROWS).drop("how", "known_cover")
    mapped = covers.cover_map(df.unionByName(df), "half", "cover")
    assert rows_of(mapped, "half", "cover", "n_covers") == [("h1", "c1", 1), ("h2", "c1", 2)]
    assert rows_of(covers.conflicts(mapped), "half") == [("h2",)]
    got = {r.image: (r.how, r.known_cover) for r in covers.resolved(df, mapped, "half", "cover").collect()}
    assert got == {"a": ("direct", "c1"), "b": ("via half", "c1"), "c": ("direct", "c1"), "d": ("direct", "c2"), "e": ("ambiguous", None), "f": ("unresolved", None), "g": ("unresolved", None)}
    arms = rows_of(covers.with_clean_arms(df, "arm", "half", "domain").filter("clean"), "arm", "image")
    assert arms == [("clean-none", "h2"), ("clean-s", "h1"), ("clean-s", "h2"), ("clean-s", "h9")]
    empty = df.limit(0)
    assert covers.resolved(empty, covers.cover_map(empty, "half", "cover"), "half", "cover").count() == 0


def test_replaced_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("c1", None), (None, None)], "name string, cover string")
    gone = spark.createDataFrame([("c1",), ("c1",), ("zz",), (None,)], "gone string")
    assert rows_of(covers.doomed(df, [F.col("name"), F.col("cover")], gone, "gone"), "name", "doomed") == [("a", True), ("b", False), ("c1", True), (None, False)]
    log = gone.withColumnRenamed("gone", "name")
    assert rows_of(covers.log_checks(log, df, "name"), "name", "n", "status") == [("c1", 2, "repeated"), ("zz", 1, "unknown"), (None, 1, "unnamed")]
    places, free = spark.createDataFrame([(7,), (3,), (9,)], "place long"), spark.createDataFrame([(20, "y"), (10, "x")], "o long, candidate string")
    assert rows_of(covers.spliced(places, "place", free, "o"), "place", "o", "candidate") == [(3, 10, "x"), (7, 20, "y"), (9, None, None)]
    assert covers.spliced(places.limit(0), "place", free, "o").count() == 0


def test_checked_tally(spark):
    labels = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("c", 1, None), ("d", 1, False)], "g string, k int, label boolean")
    said = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 2, True), ("c", 1, None), ("d", 1, False)], "g string, k int, predicted boolean")
    got = rows_of(covers.checked_tally(labels, said, ["g"], "k"), "g", "status", "tp", "fp", "tn", "fn")
    assert got == [("a", "ok", 1, 1, 0, 0), ("b", "length-mismatch", None, None, None, None), ("c", "empty", None, None, None, None), ("d", "ok", 0, 0, 1, 0)]


def test_selection_and_groups(spark):
    registry = spark.createDataFrame([("spa", "statistical"), ("zsteg", "signature")], "name string, kind string")
    none = spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([("spa",), ("spa",), ("zsteg",), ("spb",)], "name string")
    assert rows_of(covers.selection(none, registry), "name") == [("spa",), ("zsteg",)]
    assert rows_of(covers.selection(none, registry, "signature"), "name") == [("zsteg",)]
    assert rows_of(covers.selection(asked, registry), "name", "status") == [("spa", "ok"), ("spb", "unknown"), ("zsteg", "ok")]
    assert rows_of(covers.selection(asked, registry, "statistical"), "name", "status") == [("spa", "ok"), ("spb", "unknown"), ("zsteg", "other kind")]
    results = spark.createDataFrame([("custom", "a", "1"), ("named", "z", "1"), ("named", "b", "2"), ("named", "b", "1"), ("named", "b", "1")], "configuration string, corpus string, digest string")
    assert rows_of(covers.report_groups(results), "place", "configuration", "corpus", "digest", "n") == [(0, "named", "b", "1", 2), (1, "named", "b", "2", 1), (2, "named", "z", "1", 1), (3, "custom", "a", "1", 1)]


def test_paths(spark):
    df = spark.createDataFrame([("outguess/0200/00042.jpg",), ("clean/00042.jpg",), ("00042.jpg",), ("",), (None,)], "p string")
    assert [tuple(r) for r in df.select(arm_of_path("p"), cover_of_path("p")).collect()] == [("outguess/0200", "00042.jpg"), ("clean", "00042.jpg"), ("clean", "00042.jpg"), ("clean", ""), (None, None)]


def test_stream_digest(spark):
    rows = [("b", "2"), ("a", "1"), ("a", "1")]
    want = hashlib.sha256(b"a\x001\na\x001\nb\x002\n").hexdigest()
    df = spark.createDataFrame(rows, "i string, d string")
    assert tuple(verify.stream_digest(df.repartition(3), "i", "d").first()) == (3, want)
    assert tuple(verify.stream_digest(df.unionByName(spark.createDataFrame([("c", None)], "i string, d string")), "i", "d").first()) == (4, None)
    assert tuple(verify.stream_digest(df.limit(0), "i", "d").first()) == (0, None)


def test_records_digest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(verify, "PIECE", 7)
    cases = {"a": b'{"x": 1}\n\n  \n{"y": 2}\n', "b": b"one long line without an end", "c": b"", "d": b"\n\n"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in [*cases, "missing"]], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.records_sha256, r.n_records) for r in verify.records_digest(paths).collect()}
    assert got == {n: (hashlib.sha256(d).hexdigest(), sum(bool(x.strip()) for x in d.split(b"\n"))) for n, d in cases.items()} | {"missing": (None, None)}


def test_chain(spark):
    doc = json.dumps({"auc": 0.5, "elapsed_seconds": 3})
    good = seal(doc)
    rows = [
        ("ok", doc, good, "r", 2, "c", "C", 9, 9), ("time", json.dumps({"elapsed_seconds": 8, "auc": 0.5}), good, "r", 2, "c", "C", 9, 9), ("edited", doc.replace("0.5", "0.9"), good, "r", 2, "c", "C", 9, 9),
        ("unsealed", doc, None, "r", 2, "c", "C", 9, 9), ("text", "{", good, "r", 2, "c", "C", 9, 9), ("unrecorded", doc, good, None, None, "c", "C", 9, 9), ("records", doc, good, "q", 2, "c", "C", 9, 9), ("count", doc, good, "r", 3, "c", "C", 9, 9),
        ("other", doc, good, "r", 2, "c", "D", 9, 9), ("nowhere", doc, good, "r", 2, "n", "C", 9, 9), ("swapped", doc, good, "r", 2, "s", "S", 9, 9), ("part", doc, good, "r", 2, "c", "C", 9, 8),
    ]
    documents = spark.createDataFrame(rows, "doc_id string, document string, claimed_seal string, records_sha256 string, n_records int, corpus string, corpus_sha256 string, asked int, scored int")
    records = spark.createDataFrame([(r[0], "r", 2) for r in rows], "doc_id string, records_sha256 string, n_records int")
    corpora, images = spark.createDataFrame([("c", "C"), ("s", "S")], "corpus string, corpus_sha256 string"), spark.createDataFrame([("c", 0), ("s", 1)], "corpus string, n_bad int")
    want = {"ok": "ok", "time": "ok", "unsealed": "ok", "edited": "seal", "text": "unreadable", "unrecorded": "records unrecorded", "records": "records", "count": "records", "other": "corpus", "nowhere": "corpus unknown", "swapped": "images", "part": "partial"}
    assert dict(map(tuple, verify.verified(documents, records, corpora, images).collect())) == want
    shallow = dict(map(tuple, verify.verified(documents, records.limit(0), corpora, images.limit(0)).collect()))
    assert shallow["swapped"] == shallow["records"] == shallow["unrecorded"] == "ok"


def test_rank_area():
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        s, y = rng.integers(0, 6, 40), rng.random(40) < 0.4
        pos, neg = s[y], s[~y]
        assert abs(rank_area(s, y) - ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))) < 1e-12
    assert math.isnan(rank_area([1, 2], [True, True]))


def test_examples_keep_few(spark):
    from tallyglass.operators.pairing import examples

    df = spark.createDataFrame([("a", f"{i:03d}") for i in range(100)] * 2 + [("b", "x"), ("b", None), ("c", None)], "g string, v string")
    assert {r.g: r.examples for r in examples(df, "g", "v").collect()} == {"a": ["000", "001", "002"], "b": ["x"]}
