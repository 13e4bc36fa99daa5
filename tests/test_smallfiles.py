"""Compaction of small record files: boundaries, exactness, round trip and edge cases."""

import json
import random

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.operators import smallfiles as s
from tallyglass.shared import new_folder

A = {"arm": "x", "file": "a.png", "sha256": "0" * 64, "width": 5}
B = {"arm": "y", "file": "b {\"}.png", "sha256": "1" * 64, "note": "line\\n and ] [ "}


@pytest.mark.parametrize(
    ("body", "n"),
    [
        (json.dumps(A), 1), (json.dumps(A, indent=2) + "\n", 1), (json.dumps(A).replace(", ", ",\r\n") + "\r\n", 1), (json.dumps(A) + "\n" + json.dumps(B) + "\n", 2),
        (json.dumps([A, B]), 2), (json.dumps([A, B], indent=1), 2), ("﻿" + json.dumps(A), 1), (json.dumps(A) + json.dumps(B), 2), (json.dumps(A)[:-3], 0), (json.dumps(A) + "\n" + json.dumps(B)[:-9], 1),
        (json.dumps([A, B])[:-20], 1), (json.dumps(A)[:20] + "\n" + json.dumps(B), 1), ('{"a": 1,\n' + json.dumps(A), 1), ("", 0), (" \n", 0), ("[]", 0), ('{"a": {"b": [1, {"c": 2}]}}', 1), ("[1, 2]", 0), ("}{", 0),
    ],
)
def test_boundaries(body, n):
    got = s.complete_records(body.encode())
    assert len(got) == n
    for record in got:
        assert json.loads(s.one_line(record)) in (A, B) or n == 1


def test_whole_bodies_are_told_from_others():
    whole = [json.dumps(A), json.dumps(A, indent=2) + "\r\n", json.dumps(A) + "\n" + json.dumps(B) + "\n", "\ufeff" + json.dumps(B), json.dumps(A) + json.dumps(B), json.dumps(A | {"box": [1, 2]}, indent=1), "{}"]
    for body in whole:
        got = s.whole_records(body.encode())
        assert [json.loads(r) for r in got] == [json.loads(r) for r in s.complete_records(body.encode())] and not any(b"\n" in r for r in got)
    one = json.dumps(A).encode()
    assert s.whole_records(one + b"\n") == [one]  # byte for byte
    for k in range(len(json.dumps(B))):  # no cut-off body passes for whole
        assert s.whole_records(json.dumps(B)[:k].encode()) is None
        assert s.whole_records(json.dumps({"a": B})[:k].encode()) is None
    for body in (json.dumps([A]), '{"a": {}}', json.dumps(A) + "{", "x" + json.dumps(A), "", None, '{"a": "' + "x" * 300_000, '{"a' * 20_000, "{ " * 50_000):
        assert s.whole_records(body and body.encode()) is None
    big = json.dumps({"a": "{" + "y\\" * 500_000, "b": 1}).encode()
    assert s.whole_records(big) == [big]


def test_zstandard_body():
    packed = zstandard.ZstdCompressor().compress(json.dumps(A).encode())
    assert len(s.complete_records(packed)) == 1
    assert s.complete_records(None) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=6), st.lists(st.text(max_size=3), max_size=2)), min_size=1, max_size=4), max_size=4), st.booleans())
def test_agrees_with_a_parser(records, pretty):
    text = "\n".join(json.dumps(r, indent=1 if pretty else None, ensure_ascii=False) for r in records)
    assert [json.loads(s.one_line(r)) for r in s.complete_records(text.encode())] == records


def test_fingerprint_ignores_layout_and_order():
    a = s.one_line(json.dumps(B, indent=3).encode())
    b = s.one_line(json.dumps(dict(reversed(B.items()))).encode())
    assert s.record_fingerprint(a) == s.record_fingerprint(b) != s.record_fingerprint(s.one_line(json.dumps(A).encode()))
    spread = json.dumps(dict(reversed(B.items())), indent=3).replace("\n", "")
    assert s.record_fingerprint(spread.encode()) == s.record_fingerprint(a)
    nested = {"a": {"x": [1, 2]}, "b": "c"}
    assert s.record_fingerprint(s.one_line(json.dumps(nested).encode())) == s.record_fingerprint(s.one_line(json.dumps(dict(reversed(nested.items())), indent=1).encode()))


def test_round_trip(spark):
    rng = random.Random(3)
    records = [{"arm": "lsb", "file": f"{i}.png", "sha256": f"{i:064x}", "k": i} for i in range(300)]
    bodies = [json.dumps(r, indent=rng.choice([None, 1])) for r in records] + [json.dumps(records[7])] * 200 + ["", None, json.dumps(records[3])[:-5]]
    df = spark.createDataFrame([(b, "clash", "clash") for b in bodies], "body string, record string, fingerprint string")
    folder = new_folder(spark, "t")
    index = s.compact_small_files(df, "body", folder, target_bytes=8000, frame_bytes=1000)
    rows = index.collect()
    assert len(rows) > 1 and sum(r.n_records for r in rows) == 300 and sum(len(r.frames) for r in rows) > len(rows)
    assert sorted(json.loads(r.record)["k"] for r in s.read_compacted(index).collect()) == list(range(300))
    # the files are whole zstandard streams of lines, and nothing else is left beside them
    from pathlib import Path

    files = sorted(p for p in Path(folder.removeprefix("file://")).iterdir() if "part-" in p.name)
    assert len(files) == len(rows)
    text = b"".join(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(p.read_bytes()) for p in files)
    assert text.count(b"\n") == 300


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(json.dumps(A),)], "body string")
    index = s.compact_small_files(df, "body", new_folder(spark, "t"))
    path = index.first().file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        s.read_compacted(index).collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "body string")
    assert s.found(spark, empty).count() == 0
    assert s.found(spark, spark.createDataFrame([(None,), ("",)], "body string")).count() == 0


def test_missing_and_null_fields(spark):
    df = spark.createDataFrame([('{"arm": null, "file": "f"}',), ('{"file":"f","arm":null}',), ("x" * 2_000_000 + json.dumps(A),)], "body string")
    got = {tuple(r) for r in s.found(spark, df).collect()}
    assert got == {(None, "f", None), ("x", "a.png", "0" * 64)}


def test_concatenate(spark):
    frame = zstandard.ZstdCompressor().compress(b"z\n")
    rows = [("b", b"2\n"), ("a", b"1"), ("c", b"\xef\xbb\xbf3\n"), ("d", b""), ("e", None), ("f", bytes(frame)), ("a", b"1")]
    got = s.concatenate(spark.createDataFrame(rows, "p string, b binary"), "p", "b", 1000).collect()
    assert {bytes(r.content) for r in got} == {b"1\n1\n2\n3\n", bytes(frame)}
    assert all(r.n_bytes == len(r.content) for r in got)
    many = spark.createDataFrame([(f"{i:04d}", f"{i:04d}".encode()) for i in range(100)], "p string, b binary")
    got = s.concatenate(many, "p", "b", 50).orderBy("block").collect()
    assert b"".join(bytes(r.content) for r in got) == b"".join(b"%04d\n" % i for i in range(100))
    assert len(got) == 10
