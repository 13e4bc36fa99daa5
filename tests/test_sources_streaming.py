"""Sources, sinks and streaming forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import runs
from tallyglass.sources import corpus
from tallyglass.streaming import runs as streams


def test_corpus_scan(spark, tmp_path):
    for name, record in (("a/1", {"file": "1.png", "tool": "lsb", "rate": 0.4}), ("a/2", {"role": "clean"}), ("b/c/3", None), ("b/4", "broken")):
        path = tmp_path / f"{name}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
        if record is not None:
            path.with_suffix(".json").write_text(record if isinstance(record, str) else json.dumps(record))
    (tmp_path / "a/5.json").write_text("{}")
    (tmp_path / "a/2.jpg").write_bytes(b"x")
    got = {r.stem: (r.role, r.problem) for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert got["1"] == ("stego", None) and got["2"] == ("clean", "several images") and got["3"][1] == "no record" and got["4"][1] == "record unreadable" and got["5"][1] == "no image"


def test_jsonl_matrix_registry(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "score": 0.5}\n\n{"id": "b"\n')
    rows = corpus.read_jsonl(spark, str(tmp_path / "r.jsonl"), corpus.RECORD).collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m/0.txt").write_text("1 2.5\n3 -4e1\n")
    assert [r.features for r in corpus.read_matrix(spark, str(tmp_path / "m")).orderBy("row").collect()] == [[1.0, 2.5], [3.0, -40.0]]
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/a.toml").write_text('name = "spa"\nkind = "detector"\nformats = ["png"]\nseconds_per_image = 0.7\n')
    assert corpus.read_registry(spark, str(tmp_path / "reg")).first().name == "spa"
    (tmp_path / "reg/b.toml").write_text('name = "spa"\n')
    with pytest.raises(ValueError):
        corpus.read_registry(spark, str(tmp_path / "reg"))


def test_tar_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(i, f"{i:03d}.png", bytes([i]) * (i + 1)) for i in range(7)], "p int, n string, c binary")
    shards = corpus.write_tar_shards(files, str(tmp_path / "out"), "p", "n", "c", 3).collect()
    assert sorted(r.n for r in shards) == [1, 3, 3]
    again = {r.shard: r.sha256 for r in corpus.write_tar_shards(files.repartition(3), str(tmp_path / "again"), "p", "n", "c", 3).collect()}
    assert again == {r.shard: r.sha256 for r in shards}
    members = corpus.read_tar_members(spark, str(tmp_path / "out"), ".png").collect()
    assert sorted((m.member, m.bytes) for m in members) == [(f"{i:03d}.png", i + 1) for i in range(7)]


def test_requests_and_results(spark, tmp_path):
    req = spark.createDataFrame([("r", [0.5, None], [True, False])], "k string, scores array<double>, labels array<boolean>")
    assert [tuple(r) for r in corpus.explode_request(req).orderBy("position").collect()] == [("r", 0, 0.5, True), ("r", 1, None, False)]
    (tmp_path / "a.json").write_text('{"schema": "result-v1", "auc": 0.5}')
    (tmp_path / "b.json").write_text("{")
    docs, skipped = corpus.read_results(spark, str(tmp_path), "schema string, auc double")
    assert docs.first().auc == 0.5 and skipped.count() == 1
    assert corpus.distinct_files(spark, [str(tmp_path), str(tmp_path / "a.json")]).count() == 2


def test_resumable_scores(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make = lambda lo, hi: spark.createDataFrame([(str(i), bytes(i)) for i in range(lo, hi)], "i string, c binary").coalesce(1).write.mode("append").parquet(inbox)
    score = lambda df: runs.score(df, "i", "c", lambda xs: [float(len(x)) if len(x) % 4 else None for x in xs])
    make(0, 6)
    schema = spark.read.parquet(inbox).schema
    for hi in (6, 10):
        if hi > 6:
            make(6, 10)
        streams.resumable_scores(spark.readStream.schema(schema).parquet(inbox), score, out, state, str(tmp_path / "errors")).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(int(r.id) for r in got.collect()) == list(range(10)) and runs.tally(got).first().errored == 3
    assert spark.read.json(str(tmp_path / "errors")).count() == 3


def test_stateful_streams(spark, tmp_path):
    rows = [(i, "a" if i % 2 else None if i % 5 == 0 else "b", dt.datetime(2024, 1, 1, 0, i % 50), float(i)) for i in range(60)]
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, "k int, v string, at timestamp, x double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k int, v string, at timestamp, x double").parquet(path)
    got = streams.drain(streams.admitted(stream, "k", "v", 4), "admitted_t").filter("admitted").collect()
    per = {v: sorted(r.k for r in got if r.v == v) for v in ("a", "b")}
    assert per == {"a": [1, 3, 5, 7], "b": [2, 4, 6, 8]} and sum(r.v is None for r in got) == 6
    last = {r.v: r.k for r in streams.drain(streams.latest_records(stream.filter("v is not null"), "v", "k"), "latest_t", "complete").collect()}
    assert last == {"a": 59, "b": 58}
    counts = streams.drain(streams.event_counts(stream.fillna({"v": "none"}), "at", "v", "10 minutes", "5 minutes"), "counts_t", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 60
    states = streams.arm_states(spark.createDataFrame([("a", "queued", 1), ("a", "done", 3), ("b", "running", 2)], "arm string, state string, at int"))
    assert {r.arm: r.state for r in states.collect()} == {"a": "done", "b": "running"}


def test_tar_shards_are_whole_and_repeatable(spark):
    from pathlib import Path

    from tallyglass.shared import new_folder
    from tallyglass.sources import corpus

    rows = spark.createDataFrame([(i, f"{i:05d}.png", bytes([i % 251]) * (i % 7 * 1000)) for i in range(25)] + [(25, "none.png", None)], "position long, name string, content binary")
    folder = new_folder(spark, "tar")
    first = sorted(map(tuple, corpus.write_tar_shards(rows, folder, "position", "name", "content", 10).collect()))
    assert [r[:2] for r in first] == [(0, 10), (1, 10), (2, 6)]
    assert sorted(p.name for p in Path(folder.removeprefix("file://")).iterdir() if p.suffix == ".tar") == [f"shard-{k:06d}.tar" for k in range(3)]
    again = sorted(map(tuple, corpus.write_tar_shards(rows.repartition(5), new_folder(spark, "tar"), "position", "name", "content", 10).collect()))
    assert again == first
    members = {r.member: r.bytes for r in corpus.read_tar_members(spark, folder + "/*.tar").collect()}
    assert members == {f"{i:05d}.png": i % 7 * 1000 for i in range(25)} | {"none.png": 0}
