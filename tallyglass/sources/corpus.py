"""Sources: corpus folders of image and record pairs, JSON lines, registries, feature matrices, tar members, result documents."""

from __future__ import annotations

import io
import tarfile
import tomllib
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.names import plain_name
from tallyglass.functions.text import extension, stem

SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "file", "sha256", "source_png", "clean_sha256", "split", "arm", "tool", "rate_unit", "domain", "split_salt", "licence")] + [
    T.StructField("rate", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("changed", T.LongType()), T.StructField("tier_order", T.LongType()),
])
RECORD = "id string, score double, verdict boolean, error string, elapsed_ms long"
#: Bounds of a scan: bytes of a record file and nesting of folders.
MOST_RECORD_BYTES = 256 << 10
MOST_DEPTH = 32


def _files(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader if names is None else reader.option("pathGlobFilter", names)).load(root)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per pair or half pair under ``root``: ``folder, stem, image, sha256, record (struct), role, problem``.

    Images and records pair by folder and stem. ``problem`` tells of an image without record, a record without image, several
    images for one record, an unreadable or oversized record, or a path too deep. The image's bytes are hashed where
    they are read and not kept. The role is stated, else follows from the tool (``clean`` or not), else from an arm.
    """
    def named(names: str | None) -> DataFrame:
        files = _files(spark, root, names).withColumn("name", F.substring_index("path", "/", -1))
        return files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("stem", stem("name"))

    # records are found by their name alone, so no image is read for them
    others = named(None).filter(F.coalesce(extension("name"), F.lit("")) != "json")
    images = others.groupBy("folder", "stem").agg(F.min("name").alias("image"), F.count("*").alias("n_images"), F.min(F.sha2("content", 256)).alias("actual"))
    text = F.when(F.col("length") <= MOST_RECORD_BYTES, F.decode("content", "UTF-8"))
    records = named("*.[jJ][sS][oO][nN]").select("folder", "stem", F.col("length").alias("record_bytes"), F.from_json(text, SAMPLE).alias("record"), (F.try_parse_json(text).isNull()).alias("broken"))
    pairs = images.join(records, ["folder", "stem"], "full")
    r = F.col("record")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    role = F.coalesce(blank(r["role"]), F.when(blank(r["tool"]) == "clean", "clean").when(blank(r["tool"]).isNotNull(), "stego"), F.when(blank(r["arm"]).isNotNull(), "stego").otherwise("clean"))
    depth = F.size(F.split(F.replace("folder", F.lit(root)), "/"))
    problem = (
        F.when(depth > MOST_DEPTH, "too deep").when(F.col("record_bytes").isNull(), "no record").when(F.col("record_bytes") > MOST_RECORD_BYTES, "record too large")
        .when(F.col("broken"), "record unreadable").when(F.col("image").isNull(), "no image").when(F.col("n_images") > 1, "several images")
    )
    return pairs.select("folder", "stem", "image", F.col("actual").alias("sha256"), "record", F.when(r.isNotNull(), role).alias("role"), problem.alias("problem"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped, unreadable ones kept in ``_corrupt_record``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the TOML files of a registry (a bounded configuration, parsed on the driver): ``file, name, kind, ...``.

    A name that two entries claim is refused.
    """
    rows, seen = [], {}
    for path in sorted(Path(folder).rglob("*.toml")):
        entry = tomllib.loads(path.read_text())
        name = str(entry.get("name", path.stem))
        if name in seen:
            raise ValueError(f"{name} is registered in {seen[name]} and {path}")
        seen[name] = path
        rows.append((str(path), name, str(entry.get("kind", "")), [str(f) for f in entry.get("formats", [])], float(entry["seconds_per_image"]) if "seconds_per_image" in entry else None, int(entry.get("timeout", 60))))
    return spark.createDataFrame(rows, "file string, name string, kind string, formats array<string>, seconds_per_image double, timeout int")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Feature matrices as white-space separated text: ``file, row, features``; rows keep their place in their file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    return lines.filter(F.trim("line") != "").select("file", "row", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("features"))


def read_tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``shard, member, bytes, sha256`` of the files in tar shards, each shard streamed by one task."""
    import hashlib

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(suffix):
                            data = tar.extractfile(member).read()
                            rows.append((shard, member.name, len(data), hashlib.sha256(data).hexdigest()))
                yield pd.DataFrame(rows, columns=["shard", "member", "bytes", "sha256"])

    return _files(spark, path).select("path", "content").mapInPandas(walk, "shard string, member string, bytes long, sha256 string")


def write_tar_shards(files: DataFrame, folder: str, position: str, name: str, content: str, per_shard: int) -> DataFrame:
    """Pack files into tar shards of ``per_shard`` by dense position, with pinned metadata; returns ``shard, n, sha256``.

    A shard streams to the shared folder under a name of its own attempt and is renamed when it is whole, so a lost or doubled
    task leaves no half shard. A task holds the members of one Arrow batch.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)

        class Sink(io.RawIOBase):
            def __init__(self, key: int):
                self.path = f"{base}/shard-{key:06d}.tar"
                self.part = f"{base}/.shard-{key:06d}.{uuid.uuid4().hex[:8]}"
                self.out, self.digest = system.open_output_stream(self.part), hashlib.sha256()

            def write(self, data) -> int:
                data = bytes(data)
                self.digest.update(data)
                self.out.write(data)
                return len(data)

        def done() -> pa.RecordBatch:
            tar.close()
            sink.out.close()
            system.move(sink.part, sink.path)
            return pa.RecordBatch.from_pylist([{"shard": key, "n": n, "sha256": sink.digest.hexdigest()}])

        key, n, tar, sink = None, 0, None, None
        for batch in batches:
            for shard, name_, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if shard != key:
                    if key is not None:
                        yield done()
                    key, n, sink = shard, 0, Sink(shard)
                    tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                data = bytes(data or b"")
                info = tarfile.TarInfo(name_)
                info.size, info.mtime, info.mode = len(data), 0, 0o644
                tar.addfile(info, io.BytesIO(data))
                n += 1
        if key is not None:
            yield done()

    sharded = files.select(F.floor(F.col(position) / per_shard).cast("long").alias("shard"), F.col(position).alias("position"), F.col(name).alias("name"), F.col(content).alias("content"))
    return sharded.repartition("shard").sortWithinPartitions("shard", "position").mapInArrow(pack, "shard long, n long, sha256 string")


def explode_request(requests: DataFrame, scores: str = "scores", labels: str = "labels") -> DataFrame:
    """A metrics request's arrays as rows ``position, score, label``."""
    zipped = F.posexplode(F.arrays_zip(F.col(scores).alias("score"), F.col(labels).alias("label"))).alias("position", "z")
    return requests.select(*[c for c in requests.columns if c not in (scores, labels)], zipped).select("*", "z.score", "z.label").drop("z")


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Result documents under a path and the files skipped: ``(documents with file, skipped files)``."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = text.select("file", F.from_json("value", schema).alias("d"), F.try_parse_json("value").isNull().alias("broken"))
    return parsed.filter("not broken").select("file", "d.*"), parsed.filter("broken").select("file")


def distinct_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files under several paths, one that two of them name once."""
    out = None
    for p in paths:
        one = _files(spark, p).select("path", "length")
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["path"]).withColumn("name", plain_name("path"))
