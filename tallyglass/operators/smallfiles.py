"""Many tiny record files into few large ones, by joining bytes instead of parsing records."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.shared import new_folder

#: The magic number of a zstandard frame and the UTF-8 byte order mark.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
BOM = b"\xef\xbb\xbf"

TARGET_BYTES = 256 << 20
FRAME_BYTES = 4 << 20

_TOKEN = re.compile(rb'"(?:[^"\\\n\r]|\\.)*"|[{}\[\]":]|[^\s"{}\[\]:]+')
_SPACE = re.compile(rb'("(?:[^"\\]|\\.)*")|[\s]+')
#: A record without inner records: one brace opens it, so the next one outside a string ends it. Strings have no line breaks.
_FLAT = rb'\{[^{}"]*(?:"(?:[^"\\\r\n]|\\[^\r\n])*"[^{}"]*)*+\}'
_RECORD = re.compile(_FLAT)
_WHOLE = re.compile(rb"\s*(?:" + _FLAT + rb"\s*)+")
_PAIR = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*("(?:[^"\\]|\\.)*"|[^,"\[\]{}\s]+)')

RECORD_SCHEMA = "fingerprint binary, record binary"
INDEX_SCHEMA = (
    "file string, n_records long, n_duplicates long, raw_bytes long, file_bytes long, raw_sha256 string, "
    "frames array<struct<offset:long,length:long,raw_length:long,crc32:long,n_records:long>>"
)


def complete_records(body: bytes | None) -> list[bytes]:
    """The complete ``{...}`` records of one body, in order, found by record boundaries alone.

    Headers (byte order marks) and the brackets, commas and line breaks between records are skipped. A record that is cut
    off yields nothing; a record that begins after one that was cut off is found again. Null and empty bodies have none.
    """
    if not body:
        return []
    if body.startswith(ZSTD_MAGIC):
        import zstandard

        body = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(body)
    out: list[bytes] = []
    stack: list[bytes] = []
    start, last, at = -1, b"", 0
    while (match := _TOKEN.search(body, at)) or start >= 0:
        if match is None:  # what is open never ends; a record may begin again on a line of its own
            line = body.find(b"\n{", start)
            if line < 0:
                break
            stack, start, last, at = [], -1, b"", line + 1
            continue
        token, at = match.group(), match.end()
        kind = token if len(token) == 1 else b""
        if kind == b'"':  # a string that never ends: what was open is cut off
            stack, start, last = [], -1, b""
            line = body.find(b"\n", at)
            if line < 0:
                break
            at = line + 1
            continue
        if kind == b"{":
            inner = start >= 0 and (last == b":" or stack[-1:] == [b"["])
            if not inner:
                stack, start = [], match.start()
            stack.append(kind)
        elif kind == b"[" and start >= 0:
            stack.append(kind)
        elif kind in (b"}", b"]") and start >= 0:
            if stack and stack[-1] == (b"{" if kind == b"}" else b"["):
                stack.pop()
                if not stack:
                    out.append(body[start:at])
                    start = -1
            else:
                stack, start = [], -1
        last = kind
    return out


def one_line(record: bytes) -> bytes:
    """The record without white space between its tokens, so that a line break can end it; values keep their bytes."""
    return _SPACE.sub(rb"\1", record)


def whole_records(body: bytes | None) -> list[bytes] | None:
    """The records of a body that consists of nothing but complete records without inner ones, a record or several a line or
    a record over several lines; None for any other body, whose boundaries ``complete_records`` has to look for.

    One match over the bytes tells: such a record can't be cut off and yet end in its brace. Line breaks inside a record are
    layout, as strings have none, and are dropped, so that a line break can end it. All other bytes stay as they are.
    """
    body = (body or b"").removeprefix(BOM)
    if not _WHOLE.fullmatch(body):
        return None
    records = [body.strip()] if body.count(b"{") == 1 else _RECORD.findall(body)
    return [r.translate(None, b"\r\n") for r in records]


def joined(units: list[bytes], packed: bool = False) -> bytes:
    """Byte-level join: whole frames as they are, text without its byte order mark and with a closing line break."""
    if packed:
        return b"".join(units)
    plain = [u.removeprefix(BOM) for u in units]
    return b"".join(u if u.endswith(b"\n") else u + b"\n" for u in plain)


def record_fingerprint(line: bytes) -> bytes:
    """128 bits that agree for one record in any layout and any order of its top-level members."""
    parts = _PAIR.split(line)
    if b"".join(parts[::3]).translate(None, b" \t\r\n,") == b"{}":  # nothing but members with plain values
        members = [k + b":" + v for k, v in zip(parts[1::3], parts[2::3], strict=True)]
    else:
        members = _split_members(one_line(line)[1:-1])
    return hashlib.blake2b(b"\x00".join(sorted(members)), digest_size=16).digest()


def _split_members(inner: bytes) -> list[bytes]:
    parts, depth, begin = [], 0, 0
    for match in re.finditer(rb'"(?:[^"\\]|\\.)*"|[{}\[\],]', inner):
        token = match.group()
        if token in (b"{", b"["):
            depth += 1
        elif token in (b"}", b"]"):
            depth -= 1
        elif token == b"," and depth == 0:
            parts.append(inner[begin : match.start()])
            begin = match.end()
    return [*parts, inner[begin:]]


def _lines(body: bytes | None) -> list[bytes]:
    """Every complete record of a body as bytes without line breaks."""
    whole = whole_records(body)
    return [one_line(r) for r in complete_records(body)] if whole is None else whole


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # copies met lately in this task; emptied when large, the sorted merge below is exact
    for batch in batches:
        prints, lines = [], []
        for body in batch.column(0).cast(pa.binary()).to_pylist():
            for line in _lines(body):
                mark = record_fingerprint(line)
                if mark in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(mark)
                prints.append(mark)
                lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(lines, pa.binary())], ["fingerprint", "record"])


def records_of(files: DataFrame, name: str, body: str) -> DataFrame:
    """``noted, record``: every complete record of each body beside the name noted for the body."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noted, lines = [], []
            for known, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found_here = [r.decode("utf-8", "replace") for r in _lines(raw)]
                noted += [known] * len(found_here)
                lines += found_here
            yield pa.RecordBatch.from_arrays([pa.array(noted, pa.string()), pa.array(lines, pa.string())], ["noted", "record"])

    return files.select(F.col(name).alias("noted"), F.col(body).alias("body")).mapInArrow(split, "noted string, record string")


def _packer(folder: str, frame_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.jsonl.zst"
        # every attempt writes its own file and the last step is a rename: a lost or doubled attempt can't leave half a file
        attempt = f"{base}/.{name}.{uuid.uuid4().hex[:8]}"
        frames, held, size, offset = [], [], 0, 0
        digest, last, n_records, n_same, raw = hashlib.sha256(), None, 0, 0, 0
        sink = None

        def flush() -> None:
            nonlocal held, size, offset, sink
            if not held:
                return
            if sink is None:
                sink = system.open_output_stream(attempt)
            plain = joined(held)
            frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)
            sink.write(frame)
            frames.append({"offset": offset, "length": len(frame), "raw_length": len(plain), "crc32": zlib.crc32(plain), "n_records": len(held)})
            digest.update(plain)
            offset, held, size = offset + len(frame), [], 0

        for batch in batches:
            for mark, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if mark == last:
                    n_same += 1
                    continue
                last = mark
                held.append(line)
                n_records, raw, size = n_records + 1, raw + len(line) + 1, size + len(line) + 1
                if size >= frame_bytes:
                    flush()
        flush()
        if sink is None:
            return
        sink.close()
        if system.get_file_info(attempt).size != offset or sum(f["raw_length"] for f in frames) != raw:
            raise OSError(f"{name}: written length differs from the frames' lengths")
        system.move(attempt, f"{base}/{name}")
        row = {"file": f"{folder}/{name}", "n_records": n_records, "n_duplicates": n_same, "raw_bytes": raw, "file_bytes": offset, "raw_sha256": digest.hexdigest(), "frames": frames}
        yield pa.RecordBatch.from_pylist([row], schema=_INDEX_ARROW)

    return pack


_INDEX_ARROW = pa.schema([
    ("file", pa.string()), ("n_records", pa.int64()), ("n_duplicates", pa.int64()), ("raw_bytes", pa.int64()),
    ("file_bytes", pa.int64()), ("raw_sha256", pa.string()),
    ("frames", pa.list_(pa.struct([(c, pa.int64()) for c in ("offset", "length", "raw_length", "crc32", "n_records")]))),
])


def compact_small_files(files: DataFrame, body: str, folder: str, target_bytes: int = TARGET_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write every complete record of the bodies once to few files of about ``target_bytes`` raw; returns their index.

    ``body`` is text or binary, plain or whole zstandard frames. A body of nothing but complete records, told by one match
    over its bytes, is joined as it stands; only other bodies (cut off, arrays, inner records) are looked through for
    boundaries. What is joined are bytes, one record a line, into independent zstandard frames with checksums; no record is
    parsed. Records are the same when their members are, whatever the layout or order; of the copies one stays. Copies are dropped first within a task, then exactly, by a merge
    over sorted fingerprints; a record held by a third of all files therefore shuffles once per task. Each file's length
    is checked before an atomic rename, so lost executors and doubled attempts leave no partial file. The index holds
    lengths and checksums, which ``read_compacted`` verifies. Null, empty and cut-off bodies give no record; no records, no
    file. Other columns of ``files``, whatever their names, aren't read.
    """
    spark = files.sparkSession
    text = files.select(F.col(body).alias("body"))
    total = text.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_files = max(1, -(-total // target_bytes))
    records = text.mapInArrow(_scan, RECORD_SCHEMA)
    ordered = records.repartition(n_files, "fingerprint").sortWithinPartitions("fingerprint", "record")
    index = f"{folder}/_index"
    ordered.mapInArrow(_packer(folder, frame_bytes), INDEX_SCHEMA).write.parquet(index)
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(row["file"])
            with system.open_input_file(path) as source:
                frame = source.read_at(row["length"], row["offset"])
            plain = zstandard.ZstdDecompressor().decompress(frame, max_output_size=row["raw_length"])
            lines = plain.split(b"\n")[:-1]
            if len(frame) != row["length"] or len(plain) != row["raw_length"] or zlib.crc32(plain) != row["crc32"] or len(lines) != row["n_records"]:
                raise OSError(f"{row['file']} at {row['offset']}: length or checksum differs from the index")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["record"])


def read_compacted(index: DataFrame) -> DataFrame:
    """The records (``record string``, one JSON object each) of compacted files, frame by frame, verified against the index."""
    frames = index.select("file", F.explode("frames").alias("f")).select("file", "f.*")
    return frames.repartition(frames.sparkSession.sparkContext.defaultParallelism, "file", "offset").mapInArrow(_unpack, "record string")


def concatenate(files: DataFrame, path: str, body: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Plan and join whole newline-delimited bodies, unread, to blocks of about ``target_bytes``.

    For inputs without copies or cut-off records: each body loses its byte order mark and gains a closing line break if it
    lacks one; whole zstandard frames are joined as they are. Blocks are filled in the order of ``path``. Returns
    ``(block long, content binary, n_files long, n_bytes long, crc32 long)``, checked against the planned lengths. Null
    and empty bodies add nothing. Text and frames get blocks of their own kind.
    """
    raw = files.select(F.col(path).alias("path"), F.col(body).cast("binary").alias("b")).filter(F.octet_length("b") > 0)
    packed = F.hex(F.substring(F.col("b"), 1, 4)) == F.lit(ZSTD_MAGIC.hex().upper())
    mark = F.hex(F.substring(F.col("b"), 1, 3)) == F.lit(BOM.hex().upper())
    size = F.octet_length("b").cast("long")
    sized = raw.select("path", "b", packed.alias("packed"), (size - F.when(mark & ~packed, 3).otherwise(0) + F.when(packed | (F.hex(F.substring(F.col("b"), -1, 1)) == "0A"), 0).otherwise(1)).alias("n"))
    from tallyglass.shared import running_totals

    kind = sized.withColumn("order", F.struct("path", F.xxhash64("b")))
    placed = running_totals(kind, ["packed"], "order", {"upto": "n"}).withColumn("block", ((F.col("upto") - F.col("n")) / target_bytes).cast("long"))

    def join(batches):
        for (packed_, block), rows in _by_block(batches):
            content = joined(rows, packed_)
            yield pa.RecordBatch.from_pylist([{"block": block * 2 + packed_, "content": content, "n_files": len(rows), "n_bytes": len(content), "crc32": zlib.crc32(content)}])

    laid = placed.select("packed", "block", "path", "b").repartition("packed", "block").sortWithinPartitions("packed", "block", "path")
    return laid.mapInArrow(join, "block long, content binary, n_files long, n_bytes long, crc32 long")


def _by_block(batches):
    key, rows = None, []
    for batch in batches:
        for packed, block, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (packed, block) != key:
                if rows:
                    yield key, rows
                key, rows = (packed, block), []
            rows.append(b)
    if rows:
        yield key, rows


def found(spark: SparkSession, lsb: DataFrame) -> DataFrame:
    """``arm, file, sha256`` of each distinct complete record, read back from the compacted files."""
    index = compact_small_files(lsb, "body", new_folder(spark, "compact"))
    fields = F.from_json("record", "arm string, file string, sha256 string")
    return read_compacted(index).select(fields.alias("r")).select("r.*").distinct()
