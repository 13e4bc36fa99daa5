"""Whether a result still stands: its seal, its records, its corpus and the images behind it."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.integrity import seals

#: Bytes of a records file held at once.
PIECE = 4 << 20


def stream_digest(rows: DataFrame, ident: str, digest: str) -> DataFrame:
    """One row ``n, digest``: SHA-256 over ``id\\0digest\\n`` of all rows in the order of their ids, as one stream.

    Such a hash is sequential by definition: one task takes in the lines, in Arrow batches, after the ids were sorted in ranges
    (``integrity.corpus_digest`` is the tree that distributes). Null for no rows, and where a row has no digest. Repeated
    rows are hashed as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, whole = hashlib.sha256(), 0, True
        for batch in batches:
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, whole = n + 1, whole and d is not None
                total.update(f"{i}\0{d}\n".encode())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.hexdigest() if n and whole else None], pa.string())], ["n", "digest"])

    lines = rows.select(F.col(ident).cast("string").alias("i"), F.col(digest).alias("d"))
    hashed = lines.orderBy("i", "d").coalesce(1).mapInArrow(run, "n long, digest string")
    return hashed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("digest").alias("digest"))  # no task, no row


def records_digest(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, records_sha256, n_records`` of records files: the hash of their bytes and their lines that aren't blank.

    Files are read as streams, a piece at a time, wherever they lie; a last line needs no line break. A missing file has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                try:
                    system, base = fs.FileSystem.from_uri(name)
                    total, n, rest = hashlib.sha256(), 0, False  # rest: the open line has something in it
                    with system.open_input_stream(base) as source:
                        while piece := source.read(PIECE):
                            total.update(piece)
                            for line in io.BytesIO(piece):
                                rest = rest or bool(line.strip())
                                if line.endswith(b"\n"):
                                    n, rest = n + rest, False
                    out.append((name, total.hexdigest(), n + rest))
                except FileNotFoundError:
                    out.append((name, None, None))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "records_sha256", "n_records"])

    return paths.select(F.col(path).alias("path")).mapInArrow(run, "path string, records_sha256 string, n_records long")


def verified(documents: DataFrame, records: DataFrame, corpora: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, status``: the first thing that doesn't hold of a result, or ``ok``.

    ``documents``: ``doc_id, document, claimed_seal, records_sha256, n_records, corpus, corpus_sha256, asked, scored``. In this
    order: ``unreadable``, ``seal`` (the document was changed after it was written; one without a seal isn't held against it),
    ``records unrecorded`` and ``records`` (``records``: ``doc_id, records_sha256, n_records`` of the files at hand, where there
    are any), ``corpus unknown`` and ``corpus`` (``corpora``: ``corpus, corpus_sha256`` recomputed), ``images`` (``images``:
    ``corpus, n_bad`` of a rehash, where one was made), ``partial`` (not all that was asked for was scored). What was computed isn't
    given away, only that it differs. Ids and corpora are unique.
    """
    at_hand = records.select("doc_id", F.col("records_sha256").alias("_r"), F.col("n_records").alias("_rn"))
    known = corpora.select("corpus", F.col("corpus_sha256").alias("_c"))
    bad = images.select("corpus", F.col("n_bad").alias("_bad"))
    seal = seals(F.col("document"))
    joined = documents.withColumn("_seal", seal).join(at_hand, "doc_id", "left").join(known, "corpus", "left").join(bad, "corpus", "left")
    status = (
        F.when(F.col("_seal").isNull(), "unreadable").when(F.col("claimed_seal") != F.col("_seal"), "seal")
        .when(F.col("_r").isNotNull() & F.col("records_sha256").isNull(), "records unrecorded")
        .when((F.col("_r") != F.col("records_sha256")) | (F.col("_rn") != F.col("n_records")), "records")
        .when(F.col("_c").isNull(), "corpus unknown").when(~F.col("_c").eqNullSafe(F.col("corpus_sha256")), "corpus")
        .when(F.col("_bad") > 0, "images").when(F.col("scored") < F.col("asked"), "partial").otherwise("ok")
    )
    return joined.select("doc_id", status.alias("status"))
