"""Duplicates of a new batch in itself and in everything accepted before, from bucketed index tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyglass.shared import cut, join_facts

#: Differing bits allowed in each of the two fingerprints; one band more than bits leaves one band untouched.
RADIUS = 6
BANDS = RADIUS + 1
#: Most contents of one band that are compared within their bucket; larger bands are cut into chunks of this size.
CHUNK = 250_000
#: Most rows of one content joined in one cell; beyond, groups are cut.
ROW_CHUNK = 2_000
#: A content's rows are dealt to this many buckets, so one that holds a third of all rows is no single bucket.
SALTS = 16
#: Candidate pairs compared at once.
BLOCK = 2_000_000

SHIFTS = [i * 64 // BANDS for i in range(BANDS)]
WIDTHS = [b - a for a, b in zip(SHIFTS, [*SHIFTS[1:], 64], strict=True)]


def _bands(col: str) -> Column:
    """One struct per band of a 64-bit print: its number and its bits. By the pigeonhole principle two prints within
    ``RADIUS`` bits share at least one of the ``BANDS`` bands."""
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(col, s).bitwiseAND((1 << w) - 1).alias("band")) for i, (s, w) in enumerate(zip(SHIFTS, WIDTHS, strict=True))
    ])


def _same_band(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> np.uint64(SHIFTS[i])) & np.uint64((1 << WIDTHS[i]) - 1) == 0


def _near(i: int, d: np.ndarray, p: np.ndarray, new: np.ndarray, half: np.ndarray, split: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one cell within the radius in both prints, one of them new; each only from its lowest shared bands.

    The new prints are looked up among all of the cell by each band of ``p``, so old prints never meet one another.
    """
    fresh = np.flatnonzero(new)
    for j in range(BANDS):
        value = (p >> np.uint64(SHIFTS[j])) & np.uint64((1 << WIDTHS[j]) - 1)
        order = np.argsort(value, kind="stable")
        held = value[order]
        low, high = np.searchsorted(held, value[fresh], "left"), np.searchsorted(held, value[fresh], "right")
        upto = np.cumsum(high - low)
        begin = 0
        while begin < len(fresh):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
            n = (high - low)[begin:end]
            a = np.repeat(fresh[begin:end], n)
            b = order[np.repeat(low[begin:end] - (upto[begin:end] - n - done), n) + np.arange(n.sum())]
            begin = end
            keep = (a < b) | ~new[b]
            if split:
                keep &= half[a] != half[b]
            a, b = a[keep], b[keep]
            x, y = d[a] ^ d[b], p[a] ^ p[b]
            keep = ((x | y) != 0) & (np.bitwise_count(x) <= RADIUS) & (np.bitwise_count(y) <= RADIUS)
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            keep = np.ones(len(a), bool)
            for lower in range(i):
                keep &= ~_same_band(x, lower)
            for lower in range(j):
                keep &= ~_same_band(y, lower)
            if keep.any():
                yield a[keep], b[keep]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by cell ``(i, band, ca, cb)``; a cell is at most two chunks of contents. A cell without new prints is passed over."""
    names = ["d1", "p1", "d2", "p2"]

    def flush(key, parts) -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        d, p, new, half = (np.concatenate([x[k] for x in parts]) for k in range(4))
        if not new.any():
            return
        d, p = d.view(np.uint64), p.view(np.uint64)
        for a, b in _near(key[0], d, p, new, half, key[2] != key[3]):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (d[a], p[a], d[b], p[b])], names)

    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(4)], 1)
        cols = [np.asarray(batch.column(4)), np.asarray(batch.column(5)), np.asarray(batch.column(6).cast(pa.int8())).astype(bool), np.asarray(batch.column(7)).astype(np.int64)]
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for s, e in zip(starts, starts[1:], strict=False):
            this = tuple(keys[s])
            if this != key:
                yield from flush(key, parts)
                key, parts = this, []
            parts.append([c[s:e] for c in cols])
    yield from flush(key, parts)


def content_key(d: str = "d", p: str = "p", digest: str = "digest") -> Column:
    """One key per content: the two prints where they are known, else the digest. Equal digests share their prints."""
    return F.when(F.col(d).isNotNull() & F.col(p).isNotNull(), F.concat_ws(":", d, p)).otherwise(F.concat(F.lit("#"), digest))


class BatchTables:
    """Tables bucketed by the hash of their keys under one shared folder, filled batch by batch.

    The folder holds all state: the number of buckets, each batch's files under its own name, and one marker per accepted
    batch. So an index opened again, in another session and with other settings, sees what was accepted, and only that. A
    batch is first staged, which replaces whatever an earlier attempt of that name left, and then accepted by one marker
    for all tables: a lost or repeated run neither loses nor doubles rows. Tables are declared with their buckets, so a join or
    window on the keys needs no shuffle of the history.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str]]], buckets: int | None = None):
        self.spark, self.folder, self.tables = spark, folder, tables
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: hadoop.Path("/".join([folder, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        meta = self._path("buckets")
        if not self._fs.exists(meta):
            self._fs.mkdirs(self._path(f"buckets/{buckets or int(spark.conf.get('spark.sql.shuffle.partitions'))}"))
        self.buckets = min(int(f.getPath().getName()) for f in self._fs.listStatus(meta))
        self._names = {t: f"tallyglass_{t}_{uuid.uuid4().hex}" for t in tables}
        for table, (columns, keys) in tables.items():
            location = self._path(table).toString()
            spark.sql(
                f"CREATE TABLE {self._names[table]} ({columns}, part STRING) USING parquet PARTITIONED BY (part) "
                f"CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )

    def accepted(self) -> list[str]:
        """Names of the accepted batches."""
        marks = self._path("accepted")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def stage(self, name: str, **rows: DataFrame) -> None:
        """Write a batch's rows of each table, in place of any earlier attempt; they don't count before ``accept``."""
        if name in self.accepted():
            raise ValueError(f"batch {name} was accepted before")

        def write(table: str) -> None:
            columns, keys = self.tables[table]
            wanted = [c.split()[0] for c in columns.split(", ")]
            view = f"tallyglass_{uuid.uuid4().hex}"
            rows[table].select(*wanted).repartition(self.buckets, *keys).createOrReplaceTempView(view)
            self.spark.sql(f"INSERT OVERWRITE TABLE {self._names[table]} PARTITION (part = '{name}') SELECT * FROM {view}")
            self.spark.catalog.dropTempView(view)

        with ThreadPoolExecutor(len(rows) or 1) as pool:  # the tables don't wait for one another
            list(pool.map(write, rows))

    def accept(self, name: str) -> None:
        """From now on the staged batch counts as history, in all tables at once."""
        self._fs.mkdirs(self._path("accepted", name))

    def read(self, table: str, *staged: str) -> DataFrame:
        """Rows of the accepted batches and of those named, with the batch's name as ``part``."""
        parts = [*self.accepted(), *staged]
        for part in parts:
            if self._fs.exists(self._path(table, f"part={part}")):
                self.spark.sql(f"ALTER TABLE {self._names[table]} ADD IF NOT EXISTS PARTITION (part = '{part}')")
        return self.spark.table(self._names[table]).filter(F.col("part").isin(parts) if parts else F.lit(False))


class HistoryIndex(BatchTables):
    """Accepted rows by content hash (``contents``), and their prints by band (``bands``).

    ``check(name, batch)`` finds a batch's duplicates, ``accept(name)`` makes it part of the history. ``append`` is both for
    rows whose duplicates aren't asked for. What a check shuffles is the batch; of the history it streams the band buckets
    and fetches the rows of the contents it met.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        super().__init__(spark, folder, {
            "contents": ("content STRING, salt INT, row_id BIGINT", ["content", "salt"]),
            "bands": ("i INT, band BIGINT, d BIGINT, p BIGINT", ["i", "band"]),
        }, buckets)

    def put(self, name: str, batch: DataFrame) -> DataFrame:
        """Stage a batch (``row_id, digest, d, p``); its contents (``content, d, p``) as a table."""
        known = batch.filter("digest is not null or (d is not null and p is not null)").withColumn("content", content_key())
        rows = known.select("content", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("salt"), "row_id")
        fresh = cut(known.groupBy("content").agg(F.min("d").alias("d"), F.min("p").alias("p")), "fresh")
        bands = fresh.filter("d is not null and p is not null").select("d", "p", F.explode(_bands("d")).alias("b")).select("d", "p", "b.i", "b.band")
        self.stage(name, contents=rows, bands=bands)
        return fresh

    def append(self, name: str, batch: DataFrame) -> None:
        """Accept a batch without looking for duplicates; nothing happens if it was accepted before."""
        if name not in self.accepted():
            self.put(name, batch)
            self.accept(name)

    def near(self, name: str) -> DataFrame:
        """``d1, p1, d2, p2``: different contents within ``RADIUS`` bits in both prints, one of them in the staged batch.

        Bands are read in their buckets, old and new rows of a band together, without a shuffle; in a band the new prints
        look up candidates by the bands of ``p``, which are verified exactly and reported from their lowest shared bands. A
        band of more than ``CHUNK`` contents, such as one of flat images, is cut into chunks, and pairs of chunks go to
        tasks of their own. The sizes of the bands are a table of at most ``BANDS * 2 ** 10`` rows. A print is listed once a
        batch; pairs met several times are made distinct by the caller.
        """
        bands = self.read("bands", name).withColumn("is_new", F.col("part") == name)
        sizes = bands.groupBy("i", "band").agg(F.count("*").alias("n"), F.max("is_new").alias("any_new"))
        live = [(r.i, r.band, -(-r.n // CHUNK)) for r in sizes.filter("any_new").collect()]
        key = ["i", "band", "ca", "cb"]
        schema = "d1 long, p1 long, d2 long, p2 long"

        def cells(some: list[tuple]) -> DataFrame:
            chosen = F.broadcast(self.spark.createDataFrame(some, "i int, band long, chunks long"))
            chunk = F.pmod(F.xxhash64("p", "d"), F.col("chunks")).cast("int")
            met = bands.join(chosen, ["i", "band"]).withColumn("c", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
            return met.select("i", "band", F.least("c", "other").alias("ca"), F.greatest("c", "other").alias("cb"), "d", "p", "is_new", F.when(F.col("c") > F.col("other"), 1).otherwise(0).alias("half"))

        # the window asks for rows of a band together and in order, which the buckets give
        small = cells([x for x in live if x[2] == 1]).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
        found = small.mapInArrow(_compare, schema)
        large = [x for x in live if x[2] > 1]
        if large:
            found = found.unionByName(cells(large).repartition(self.buckets, *key).sortWithinPartitions(*key).mapInArrow(_compare, schema))
        return found

    def check(self, name: str, batch: DataFrame) -> DataFrame:
        """``row_id_a, row_id_b`` (a < b): pairs with the same content or near prints, at least one row from ``batch``.

        ``batch``: ``row_id, digest, d, p``. Full copies and the rows of near contents are fetched by a join in the content's
        buckets. Pairs of contents are expanded to pairs of rows: a content with very many rows is cut into chunks of about
        ``ROW_CHUNK``, so its pairs spread over many tasks, and none is dropped. Null digests without prints match nothing.
        Row ids must be unique. A batch that was accepted before can't be checked again; a staged one can.
        """
        fresh = self.put(name, batch)
        near = self.near(name).select(F.concat_ws(":", "d1", "p1").alias("l"), F.concat_ws(":", "d2", "p2").alias("r"))
        near = cut(near.select(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).distinct(), "near")
        wanted = fresh.select("content").unionByName(near.select(F.col("left").alias("content"))).unionByName(near.select(F.col("right").alias("content"))).distinct()
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = self.read("contents", name).join(salted, ["content", "salt"]).select("content", "row_id", (F.col("part") == name).alias("is_new"))
        rows = cut(held, "rows")
        contents = cut(rows.groupBy("content").agg(F.count("*").alias("n"), F.max("is_new").alias("is_new")).withColumn("chunks", F.ceil(F.col("n") / ROW_CHUNK).cast("int")), "sizes")
        sizes = contents.select("content", "chunks")
        pairs = (
            near.join(sizes.select(F.col("content").alias("left"), F.col("chunks").alias("lc")), "left")
            .join(sizes.select(F.col("content").alias("right"), F.col("chunks").alias("rc")), "right")
            .select("left", "right", F.explode(F.sequence(F.lit(0), F.col("lc") - 1)).alias("ca"), "rc")
            .select("left", "right", "ca", F.explode(F.sequence(F.lit(0), F.col("rc") - 1)).alias("cb"))
        )
        copies = (
            contents.filter("n > 1 and is_new").select("content", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("ca"))
            .select(F.col("content").alias("left"), F.col("content").alias("right"), "ca", F.explode(F.sequence("ca", F.col("chunks") - 1)).alias("cb"))
        )
        met = pairs.unionByName(copies)
        # a content that takes part in no pair needs no rows
        partners = met.select(F.col("left").alias("content")).unionByName(met.select(F.col("right").alias("content"))).distinct().join(sizes, "content")
        spread = join_facts(rows, partners, "content", "inner", self._heavy(contents)).withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int"))
        one = spread.select(F.col("content").alias("left"), F.col("chunk").alias("ca"), F.col("row_id").alias("x"), F.col("is_new").alias("x_new"))
        two = spread.select(F.col("content").alias("right"), F.col("chunk").alias("cb"), F.col("row_id").alias("y"), F.col("is_new").alias("y_new"))
        same_cell = (F.col("left") == F.col("right")) & (F.col("ca") == F.col("cb"))
        both = met.join(one, ["left", "ca"]).join(two, ["right", "cb"]).filter("x_new or y_new").filter(~same_cell | (F.col("x") < F.col("y")))
        return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))

    def _heavy(self, contents: DataFrame) -> list[str]:
        """The contents with the most rows, at most 128, among those beyond 100 chunks."""
        return [r.content for r in contents.filter("chunks > 100").orderBy(F.desc("n"), "content").limit(128).collect()]


def clean_rows(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """``row_id, batch, digest, d, p`` of the clean rows; prints by plain digest, null where the store has none."""
    from tallyglass.functions.names import plain_digest

    rows = manifest.filter("arm is null and source_png is null").select("row_id", F.col("batch_no").alias("batch"), plain_digest("sha256").alias("digest"))
    prints = images.select(F.col("sha256").alias("digest"), F.col("dhash").alias("d"), F.col("phash").alias("p"))
    return join_facts(rows, prints, "digest", "left").select("row_id", "batch", "digest", "d", "p")


def arrivals(index: HistoryIndex, rows: DataFrame, known: int = 0) -> DataFrame | None:
    """Batches of ``rows`` in the order of ``batch``, each checked against all before it and then accepted.

    Batches up to ``known`` are history and only accepted. The pairs of each batch end in a table before the next one comes;
    batches are what arrives one after another, so their number is no size of the data. None without rows. A null batch is
    taken as history. Running it again on the same folder skips what was accepted.
    """
    found = None
    for r in rows.select(F.coalesce("batch", F.lit(known)).alias("b")).distinct().orderBy("b").collect():
        name, part = f"batch-{r.b}", rows.filter(F.coalesce("batch", F.lit(known)) == r.b)
        if r.b <= known:
            index.append(name, part)
        elif name not in index.accepted():
            pairs = cut(index.check(name, part), "pairs")
            index.accept(name)
            found = pairs if found is None else found.unionByName(pairs)
    return found
