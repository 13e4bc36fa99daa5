"""References to records that are missing, deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import cut, heavy_keys, join_facts

#: One block of the filter is one bitmap of the engine: 32,768 bits.
BLOCK_BITS = 32768
BITS_PER_KEY = 12
PROBES = 6
#: Most blocks of 4 KiB that are broadcast. A larger filter is as selective, but goes to the references by a join on the block.
MOST_BLOCKS = 32768


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """``PROBES`` positions in a block, cut from a second hash of the key."""
    second = F.xxhash64(key, F.lit("bloom"))
    third = F.xxhash64(key, F.lit("probe"))
    parts = [F.shiftrightunsigned(second, 15 * i) for i in range(4)] + [F.shiftrightunsigned(third, 15 * i) for i in range(4)]
    return [p.bitwiseAND(BLOCK_BITS - 1) for p in parts[:PROBES]]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter of ``keys.key`` as rows ``(_block, _bitmap)``: at most ``blocks`` rows of 4 KiB each.

    Built with partial bitmaps on every task; only bitmaps travel, so a key that fills a third of the rows costs nothing more.
    """
    spread = keys.select(_block(F.col(key), blocks).alias("_block"), F.explode(F.array(*_bits(F.col(key)))).alias("_bit"))
    return spread.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_bitmap"))


def might_contain(key: Column, bitmap: Column) -> Column:
    """Whether every probed bit of ``key`` is set in its block; a missing block or null key is false."""
    tests = None
    for bit in _bits(key):
        at = (F.shiftright(bit, 3) + 1).cast("int")
        one = F.ascii(F.decode(F.substr(bitmap, at, F.lit(1)), "ISO-8859-1"))
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit.bitwiseAND(7) + 1).cast("int"))
        hit = one.bitwiseAND(mask) != 0
        tests = hit if tests is None else tests & hit
    return F.coalesce(tests, F.lit(False))


def filter_blocks_for(n_keys: int) -> int:
    """Blocks for ``n_keys`` at ``BITS_PER_KEY``, at least one."""
    return max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))


def orphans(references: DataFrame, parents: DataFrame, deletions: DataFrame, table_kinds: dict[str, str]) -> DataFrame:
    """The references that have no live parent at their own time, with the reason.

    ``references``: ``ref_table, row_key, name, at``. ``parents``: ``kind, name, since``. ``deletions``: ``name, gone``.
    ``table_kinds`` says which kind of parent each table's references need. A reference is an orphan if no parent of its
    kind and name has ``since <= at`` (``late`` if one comes afterwards, ``missing`` if none ever does), or if its name was
    deleted at or before ``at`` (``deleted``). Returns ``ref_table, row_key, name, at, reason``.

    A Bloom filter of the parents, broadcast up to ``MOST_BLOCKS`` blocks (128 MiB, some 89 million keys) and joined by block
    beyond, proves most missing ones; each reference is probed once. What passes is verified by an exact join with each
    name's earliest parent and deletion, proven orphans pass it by with a null key, so false positives can't
    survive. Heavy names are spread over tasks (see ``join_facts``). References with a null name or time are none;
    parents with a null name or ``since`` and undated deletions don't count. Repeated rows change nothing; without
    parents every reference is missing. Extra columns are ignored.
    """
    refs = references.filter(F.col("name").isNotNull() & F.col("at").isNotNull()).select("ref_table", "row_key", "name", "at")
    kinds = sorted(set(table_kinds.values()))
    since = [F.min(F.when(F.col("kind") == k, F.col("since"))).alias(f"since_{k}") for k in kinds]
    known = cut(
        parents.filter(F.col("name").isNotNull() & F.col("since").isNotNull()).groupBy("name").agg(*since), "parents"
    )
    gone = deletions.filter(F.col("name").isNotNull() & F.col("gone").isNotNull()).groupBy("name").agg(F.min("gone").alias("gone"))

    keyed = known.select(F.explode(F.array(*[F.when(F.col(f"since_{k}").isNotNull(), F.concat_ws("\x00", F.lit(k), "name")) for k in kinds])).alias("key")).filter("key is not null")
    blocks = filter_blocks_for(known.count() * len(kinds))
    kind_of = F.create_map(*[F.lit(x) for pair in table_kinds.items() for x in pair])[F.col("ref_table")]
    wanted = F.concat_ws("\x00", kind_of, "name")
    filtered = bloom_blocks(keyed, "key", blocks)
    placed = refs.withColumn("_want", wanted).withColumn("_block", _block(F.col("_want"), blocks))
    small = blocks <= MOST_BLOCKS
    met = placed.join(F.broadcast(filtered), "_block", "left") if small else join_facts(placed, filtered, "_block", "left")
    passed = F.when(might_contain(F.col("_want"), F.col("_bitmap")), F.col("name"))
    probed = met.select("ref_table", "row_key", "name", "at", passed.alias("_key"))
    facts = known.join(gone, "name", "left").withColumnRenamed("name", "_key")
    joined = join_facts(probed, facts, "_key", "left", heavy_keys(refs, "name"))
    first = None
    for ref_table, kind in table_kinds.items():
        cond = F.col("ref_table") == ref_table
        first = F.when(cond, F.col(f"since_{kind}")) if first is None else first.when(cond, F.col(f"since_{kind}"))
    reason = (
        F.when(F.col("gone") <= F.col("at"), "deleted").when(first.isNull(), "missing").when(first > F.col("at"), "late")
    )
    checked = joined.withColumn("reason", reason).filter("reason is not null")
    return checked.select("ref_table", "row_key", "name", "at", "reason")


def per_table_and_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphans counted per table, period and reason."""
    return found.groupBy("ref_table", F.date_trunc(period, "at").alias("period"), "reason").agg(F.count("*").alias("n"))
