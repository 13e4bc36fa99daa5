"""Mixing sources to target weights by size in tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.names import strip
from tallyglass.llm.sample import hash63
from tallyglass.shared import HEAVY_KEYS, cut, join_facts, rank_by_hash

#: Vocabulary of the tokenizer that measures sizes; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that parts text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Budget in tokens that the dynamic program fills exactly; what is larger is first met in proportion.
DP_BUDGET = 1 << 16
#: White space runs longer than this are counted apart, as the pattern's look-ahead would recurse over them.
LONG_BLANK = 2000

_BLANKS = re.compile(r"\s{%d,}" % LONG_BLANK)


def plain_source(col: Column | str = "source") -> Column:
    """A source's plain spelling: trimmed, lower case, with hyphens."""
    return F.translate(F.lower(strip(col)), "_", "-")


class TokenCounter:
    """Tokens of texts in one byte-level vocabulary, loaded once per task."""

    def __init__(self, vocabulary: str):
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) < LONG_BLANK or not _BLANKS.search(text):
            return len(self.encoding.encode_ordinary(text))
        total, at = 0, 0
        for run in _BLANKS.finditer(text):
            # of a run before a word the last blank, if it is a space, belongs to the word
            end = run.end() - 1 if run.end() < len(text) else run.end()
            total += len(self.encoding.encode_ordinary(text[at : run.start()]))
            blanks = text[run.start() : end]
            total += self.blank_tokens(blanks)
            at = end
        return total + len(self.encoding.encode_ordinary(text[at:]))

    def blank_tokens(self, blanks: str) -> int:
        """A run of white space is one piece; its merges are found on the piece itself."""
        return len(self.encoding._encode_single_piece(blanks.encode()))


def token_sizes(documents: DataFrame, doc_id: str, text: str, source: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; null and empty texts have 0 tokens."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "n_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    read = documents.select(F.col(doc_id).alias("doc_id"), source.alias("source"), F.col(text).alias("text"))
    return read.mapInArrow(measure, f"doc_id {kind}, source string, n_tokens long")


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float | None, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source.

    ``targets``: source -> (share, most repeats). Sources without a positive share or without tokens take no part; the
    shares of the others are scaled to sum to 1. Without ``total`` it is the largest size at which every share can be met
    within its repeats. With a larger one, sources at their limit give what they have and the rest is shared by the others.
    """
    share = {s: w for s, (w, reps) in targets.items() if w and w > 0 and reps > 0 and tokens.get(s, 0) > 0}
    limit = {s: tokens[s] * targets[s][1] for s in share}
    if not share:
        return {}
    whole = sum(share.values())
    if total is None:
        total = min(int(limit[s] * whole / w) for s, w in share.items())
    out: dict[str, int] = {}
    left, open_ = total, dict(share)
    while open_:
        whole = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / whole >= limit[s]]
        if not full:
            out |= {s: int(left * w / whole) for s, w in open_.items()}
            break
        for s in full:
            out[s] = limit[s]
            del open_[s]
        left = total - sum(out.values())
    return out


def fit_budget(counts: dict[int, int], budget: int, dp_budget: int = DP_BUDGET) -> dict[int, int]:
    """How many documents of each token length to take so that their sum comes as close to ``budget`` from below as it can.

    Every length first gives its whole part of the proportional share of 15/16 of the budget or more, which keeps the
    length profile and leaves the last step something to choose from. What remains beyond ``dp_budget`` goes to the longest lengths that still have documents, one at a time; the last part is filled by a
    bounded-knapsack dynamic program over exact sums (a bit set per step, counts split into powers of two).
    """
    counts = {int(k): int(n) for k, n in counts.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in counts.items())
    if budget >= total:
        return counts
    base = budget - min(dp_budget // 2, budget // 16)
    take = {k: n * base // total for k, n in counts.items()}
    left = budget - sum(k * n for k, n in take.items())
    for k in sorted(counts, reverse=True):
        if left <= dp_budget:
            break
        more = min(counts[k] - take[k], (left - dp_budget // 2) // k)
        if more > 0:
            take[k] += more
            left -= k * more
    # a remainder beyond dp_budget is only left if nothing shorter than it is left either
    goal = min(left, sum(k * (counts[k] - take[k]) for k in counts))
    if goal <= 0:
        return take
    mask = (1 << goal + 1) - 1
    reach, steps = 1, []
    for k in sorted(counts):
        n, part = counts[k] - take[k], 1
        n = min(n, goal // k)
        while n > 0:
            part = min(part, n)
            steps.append((k, part, reach))
            reach |= (reach << k * part) & mask
            n, part = n - part, part * 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            at -= k * part
            take[k] += part
    return take


def mix(sizes: DataFrame, targets: dict[str, tuple[float | None, int]], seed: str, total: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` (at least 1): the documents of the mix and how often each comes.

    A source whose budget exceeds its size is repeated as a whole, never more than its limit; the remainder is a subset
    fitted to the budget by length counts (``fit_budget``, one task per source over its histogram of lengths, which has as
    many rows as there are different lengths). Of each length the documents with the smallest seeded hashes are taken, so
    the mix is the same on every run. Documents without tokens, of null or untargeted sources aren't in the mix. No
    target, no document: an empty mix.
    """
    spark = sizes.sparkSession
    wanted = sizes.filter((F.col("n_tokens") > 0) & F.col("source").isin(list(targets)))
    tokens = {r["source"]: r["n"] for r in wanted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per target
    plan = [(s, b // tokens[s], b - b // tokens[s] * tokens[s]) for s, b in budgets(tokens, targets, total).items()]
    goals = F.broadcast(spark.createDataFrame(plan, "source string, whole long, rest long"))

    def fit(key: tuple, histogram: pd.DataFrame) -> pd.DataFrame:
        take = fit_budget(dict(zip(histogram["n_tokens"], histogram["n"], strict=True)), int(histogram["rest"].iloc[0]))
        rows = [(key[0], k, int(histogram["whole"].iloc[0]), take.get(k, 0)) for k in map(int, histogram["n_tokens"])]
        return pd.DataFrame(rows, columns=["source", "n_tokens", "whole", "take"])

    counted = cut(wanted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    lengths = counted.join(goals, "source")
    picks = lengths.groupBy("source").applyInPandas(fit, "source string, n_tokens long, whole long, take long")
    key = F.concat_ws(":", "n_tokens", "source").alias("_key")
    whole = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r["_key"] for r in counted.filter(F.col("n") * HEAVY_KEYS > whole).select(key).collect()]  # fewer than HEAVY_KEYS
    ranked = rank_by_hash(wanted.withColumn("_h", hash63(seed, F.col("doc_id").cast("string")) * 8), ["source", "n_tokens"], "_h", ["doc_id"])
    met = join_facts(ranked.select("doc_id", "source", "n_tokens", "rank", key), cut(picks.select(key, "whole", "take"), "picks"), "_key", "inner", hot)
    copies = (F.col("whole") + F.when(F.col("rank") < F.col("take"), 1).otherwise(0)).cast("int")
    return met.select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its share asked for and reached, tokens, documents and most copies."""
    per = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies")
    )
    whole = per.agg(F.sum("tokens").alias("all_tokens"))
    asked = targets.select(plain_source("source").alias("source"), "target_share", "max_repeats")
    return asked.join(per, "source", "left").join(F.broadcast(whole), how="cross").select(  # one row
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)), 9).alias("share"),
    )
