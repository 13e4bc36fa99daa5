"""Passages of test items inside a corpus: SimHash windows, Hamming blocks, weighted shingles, exact check."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyglass.llm.text import words

#: A window has this many words and a passage at least as many, with at most one edit.
WINDOW = 12
#: A fingerprint is cut into blocks; a word votes on the bits of one block only.
BLOCKS = 4
BLOCK_BITS = 16
#: Blocks that one edit can change: that of a word which leaves the window and that of a word which enters it.
RADIUS = 2
#: Equal words in a row that every passage has beside its edit.
ANCHOR = WINDOW // 2
#: Most item words searched in one pass: it bounds the index that every task gets. More items take more passes.
PASS_WORDS = 2_000_000
#: A closing sentence is an instruction and no passage if this share of the items, and at least three, end in it.
INSTRUCTION_SHARE = 0.02
#: Windows fingerprinted at once.
PART = 100_000

OUT_SCHEMA = "doc_id long, item_id long, n_words int, similarity double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WindowHasher:
    """SimHash of windows: each word casts weighted votes, +1 or -1 by its hash, on the bits of the block it belongs to.

    The last row of the votes belongs to words that no item has and to the end of a text: they don't vote. As a word votes in
    one block, windows that are one replaced, omitted or added word apart have fingerprints that differ in at most
    ``RADIUS`` blocks, by any number of bits: with ``BLOCKS`` blocks some ``BLOCKS - RADIUS`` of them are equal.
    """

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        mixed = _mix(np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        signs = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)[:, :BLOCK_BITS].astype(np.int16) * 2 - 1
        block = (mixed >> np.uint64(40)) % np.uint64(BLOCKS)
        own = np.arange(BLOCKS) == block[:, None].astype(int)
        votes = own[:, :, None] * (signs * weights[:, None].astype(np.int16))[:, None, :]
        self.votes = np.concatenate([votes.reshape(n, BLOCKS * BLOCK_BITS), np.zeros((1, BLOCKS * BLOCK_BITS), np.int16)]).astype(np.int16)

    def __call__(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``(len(starts), BLOCKS)`` blocks of the windows that begin at ``starts``."""
        total = np.zeros((len(starts), BLOCKS * BLOCK_BITS), np.int16)
        for k in range(WINDOW):
            total += self.votes[ids[starts + k]]
        return np.packbits(total > 0, axis=1).view(">u2").astype(np.uint64).reshape(len(starts), BLOCKS)


class BlockTables:
    """Multi-index over fingerprints: one table per choice of ``BLOCKS - RADIUS`` blocks, sorted by their bits."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.choices, self.tables = prints, list(combinations(range(BLOCKS), BLOCKS - RADIUS)), []
        for choice in self.choices:
            key = self._key(prints, choice)
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << 20, bool)  # most windows of a corpus are like no item: this tells without a search
            some[self._slot(key)] = True
            self.tables.append((key[order], order, some))

    @staticmethod
    def _key(prints: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
        key = np.zeros(len(prints), np.uint64)
        for b in choice:
            key = (key << np.uint64(BLOCK_BITS)) | prints[:, b]
        return key

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (_mix(key) >> np.uint64(44)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (asked, held) of all fingerprints that differ in at most ``RADIUS`` blocks, each pair once."""
        for nth, (choice, (held, order, some)) in enumerate(zip(self.choices, self.tables, strict=True)):
            key = self._key(prints, choice)
            asked = np.flatnonzero(some[self._slot(key)])
            low, high = np.searchsorted(held, key[asked], "left"), np.searchsorted(held, key[asked], "right")
            n = high - low
            a = np.repeat(asked, n)
            b = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            for earlier in self.choices[:nth]:  # reported from its first equal choice of blocks
                fresh = np.zeros(len(a), bool)
                for k in earlier:
                    fresh |= prints[a, k] != self.prints[b, k]
                a, b = a[fresh], b[fresh]
            if len(a):
                yield a, b


def instructions(texts: list[str]) -> set[tuple[str, ...]]:
    """Closing sentences that many items share, as words."""
    ends = Counter(tuple(words(re.split(r"(?<=[.?!:])\s+", t.strip())[-1])) for t in texts if t and t.strip())
    return {w for w, n in ends.items() if n >= max(3, INSTRUCTION_SHARE * len(texts)) and w}


class ItemIndex:
    """The windows of all items of one pass in block tables, with the items' words as ids."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        names = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: i for i, w in enumerate(names)}
        count = Counter(w for _, ws in items for w in set(ws))
        # rare words weigh more, in whole steps; the last weight is that of words which no item has
        self.weights = np.array([*(1 + int(np.log2(max(1, len(items) / count[w]))) for w in names), 0], np.int64)
        self.n = len(names)
        self.hasher = WindowHasher(self.weights[:-1])
        self.item_ids = [i for i, _ in items]
        self.ids = np.array([self.vocabulary[w] for _, ws in items for w in ws], np.int64)
        self.begin = np.cumsum([0, *[len(ws) for _, ws in items]])
        self.starts = np.concatenate([np.arange(b, e - WINDOW + 1) for b, e in zip(self.begin, self.begin[1:], strict=False)] or [np.zeros(0, np.int64)]).astype(np.int64)
        prints = [self.hasher(self.ids, part) for part in np.array_split(self.starts, len(self.starts) // PART + 1)]
        self.tables = BlockTables(np.concatenate(prints))
        self.owner = np.repeat(np.arange(len(items)), np.diff(self.begin))
        self.list = self.ids.tolist()
        weight = self.weights[self.ids]
        pair = np.append(weight[:-1] + weight[1:], 0)
        self.shingle = np.append(self.ids[:-1] * (self.n + 1) + self.ids[1:], 0)  # neighbouring words
        each = pair[self.starts[:, None] + np.arange(WINDOW - 1)] if len(self.starts) else np.zeros((0, WINDOW - 1), np.int64)
        self.pair, self.total = pair, each.sum(1)
        # one edit touches at most two shingles of a window: the least similarity that it leaves
        self.least = 1 - np.sort(each, axis=1)[:, -2:].sum(1) / np.maximum(self.total, 1)

    def similarity(self, flat: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Weighted share of an item window's shingles that the text's window at ``at`` has too."""
        inner = np.arange(WINDOW - 1)
        near = at[:, None] + inner
        here = flat[near] * (self.n + 1) + flat[near + 1]
        place = self.starts[window][:, None] + inner
        there = self.shingle[place]
        same = np.zeros(there.shape, bool)
        for k in inner:
            same |= there == here[:, k : k + 1]
        return (self.pair[place] * same).sum(1) / np.maximum(self.total[window], 1)

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text windows and item windows within the radius, and their similarity."""
        for part in np.array_split(starts, len(starts) // PART + 1):
            for a, b in self.tables.candidates(self.hasher(flat, part)) if len(part) else ():
                for x, y in zip(np.array_split(a, len(a) // PART + 1), np.array_split(b, len(b) // PART + 1), strict=True):
                    yield part[x], y, self.similarity(flat, part[x], y)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float]]:
        """``(text number, item number, words covered, similarity)`` of each text and item with a passage in common."""
        get, none = self.vocabulary.get, self.n
        docs = [[*(get(w, none) for w in words(t)), none] for t in texts]  # a passage may lack its last word
        flat = np.fromiter((i for d in docs for i in d), np.int64)
        bounds = np.cumsum([0, *map(len, docs)])
        if len(flat) < WINDOW or not len(self.starts):
            return
        # of a window that is one edit from an item's at most one word is in no item
        outside = np.concatenate([[0], np.cumsum(flat == none)])
        starts = np.flatnonzero(outside[WINDOW:] - outside[:-WINDOW] <= 1)
        doc_of = np.repeat(np.arange(len(docs)), np.diff(bounds))
        starts = starts[doc_of[starts] == doc_of[starts + WINDOW - 1]]
        best: dict[tuple[int, int], tuple[int, float]] = {}
        done: dict[tuple[int, int, int], int] = {}
        for at, window, similarity in self.candidates(flat, starts):
            keep = similarity >= self.least[window] - 1e-9
            for s, place in zip(at[keep].tolist(), self.starts[window[keep]].tolist(), strict=True):
                doc, item = int(doc_of[s]), int(self.owner[place])
                words_, here = docs[doc], s - int(bounds[doc])
                if done.get((doc, item, here - place), -1) >= here:  # the run that this window begins in was checked
                    continue
                for i, j in self.anchors(words_, here, place):
                    line = (doc, item, i - j)
                    if done.get(line, -1) >= i:
                        continue
                    covered, share, end = self.verify(words_, i, item, j)
                    done[line] = max(done.get(line, -1), end - ANCHOR)
                    if covered >= WINDOW and (covered, share) > best.get((doc, item), (0, 0.0)):
                        best[doc, item] = (covered, share)
        for (doc, item), (covered, share) in best.items():
            yield doc, item, covered, share

    def anchors(self, doc: list[int], here: int, place: int) -> Iterator[tuple[int, int]]:
        """Where ``ANCHOR`` words of the item's window stand in a row in the text's, at most one word shifted."""
        for shift in (0, 1, -1):
            for k in range(WINDOW - ANCHOR + 1):
                i, j = here + k + shift, place + k
                if i >= 0 and doc[i : i + ANCHOR] == self.list[j : j + ANCHOR]:
                    yield i, j
                    break

    def verify(self, doc: list[int], i: int, item: int, place: int) -> tuple[int, float, int]:
        """Item words covered by the run of equal words around ``doc[i] = item[place]`` plus at most one edit beside it.

        Also the weighted share of the covered shingles (neighbouring word pairs, weighted by their words) that are equal,
        and the end of the run in ``doc``.
        """
        it, lo, hi = self.list, int(self.begin[item]), int(self.begin[item + 1])
        a, b = i, place
        while a > 0 and b > lo and doc[a - 1] == it[b - 1]:
            a, b = a - 1, b - 1
        e, f = i + ANCHOR, place + ANCHOR
        while e < len(doc) and f < hi and doc[e] == it[f]:
            e, f = e + 1, f + 1
        best, span, hole = f - b, (b, f), -1

        def right(x: int, y: int) -> int:
            n = 0
            while x + n < len(doc) and y + n < hi and doc[x + n] == it[y + n]:
                n += 1
            return n

        def left(x: int, y: int) -> int:
            n = 0
            while x - n > 0 and y - n > lo and doc[x - n - 1] == it[y - n - 1]:
                n += 1
            return n

        options = []
        if f < hi:
            options.append((b, f + 1 + right(e + 1, f + 1) if e < len(doc) else f + 1, f))
            options.append((b, f + 1 + right(e, f + 1), f))
        options.append((b, f + right(e + 1, f), -2))
        if b > lo:
            options.append((b - 1 - (left(a - 1, b - 1) if a > 0 else 0), f, b - 1))
            options.append((b - 1 - left(a, b - 1), f, b - 1))
        options.append((b - (left(a - 1, b) if a > 0 else 0), f, -2))
        for x, y, gap in options:
            if y - x > best:
                best, span, hole = y - x, (x, y), gap
        pairs = [(int(self.weights[it[k]]) + int(self.weights[it[k + 1]]), k not in (hole, hole - 1)) for k in range(span[0], span[1] - 1)]
        total = sum(w for w, _ in pairs) or 1
        return best, round(sum(w for w, same in pairs if same) / total, 6), e


def leaks(documents: DataFrame, doc_id: str, text: str, items: list[tuple[int, str | None]]) -> DataFrame:
    """``doc_id, item_id, n_words, similarity``: documents that repeat a passage of an item.

    A passage is ``WINDOW`` or more consecutive words of the item, of which at most one is replaced, left out or has a word
    added beside it; ``words`` says what a word is. An instruction that closes many items is no part of them. ``n_words``
    is the most item words so covered, ``similarity`` the weighted share of their shingles that are equal.

    Every window of ``WINDOW`` words of a text gets a SimHash, and block tables give all windows of items whose fingerprints
    are within ``RADIUS`` blocks, which holds for every window one edit apart. A candidate's similarity in weighted shingles
    (neighbouring words) must be what one edit leaves of the item's window at least; what remains is checked word by word.

    Documents are never shuffled and whole texts are searched. The items are the stated query set: their tables
    are sent to the tasks, at most ``PASS_WORDS`` words at a time, so the index is bounded however many items there are; the
    documents are read once per pass.
    Null and empty texts have no passage, nor have items of fewer than ``WINDOW`` words; equal items are each reported;
    no items or no documents give no rows. Extra columns aren't read.
    """
    spark = documents.sparkSession
    shared = instructions([t for _, t in items if t])
    passes: list[list[tuple[int, list[str]]]] = [[]]
    held = 0
    for item_id, item_text in sorted(items, key=lambda x: x[0]):
        ws = words(item_text)
        for tail in shared:
            if len(ws) > len(tail) and tuple(ws[-len(tail) :]) == tail:
                ws = ws[: -len(tail)]
                break
        if len(ws) >= WINDOW:
            if held + len(ws) > PASS_WORDS:
                passes.append([])
                held = 0
            passes[-1].append((item_id, ws))
            held += len(ws)
    read = documents.select(doc_id, text)
    out = None
    for part in passes:
        sent = spark.sparkContext.broadcast(ItemIndex(part))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[d], index.item_ids[i], n, s) for d, i, n, s in index.search(texts)]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "similarity"])

        found = read.mapInArrow(search, OUT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out
